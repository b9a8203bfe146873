"""The scalar function library as typed Spark SQL text: every function is a built-in expression."""
