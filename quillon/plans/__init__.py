"""From dialect text to Spark SQL: tokens, syntax tree, typed rendering."""
