"""quillon: a strict SQL dialect, constrained tables and transactions on Spark."""
