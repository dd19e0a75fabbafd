"""Column-expression factories (all built-in Spark SQL functions, no UDFs)."""
