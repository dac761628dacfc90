"""Column expressions, and the byte-level functions that Spark's own can't express."""
