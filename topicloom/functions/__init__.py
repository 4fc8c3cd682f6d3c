"""Column expressions and numeric functions Spark has no built-in for."""
