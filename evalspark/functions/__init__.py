"""Column functions: each takes and returns Spark columns, none runs Python per row."""
