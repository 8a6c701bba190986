"""Column expressions. All of them are built from Spark's own functions, so they stay in generated code."""
