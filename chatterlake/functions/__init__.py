"""Column-level building blocks. Everything here is a built-in Spark expression."""
