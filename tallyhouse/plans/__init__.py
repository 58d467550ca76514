"""Plan shapes that Spark has no single operator for."""
