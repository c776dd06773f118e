"""Column expressions, predicates and measures that reports share."""
