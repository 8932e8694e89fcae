"""Column functions: predicates and full text."""
