"""Column builders: text, predicates, numbers and dates."""
