"""Names, orderings, literals and the base of all operators."""
