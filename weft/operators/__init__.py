"""Graph operators."""
