"""Plans that are built in rounds or from a query language."""
