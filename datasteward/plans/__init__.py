"""Ready-made queries over the given tables, each with its independent SQL."""
