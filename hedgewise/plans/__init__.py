"""Named queries over the given tables, each with its check in SQL."""
