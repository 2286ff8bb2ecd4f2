"""Index, match, rank, facet, fold and suggest as DataFrame operations."""
