"""Column functions: text analysis, scoring formulas, snippets."""
