"""Review tables derived from the sample tables, and the query registry."""
