"""Full-text indexing, ranked search and snippets as Spark DataFrames."""
