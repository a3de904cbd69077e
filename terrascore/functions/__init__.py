"""Column expressions: cleaning, labels, score bands and line geometry."""
