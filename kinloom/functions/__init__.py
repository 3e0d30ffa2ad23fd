"""Column expressions: report texts and masks of nested profiles."""
