"""Column expressions: rules, labels and message parsing."""
