"""Column-level building blocks: canonical types, text shapes, redaction."""
