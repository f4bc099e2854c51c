"""Column expressions: identity, pricing, dates and text."""
