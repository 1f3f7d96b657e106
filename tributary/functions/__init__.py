"""Column expressions: text, contact data, dates, places, similarity."""
