"""Column functions: cleaning of text, dates, and classes."""
