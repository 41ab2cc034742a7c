"""From source text to fact tables."""
