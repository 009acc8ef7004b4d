"""Column expressions: text cleaning, line classification, tokens, HTML."""
