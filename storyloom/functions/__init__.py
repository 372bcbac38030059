"""Column functions: text, URLs, keywords, dates, publishers, scores."""
