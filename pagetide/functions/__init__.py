"""Column functions: values, URLs, scores, decisions."""
