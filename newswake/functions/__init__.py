"""Column functions: dates, text, scores, fixed word lists."""
