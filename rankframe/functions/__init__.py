"""Column functions: text, numbers, answers, safe arithmetic."""
