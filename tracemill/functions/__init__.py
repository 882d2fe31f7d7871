"""Column expressions over texts, answers and scores."""
