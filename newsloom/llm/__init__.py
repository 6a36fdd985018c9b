"""Training-data operators: language, duplicates, leaks, tokens, extraction, reputation."""
