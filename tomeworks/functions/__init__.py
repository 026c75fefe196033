"""Column functions: text, citations, numbers, prompts, intents, hash order."""
