"""Column-level building blocks: text, vectors, answers and models."""
