"""Operators that prepare text for training language models, their queries and their SQL."""
