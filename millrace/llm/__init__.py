"""Operators for LLM training data; nothing else in the library imports this subpackage."""
