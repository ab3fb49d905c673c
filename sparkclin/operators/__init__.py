"""Operators over resources: indexing, search, history, terminology, validation, reports."""
