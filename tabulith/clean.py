"""Column names."""

from .operators.cleaning import clean_column_names

__all__ = ["clean_column_names"]
