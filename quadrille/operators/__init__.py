"""Operators on fields, each a DataFrame in and a DataFrame out."""
