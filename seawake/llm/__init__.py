"""Operators for preparing language-model training text, and their registered queries."""
