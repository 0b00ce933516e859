"""Operators for preparing language-model training data.

Each module holds one operator with its own interface; ``queries`` applies them
to the tables. Nothing outside this subpackage imports it.
"""
