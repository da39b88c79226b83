"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Queries and their SQL live in
``quarrydex.llm.registry``.
"""
