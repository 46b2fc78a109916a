"""Operators that prepare language-model training data.

Nothing outside this folder imports it; ``queries`` and ``oracle_sql`` are
collected in :mod:`textmill.llm.registry`.
"""
