"""Operators for preparing training data at scale.

Nothing else in the package imports this subpackage; its queries and their SQL
are in :mod:`parchmill.llm.queries`.
"""
