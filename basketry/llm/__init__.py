"""Operators of a training-data pipeline (text, dedup, privacy, tokens).

Nothing else in the package imports this subpackage; its queries are in
``basketry.llm.queries`` and its DuckDB twins in ``basketry.llm.oracle``.
"""
