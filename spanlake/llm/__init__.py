"""Operators of a training-data pipeline: language, quality, duplicates, privacy, tokens, mixing and page text.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries.py`` has the thin queries that apply the operators to whole tables.
"""
