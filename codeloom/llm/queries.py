"""All queries of the text operators and their DuckDB equivalents."""

from __future__ import annotations

from codeloom.llm import authorship, descriptions, leaks, parsing, personal, tokens

_PARTS = [authorship, parsing, descriptions, tokens, leaks, personal]
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
