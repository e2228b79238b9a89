"""Training-data operators: tokenising, near-duplicates, packing, quality, extraction, licences, scoring, search.

Nothing else in the library imports this subpackage; `queries()` and `oracle_sql()` live in `llm.entry`.
"""
