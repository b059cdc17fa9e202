"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from . import bpe, chat, decontaminate, exact_dedup, hard_negatives, language, merkle, near_dedup, pii, substring_dedup, token_counts, url_filter, warc

_MODULES = (decontaminate, url_filter, bpe, chat, near_dedup, exact_dedup, language, pii, substring_dedup, warc, token_counts, merkle, hard_negatives)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
