"""The queries of the corpus operators."""

from __future__ import annotations

from . import ann, bpe, imatch, langid, lines, media, merkle, mixing, nearjoin, quality, substrings, tokens, whitening

MODULES = (tokens, media, mixing, nearjoin, lines, bpe, quality, ann, langid, substrings, imatch, merkle, whitening)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES if hasattr(m, "oracle_sql") for k, v in m.oracle_sql().items()}
