"""Operations of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= module.SQL
    return out


def _modules() -> list:
    from . import alignment, chat, collocations, decontamination, licenses, mixing, neighbours, ngram_join, packing, quality, repeats, token_counts

    return [repeats, neighbours, decontamination, licenses, ngram_join, token_counts, chat, quality, mixing, collocations, packing, alignment]
