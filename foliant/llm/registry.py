"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from foliant.llm import collocations, decontaminate, langid, licenses, mixing, neardup, pii, quality, secrets, substrings, topk, toxicity, whitening

MODULES = (licenses, secrets, toxicity, pii, quality, mixing, neardup, decontaminate, topk, substrings, whitening, collocations, langid)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
