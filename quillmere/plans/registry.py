"""Registered queries of the corpus, retrieval, evaluation and record operators, and the SQL that gives the same rows."""

from __future__ import annotations

from quillmere.plans import answers, audit, contract, corpus, evaluation, operations, packets, records, retrieval, scale

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (corpus, retrieval, answers, evaluation, packets, records, audit, operations, scale, contract):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
