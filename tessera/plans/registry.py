"""Every registered query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import acquisition, activity, documents, eligibility, evaluation, flows, hwpx, ingest, layout, parsing, programs, retrieval, storage, tables

FLAGSHIP = "hybrid_rrf"
PARTS = (programs, retrieval, ingest, documents, eligibility, evaluation, layout, activity, parsing, tables, acquisition, flows, storage, hwpx)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
