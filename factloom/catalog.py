"""Every query of the engine's own operators, with its DuckDB twin."""

from __future__ import annotations

from factloom.plans import corpora, diffs, durable, extras, ordered, relational, twins

MODULES = (relational, twins, ordered, corpora, diffs, durable, extras)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: text for m in MODULES for name, text in m.ORACLES.items()}
