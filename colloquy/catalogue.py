"""Every query of the engine by name, and the SQL that DuckDB answers it with."""

from __future__ import annotations

from colloquy.plans import artifacts, attributes, directory, drafts, evidence, kernels, naming, planning, relational, review, routing, transcript, vectors, views, voices

_PLANS = (transcript, vectors, evidence, relational, review, kernels, directory, attributes, views, drafts, planning, artifacts, routing, naming, voices)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
