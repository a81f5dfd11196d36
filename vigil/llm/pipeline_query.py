"""Registers the corpus pipeline of the repository's top folder as a query."""

from __future__ import annotations

import corpus_pipeline
from vigil.llm.oracles import ORACLES
from vigil.llm.queries import QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
