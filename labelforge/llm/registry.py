"""Queries and SQL oracles of the training-data operators, by name.

Importing this module registers everything in :mod:`labelforge.llm.queries` and
:mod:`labelforge.llm.corpus_queries`.
"""

from __future__ import annotations

from labelforge.llm import corpus_queries  # noqa: F401  (registers its queries)
from labelforge.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
