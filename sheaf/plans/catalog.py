"""Registry of all named queries and their DuckDB SQL."""

from __future__ import annotations

from . import analytics  # noqa: F401  registers its queries
from . import documents  # noqa: F401
from . import sources  # noqa: F401
from .retrieval import ORACLES, QUERIES

FLAGSHIP = "evidence_gate_select"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
