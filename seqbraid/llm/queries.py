"""All queries of this subpackage."""

from __future__ import annotations

import importlib

from seqbraid.llm.registry import ORACLES, QUERIES

for _family in ("q_toxicity", "q_native", "q_filters", "q_tokens", "q_search"):
    importlib.import_module(f"seqbraid.llm.{_family}")

__all__ = ["ORACLES", "QUERIES"]
