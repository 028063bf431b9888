"""The corpus pipeline: its stages are in webgauge.llm.pipeline."""

from __future__ import annotations

from webgauge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
