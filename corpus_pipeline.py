"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from registrum.llm.pipeline import STAGES, run

#: Fingerprints, alignment and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
