"""The corpus pipeline: toxicity, near-dedup, decontamination, secret scan, packing. Its stages are in quern.llm.pipeline."""

from quern.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
