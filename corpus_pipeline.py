"""The corpus pipeline under the name that the driver looks for; its stages are in granary.llm.pipeline."""

from granary.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, encode, keep_good, near_dedup, reject_toxic, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "encode", "keep_good", "near_dedup", "reject_toxic", "run"]
