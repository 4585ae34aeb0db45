"""The corpus pipeline; its stages are in the training-data subpackage."""

from lattica.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
