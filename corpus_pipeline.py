"""The corpus pipeline of docquill.llm: STAGES, run and ORACLE_SQL."""

from docquill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
