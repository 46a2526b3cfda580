"""Cleaning pipeline over ``documents``; its stages are in the subpackage."""

from braidwork.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
