"""Import every module that registers queries."""

from tessera.plans import q_memory, q_more, q_plan, q_retrieve, q_text, q_video  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
