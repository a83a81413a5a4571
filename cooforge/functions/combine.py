"""The five ways in which two values at one position become one.

``seq`` orders values that reach one position one after another; Spark rows have
no order of their own, so KEEP and OVW need it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = ("ADD", "KEEP", "MAX", "MIN", "OVW")


def _known(rule: str) -> str:
    rule = rule.upper()
    if rule not in RULES:
        raise ValueError(f"unknown combiner {rule}; one of {', '.join(RULES)}")
    return rule


def combine_all(rule: str, value: str = "v", seq: str = "seq") -> Column:
    """Aggregate of all values at a position. All forms combine on the map side."""
    rule = _known(rule)
    if rule == "ADD":
        return F.sum(value)
    if rule == "MAX":
        return F.max(value)
    if rule == "MIN":
        return F.min(value)
    return F.min_by(value, seq) if rule == "KEEP" else F.max_by(value, seq)


def combine_two(rule: str, old: Column, new: Column) -> Column:
    """One value from two that may be missing (null)."""
    rule = _known(rule)
    if rule == "ADD":
        return F.coalesce(old, F.lit(0.0)) + F.coalesce(new, F.lit(0.0))
    if rule == "MAX":
        return F.greatest(old, new)
    if rule == "MIN":
        return F.least(old, new)
    return F.coalesce(old, new) if rule == "KEEP" else F.coalesce(new, old)
