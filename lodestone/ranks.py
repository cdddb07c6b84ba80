"""Ordered codes of the policy lattices, and roll-ups over them.

Two orders of the unified decision exist on purpose: a text run ranks them by
declaration, the audio bridge puts quarantine below review.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank orders, lowest first.
SEVERITY = ["low", "medium", "high", "critical"]
DISPOSITION = ["P0", "P1", "P2", "P3", "P4", "P5"]
CONTENT_RISK = ["C0", "C1", "C2", "C3"]
SENSITIVITY = ["S1", "S2", "S3", "S4"]
TRAINING = ["T0", "T1", "T2", "T3"]
DECISION_RUN = ["allow", "review", "quarantine", "reject"]
DECISION_AUDIO = ["allow", "quarantine", "review", "reject"]

# Severity weights, and what a disposition means.
SEVERITY_WEIGHT = {"low": 0.30, "medium": 0.55, "high": 0.80, "critical": 1.00}
DISPOSITION_RISK = {"P0": 0.05, "P1": 0.30, "P2": 0.55, "P3": 0.72, "P4": 0.92, "P5": 1.00}
DISPOSITION_DECISION = {"P0": "allow", "P1": "allow", "P2": "quarantine", "P3": "review", "P4": "reject", "P5": "reject"}


def lookup(col: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, as one expression."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def rank(col: Column, order: list[str]) -> Column:
    """Place in an order; codes outside it rank 0."""
    return lookup(col, {c: i for i, c in enumerate(order)}, 0)


def code(rank_: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in order]), rank_ + 1)


def highest(col: Column, order: list[str]) -> Column:
    """Aggregate: the highest code."""
    return F.max_by(col, rank(col, order))
