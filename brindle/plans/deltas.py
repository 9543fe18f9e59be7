"""How the rows of a workload arrive: sizes of deltas by mode, and tables split accordingly."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table per row of lineitem's share, smallest delta, most deltas of the binomial mode.
AMPLIFICATION = {"orders": 0.25, "partsupp": 4.0}
LEAST, MOST = 0.000999, 10


@dataclass
class DeltaPlan:
    """By refresh, the share of each table's rows that arrives then; the rest is the batch."""

    shares: list[dict[str, float]]

    def batch_share(self, table: str) -> float:
        return max(0.0, 1 - sum(s.get(table, 0.0) for s in self.shares))


def delta_plan(mode: str, tables: list[str], count: int = 1, size: float = 0.01, probability: float = 0.5, seed: int = 0) -> DeltaPlan:
    """uniform: every table in every delta. decay: as many deltas as tables, table i in delta j if i >= j.
    binomial: sizes shrink by ``probability`` down to 0.0999 %, ten at most. default: a random non-empty set of tables each time."""
    if mode == "uniform":
        return DeltaPlan([{t: size for t in tables} for _ in range(count)])
    if mode == "decay":
        return DeltaPlan([{t: size for i, t in enumerate(tables) if i >= j} for j in range(len(tables))])
    if mode == "binomial":
        shares, now = [], size
        while now >= LEAST and len(shares) < MOST:
            shares.append({t: now for t in tables})
            now *= probability
        return DeltaPlan(shares)
    if mode == "default":
        rng = random.Random(seed)
        shares = []
        for _ in range(count):
            some = [t for t in tables if rng.random() < 0.5] or [rng.choice(tables)]
            shares.append({t: size for t in some})
        return DeltaPlan(shares)
    raise ValueError(f"unknown mode {mode}")


def has_delta(rows: float, table: str, share: float) -> bool:
    """Whether a delta of that share has a row at all, by the table's rows and amplification."""
    return rows * share * AMPLIFICATION.get(table, 1.0) >= 1


def split(df: DataFrame, table: str, key: str, plan: DeltaPlan, seed: int = 0) -> tuple[DataFrame, list[DataFrame | None]]:
    """(batch, deltas): each row goes to one of them by a hash of its key; None where a delta leaves the table out."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    at = plan.batch_share(table)
    batch, out = df.where(bucket < at), []
    for s in plan.shares:
        share = s.get(table, 0.0)
        out.append(df.where((bucket >= at) & (bucket < at + share)) if share else None)
        at += share
    return batch, out
