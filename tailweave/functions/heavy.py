"""Joins of many rows with one fact a key, for keys that very many rows share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if more than LEAST_HEAVY rows have it, and more than a MOST_HEAVY-th of all.
LEAST_HEAVY, MOST_HEAVY = 256, 100_000


def met(rows: DataFrame, facts: DataFrame, keys: Sequence[str], n_col: str, total: int) -> DataFrame:
    """rows with the columns of facts, an inner join on keys.  facts: one row a key, n_col saying how many of the ``total`` rows have it.

    Heavy keys come by a broadcast of at most MOST_HEAVY facts, so their rows don't move; the others are shuffled.
    """
    keys = list(keys)
    heavy, k, others = F.col(n_col) > max(LEAST_HEAVY, total // MOST_HEAVY), "__heavy", [c for c in facts.columns if c not in keys]
    while k in rows.columns:
        k += "_"
    tagged = rows.join(F.broadcast(facts.where(heavy).select(*keys, F.struct(*others).alias(k))), keys, "left")  # at most MOST_HEAVY rows
    told = tagged.where(F.col(k).isNotNull()).select(*rows.columns, *[F.col(f"{k}.{c}") for c in others])
    rest = tagged.where(F.col(k).isNull()).select(*rows.columns).join(facts.where(~heavy), keys)
    return told.unionByName(rest)
