"""How often each join key occurs: in one table, per site, and over all sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import quoted
from .keys import as_list


def key_frequencies(df: DataFrame, keys: str | Sequence[str], *, name: str = "count") -> DataFrame:
    """Rows per key.  The scan reads the key columns only; NULL is one group."""
    return df.groupBy(*map(quoted, as_list(keys))).agg(F.count(F.lit(1)).alias(name))


def site_key_frequencies(
    df: DataFrame, keys: str | Sequence[str], *, site: str = "site", name: str = "count"
) -> DataFrame:
    """Rows per site and key: what one site sends to the coordinator."""
    return df.groupBy(quoted(site), *map(quoted, as_list(keys))).agg(F.count(F.lit(1)).alias(name))


def merge_key_frequencies(
    site_counts: DataFrame, keys: str | Sequence[str], *, name: str = "count"
) -> DataFrame:
    """Global rows per key from the counts of all sites."""
    return site_counts.groupBy(*map(quoted, as_list(keys))).agg(
        F.sum(quoted(name)).alias(name)
    )


def shared_key_counts(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    *,
    name: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """``keys, n_left, n_right`` for the keys that occur in both tables.

    The inputs are the tables themselves, or with ``name`` their (partial) key
    counts.  Both are stacked and aggregated in one pass: one shuffle of
    pre-aggregated counts, and no join.  A NULL key counts only if ``null_safe``.
    """
    keys = list(map(quoted, as_list(keys)))
    seen = F.lit(1).cast("long") if name is None else F.col(quoted(name))
    none = F.lit(0).cast("long")
    stacked = left.select(*keys, seen.alias("n_left"), none.alias("n_right")).unionAll(
        right.select(*keys, none.alias("n_left"), seen.alias("n_right"))
    )
    if not null_safe:
        # Written as a join would infer it, so that all uses share one shuffle.
        stacked = stacked.filter(" and ".join(f"{k} is not null" for k in keys))
    summed = stacked.groupBy(*keys).agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")
    )
    return summed.filter((F.col("n_left") > 0) & (F.col("n_right") > 0))
