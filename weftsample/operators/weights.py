"""Attach to every row how many rows of the other table share its key.

The join is many-to-one, from a table of any size to the table of key counts.
One small broadcast table keeps it cheap and even: the *guide* holds the largest
count of each table in each hash bucket of the key, at most ``KEY_BUCKETS`` rows
whatever the data.

* Rows of other buckets have no partner, and a caller that can tell from an upper
  bound of the weight that a row is not needed drops it; both before the shuffle.
* With many shared keys every bucket has a partner for some key; a bit set of the
  shared keys (``bitsets``) then drops rows whose own key has none.
* Keys of a bucket with more than ``part_rows`` rows of one key are spread over
  several parts, and their counts are repeated once per part.

Left and right rows use the same two tables (guide, counts by part), so Spark
computes each of them once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import KEY_BUCKETS, key_bucket, key_hash, quoted
from .bitsets import bit_set, members_of
from .keys import cast_keys, join_keys

# Fixed values.
PART_ROWS = 4_000_000  # rows of one key that one task may get

GUIDED_KEYS = KEY_BUCKETS // 16  # up to so many shared keys leave 15 of 16 buckets empty

SIDES = {"left": ("n_left", "n_right"), "right": ("n_right", "n_left")}


def attach_weights(
    rows: DataFrame,
    counts: DataFrame,
    keys: Sequence[str],
    side: str,
    *,
    ids: Sequence[str],
    keep: Callable[[str], str] | None = None,
    null_safe: bool = False,
    part_rows: int = PART_ROWS,
    shared: int | None = None,
) -> DataFrame:
    """Rows whose key occurs in both tables, with ``weight`` and ``own_count``.

    ``counts`` is the output of ``shared_key_counts``; the keys take the types they
    have there.  ``keep`` turns an upper bound of the weight into a predicate; rows
    that fail it are dropped early.  ``shared``, the number of rows of ``counts``
    where the caller knows it, lets a bit set drop keys without a partner.
    """
    own, other = SIDES[side]
    rows = cast_keys(rows, counts, keys)
    if shared is not None:
        rows = near_keys(rows, counts, keys, shared=shared)
    bucketed = counts.withColumn("_bucket", key_bucket(counts, keys))
    guide = bucketed.groupBy("_bucket").agg(
        F.expr("array(max(n_left), max(n_right)) as _bounds")
    )
    placed = rows.withColumn("_bucket", key_bucket(rows, keys)).join(F.broadcast(guide), "_bucket")
    if keep is not None:
        placed = placed.filter(keep(f"_bounds[{0 if other == 'n_left' else 1}]"))
    names = ", ".join(map(quoted, ids))
    parts = f"cast(ceil(greatest(_bounds[0], _bounds[1]) / {float(part_rows)!r}D) as bigint)"
    part = f"if({parts} > 1, pmod(xxhash64({names}), {parts}), 0L)"
    placed = placed.withColumn("_part", F.expr(part)).drop("_bucket", "_bounds")

    by_part = bucketed.join(F.broadcast(guide), "_bucket").withColumn(
        "_part", F.expr(f"explode(sequence(0L, {parts} - 1L))")
    )
    return (
        join_keys(placed, by_part.drop("_bucket", "_bounds"), [*keys, "_part"], null_safe=null_safe)
        .drop("_part")
        .withColumnsRenamed({own: "own_count", other: "weight"})
    )


def near_keys(
    rows: DataFrame,
    counts: DataFrame,
    keys: Sequence[str],
    *,
    shared: int,
    guided: int = GUIDED_KEYS,
) -> DataFrame:
    """Rows whose key is one of the ``shared`` keys of ``counts``, and few others.

    With up to ``guided`` shared keys the guide tells as much, and the rows stay as
    they are; 0 is for rows that are shuffled before they meet it.
    """
    if shared <= guided and guided:
        return rows
    pages = bit_set(counts.select(key_hash(counts, keys).alias("hash")), "hash", shared)
    return members_of(rows, key_hash(rows, keys), pages, shared)


def attach_large_weights(
    rows: DataFrame,
    counts: DataFrame,
    keys: Sequence[str],
    side: str,
    *,
    is_large: str,
    null_safe: bool = False,
) -> DataFrame:
    """``attach_weights`` for the rows of large keys alone.

    Their buckets, at most ``KEY_BUCKETS`` numbers, are broadcast to drop all
    other rows before the shuffle; the list of large keys itself grows with the
    data and is not.
    """
    own, other = SIDES[side]
    rows = cast_keys(rows, counts, keys)
    large = counts.filter(is_large).select(*map(quoted, keys), "n_left", "n_right")
    buckets = large.select(key_bucket(large, keys).alias("_bucket")).distinct()
    near = rows.withColumn("_bucket", key_bucket(rows, keys))
    near = near.join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")
    return join_keys(near, large, keys, null_safe=null_safe).withColumnsRenamed(
        {own: "own_count", other: "weight"}
    )


def exceeds(rows: int) -> str:
    """Predicate on shared key counts: more rows than this in one of the tables."""
    return f"greatest(n_left, n_right) > {int(rows)}L"
