"""Join keys, row ids and the reserved column names."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_bits, quoted, row_text

JoinKeys = str | Sequence[str | tuple[str, str]]

#: Columns the operators add; inputs must not use these names.
RESERVED = ("n_left", "n_right", "own_count", "weight", "copies", "copy", "slot")


def align_keys(
    left: DataFrame,
    right: DataFrame,
    on: JoinKeys,
    right_id: str | Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame, list[str] | None, list[str]]:
    """Rename the key columns of ``right`` to those of ``left``; give both one type.

    ``on`` is a column name, or a list of names and ``(left, right)`` pairs.
    Returns both tables, the id columns of the right one, and the key columns.
    Keys of unequal type get their common type, the one that a union has: rows
    are hashed by key, and an INT has not the hash of the same BIGINT.
    """
    entries = [on] if isinstance(on, str) else list(on)
    pairs = [(e, e) if isinstance(e, str) else tuple(e) for e in entries]
    if not pairs:
        raise ValueError("`on` names no key column")
    for name, other in pairs:
        if name not in left.columns:
            raise ValueError(f"left has no key column {name!r}")
        if other not in right.columns:
            raise ValueError(f"right has no key column {other!r}")
        if name != other and name in right.columns:
            raise ValueError(f"right already has a column {name!r} besides its key {other!r}")
    names = {other: name for name, other in pairs}
    ids = None if right_id is None else [names.get(c, c) for c in as_list(right_id)]
    renamed = right.withColumnsRenamed({o: n for o, n in names.items() if o != n})
    keys = [name for name, _ in pairs]
    both = left.select(*map(quoted, keys)).unionAll(renamed.select(*map(quoted, keys)))
    return cast_keys(left, both, keys), cast_keys(renamed, both, keys), ids, keys


def cast_keys(rows: DataFrame, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with key columns of the types they have in ``like``."""
    types = {k: like.schema[k].dataType for k in keys}
    casts = {k: F.col(quoted(k)).cast(t) for k, t in types.items() if rows.schema[k].dataType != t}
    return rows.withColumns(casts) if casts else rows


def check_columns(df: DataFrame, label: str) -> None:
    taken = [c for c in df.columns if c in RESERVED or c.startswith("_")]
    if taken:
        raise ValueError(f"{label} uses reserved column names: {taken}")


def check_fraction(fraction: float) -> float:
    value = float(fraction)
    if not (0.0 <= value < float("inf")):
        raise ValueError(f"fraction must be a finite number >= 0, not {fraction!r}")
    return value


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def join_keys(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    null_safe: bool = False,
    how: str = "inner",
    unrolled: bool = False,
) -> DataFrame:
    """Equi-join that keeps one copy of the keys; NULL meets NULL if asked.

    ``unrolled`` says that a side holds copies, or is counted from them.  Spark takes
    the size of such a side from the sample before it was unrolled, and would
    broadcast through the driver what may be thousands of times as large; it is
    asked for a merge join.
    """
    if unrolled:
        right = right.hint("merge")
    if not null_safe:
        return left.join(right, list(keys), how)
    theirs = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(theirs)
    same = [F.col(quoted(k)).eqNullSafe(F.col(t)) for k, t in theirs.items()]
    return left.join(right, functools.reduce(operator.and_, same), how).drop(*theirs.values())


def identify_rows(
    df: DataFrame, ids: str | Sequence[str] | None
) -> tuple[DataFrame, list[str]]:
    """Rows with a ``_rows`` multiplicity, and the columns that identify them.

    Without ids, equal rows are folded into one row that counts them.  The sum
    of m Poisson numbers of mean x is a Poisson number of mean m*x, so one draw
    for the folded row has the law of m single draws.  The fold pre-aggregates
    before its shuffle, so a group of copies of any size costs little.

    Ids must tell rows apart.  They are not counted, which would cost a shuffle:
    rows with the same id draw alike, so a repeated id makes the sample lumpy.
    ``repeated_ids`` lists those that occur twice or more.
    """
    if ids is not None:
        names = as_list(ids)
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise ValueError(f"no such id columns: {missing}")
        return df.withColumn("_rows", F.lit(1).cast("long")), names
    folded = df.groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("_rows"))
    return digest_rows(folded, df.columns)


def repeated_ids(df: DataFrame, ids: str | Sequence[str]) -> DataFrame:
    """Ids that occur more than once, with their ``count``: no rows if ids are unique."""
    return df.groupBy(*map(quoted, as_list(ids))).count().filter("`count` > 1")


def digest_rows(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Identify rows by 104 bits of a digest of ``columns``."""
    digested = df.withColumn("_digest", F.expr(f"md5({row_text(columns)})"))
    parts = {"_id": F.expr(digest_bits("_digest", 0)), "_id2": F.expr(digest_bits("_digest", 1))}
    return digested.withColumns(parts).drop("_digest"), list(parts)
