"""Proof that a phase result is complete: a manifest, written last, that readers check.

A result's rows are counted and hashed while they are written.  When the write
has committed, these numbers go to a folder ``_manifest`` inside the result, which
scans of the result do not see.  Overwriting a result removes its manifest first,
so a result without one was never finished, and one whose rows do not have the
numbers of its manifest was changed afterwards.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import quoted
from ..sources.sites import rendered_bytes

FOLDER = "_manifest"
FIELDS = "path string, columns string, n_rows long, n_bytes long, check array<long>"

#: Bits of a row's hash that one of the sums takes: 4e12 rows fit a BIGINT.
SUM_BITS = 21


class IncompletePhase(ValueError):
    """A phase result that was not finished, or does not hold what was written."""


def check_sums(columns: Sequence[str]) -> Column:
    """Three sums of a row hash: the same for the same rows in any order, with repeats.

    Nulls are hashed as such; Spark's hash passes over them.
    """
    parts = [p for c in columns for p in (F.col(quoted(c)), F.col(quoted(c)).isNull())]
    row = F.xxhash64(*parts)
    mask = (1 << SUM_BITS) - 1
    sums = [
        F.coalesce(F.sum(F.shiftrightunsigned(row, SUM_BITS * i).bitwiseAND(mask)), F.lit(0))
        for i in range(3)
    ]
    return F.array(*sums)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with the numbers of its manifest; read ``observation.get`` after the write."""
    seen = Observation(name)
    return (
        df.observe(
            seen,
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(rendered_bytes(df)), F.lit(0)).alias("n_bytes"),
            check_sums(df.columns).alias("check"),
        ),
        seen,
    )


def column_text(schema: StructType) -> str:
    """Names and types, as a manifest holds them."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def write_manifest(df: DataFrame, path: str, numbers: Mapping[str, object]) -> None:
    """The last step of a write: until this commits, the result does not count."""
    line = df.sparkSession.range(1, numPartitions=1).select(
        F.lit(path).alias("path"),
        F.lit(column_text(df.schema)).alias("columns"),
        F.lit(numbers["n_rows"]).cast("long").alias("n_rows"),
        F.lit(numbers["n_bytes"]).cast("long").alias("n_bytes"),
        F.array(*map(F.lit, numbers["check"])).cast("array<long>").alias("check"),
    )
    line.write.mode("overwrite").json(f"{path}/{FOLDER}")


def read_manifest(spark: SparkSession, path: str) -> dict[str, object]:
    """The manifest of one result; ``IncompletePhase`` where there is none."""
    try:
        rows = spark.read.schema(FIELDS).json(f"{path}/{FOLDER}").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if len(rows) != 1 or rows[0].n_rows is None:
        raise IncompletePhase(f"{path} has no manifest: its phase has not run, or not to its end")
    return rows[0].asDict()


def verify(
    rows: DataFrame, manifests: Sequence[Mapping[str, object]], site: str | None = None
) -> None:
    """Compare rows as read with the manifests of the results they come from.

    One pass over the rows, which sends one line per task and result.  ``site``
    is the column that numbers the results, in the order of ``manifests``.
    """
    columns = [c for c in rows.columns if c != site]
    have = column_text(rows.select(*map(quoted, columns)).schema)
    for manifest in manifests:
        if manifest["columns"] != have:
            raise IncompletePhase(
                f"{manifest['path']} holds ({manifest['columns']}), read as ({have})"
            )
    which = F.lit(0) if site is None else F.col(quoted(site)).cast("int")
    found = {
        r.which: (r.n_rows, list(r.check))
        for r in rows.groupBy(which.alias("which"))
        .agg(F.count(F.lit(1)).alias("n_rows"), check_sums(columns).alias("check"))
        .collect()
    }
    wrong = [
        f"{m['path']}: written {m['n_rows']} rows, {found.get(i, (0, []))[0]} read"
        for i, m in enumerate(manifests)
        if found.get(i, (0, [0, 0, 0])) != (m["n_rows"], list(m["check"]))
    ]
    if wrong or functools.reduce(operator.or_, (i >= len(manifests) for i in found), False):
        raise IncompletePhase("rows are not those that were written: " + "; ".join(wrong))


def phase_report(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, columns, n_rows, n_bytes, check`` of finished results, as one table."""
    for path in paths:
        read_manifest(spark, path)
    return spark.read.schema(FIELDS).json([f"{path}/{FOLDER}" for path in paths])
