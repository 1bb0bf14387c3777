"""The sampled join as jobs over files: all at once, or in four phases.

========  =================  ==============================================
phase     runs               reads -> writes
========  =================  ==============================================
count     once per site      site tables -> key counts of the site
merge     once               key counts of all sites -> global key counts
sample    once per site      site tables, global counts -> sampled rows
join      once               sampled rows of all sites -> sampled join
========  =================  ==============================================

Phase results live under one root, told apart by ``table=``, ``sites=`` (how many
there are), ``site=`` and, where they depend on it, ``fraction=``, ``seed=`` and
``null_safe=`` directories.  The coordinator reads the results of exactly the
sites 0 to ``sites`` - 1.  Each result ends with a manifest (see
``plans.manifests``); one that has none, or whose rows are not those that were
written, raises ``IncompletePhase`` before anything is written.  Every job returns
the rows and bytes it wrote, and appends them to ``metrics`` if that path is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, LongType, StructType

from ..functions.hashing import quoted
from ..operators.frequencies import merge_key_frequencies, shared_key_counts, site_key_frequencies
from ..operators.keys import as_list, cast_keys, digest_rows, identify_rows
from ..operators.pairing import pair_on_slot
from ..operators.weights import near_keys
from ..sources.sites import (
    TABLE_SCHEMA,
    read_sites,
    read_sites_counted,
    read_table,
    stored,
    write_table,
)
from .manifests import observed, read_manifest, verify, write_manifest
from .sampling import Settings, join_sample, site_samples, zip_slots

TABLES = (0, 1)
SIDE = {0: "left", 1: "right"}
Metrics = list[dict[str, object]]
Names = str | Sequence[str]


def run_centralized(
    spark: SparkSession,
    prefix: str,
    out: str,
    *,
    sites: int,
    fraction: float,
    seed: int = 0,
    schema: StructType = TABLE_SCHEMA,
    key: Names = "key",
    ids: Names | None = None,
    fmt: str = "csv",
    method: str = "zip",
    null_safe: bool = False,
    metrics: str | None = None,
) -> Metrics:
    """Read both tables of all sites and write their sampled join."""
    left, right = (read_sites(spark, prefix, t, sites, schema=schema) for t in TABLES)
    names = _row_ids(schema, ids)
    pairs = join_sample(
        left, right, _keys(schema, key), fraction, seed=seed, left_id=names, right_id=names,
        method=method, null_safe=null_safe,
    ).drop("site_1", "site_2")
    return _save(spark, [("join", None, None, pairs, out)], fmt, metrics)


def run_count(
    spark: SparkSession,
    prefix: str,
    root: str,
    *,
    site: int,
    sites: int,
    schema: StructType = TABLE_SCHEMA,
    key: Names = "key",
    fmt: str = "parquet",
    metrics: str | None = None,
) -> Metrics:
    """Phase 1, at one site: how often each key occurs in its tables.

    The first pass over the files also counts their lines, and those among them
    that do not fit the schema: ``n_lines`` and ``n_malformed``.
    """
    outputs = []
    for t in TABLES:
        rows, lines = read_sites_counted(spark, prefix, t, sites, schema=schema, only=site)
        counts = site_key_frequencies(rows, _keys(schema, key)).drop("site")
        path = _path(root, "site_counts", t, sites=sites, site=site)
        outputs.append(("count", t, site, counts, path, lines))
    return _save(spark, outputs, fmt, metrics)


def run_merge(
    spark: SparkSession,
    root: str,
    *,
    sites: int,
    schema: StructType = TABLE_SCHEMA,
    key: Names = "key",
    fmt: str = "parquet",
    metrics: str | None = None,
) -> Metrics:
    """Phase 2, at the coordinator: add up the counts of all sites."""
    outputs = []
    for t in TABLES:
        counts = _read_sites(spark, root, "site_counts", t, fmt, _count_schema(schema, key), sites=sites)
        merged = merge_key_frequencies(counts, _keys(schema, key))
        outputs.append(("merge", t, None, merged, _path(root, "global_counts", t, sites=sites)))
    return _save(spark, outputs, fmt, metrics)


def run_sample(
    spark: SparkSession,
    prefix: str,
    root: str,
    *,
    site: int,
    sites: int,
    fraction: float,
    seed: int = 0,
    schema: StructType = TABLE_SCHEMA,
    key: Names = "key",
    ids: Names | None = None,
    fmt: str = "parquet",
    null_safe: bool = False,
    metrics: str | None = None,
) -> Metrics:
    """Phase 3, at one site: draw copies of its rows, weighted by the global counts.

    ``ids`` name columns that tell the rows of a site apart; without them equal
    rows are folded first, which shuffles whole rows.
    """
    keys, names = _keys(schema, key), _row_ids(schema, ids)
    how = Settings(keys, fraction, seed, null_safe)
    left, right = (
        _read_whole(
            spark, _path(root, "global_counts", t, sites=sites), fmt, _count_schema(schema, key)
        )
        for t in TABLES
    )
    counts = shared_key_counts(left, right, keys, name="count", null_safe=null_safe)
    counts = stored(counts, "counts")
    shared = how.knowing(counts).shared
    drawn = dict(fraction=fraction, seed=seed, null_safe=null_safe)
    outputs = []
    for t in TABLES:
        rows = read_sites(spark, prefix, t, sites, schema=schema, only=site)
        # Equal rows have one key: those without a partner need not be folded.
        rows = near_keys(cast_keys(rows, counts, keys), counts, keys, shared=shared, guided=0)
        rows, known_by = identify_rows(rows, names)
        sample = site_samples(rows, counts, how, SIDE[t], known_by).select(
            *map(quoted, schema.names), "weight", "own_count", "copies"
        )
        path = _path(root, "samples", t, sites=sites, **drawn, site=site)
        outputs.append(("sample", t, site, sample, path))
    return _save(spark, outputs, fmt, metrics)


def run_join(
    spark: SparkSession,
    root: str,
    out: str,
    *,
    sites: int,
    fraction: float,
    seed: int = 0,
    schema: StructType = TABLE_SCHEMA,
    key: Names = "key",
    ids: Names | None = None,
    fmt: str = "parquet",
    out_fmt: str = "csv",
    null_safe: bool = False,
    metrics: str | None = None,
) -> Metrics:
    """Phase 4, at the coordinator: pair the sampled rows of all sites."""
    keys, names = _keys(schema, key), _row_ids(schema, ids)
    how = Settings(keys, fraction, seed, null_safe)
    sample_schema = StructType(list(schema.fields))
    for name in ("weight", "own_count", "copies"):
        sample_schema = sample_schema.add(name, LongType())
    values = [c for c in schema.names if c not in keys]
    slotted = []
    for t in TABLES:
        sample = _read_sites(
            spark, root, "samples", t, fmt, sample_schema,
            sites=sites, fraction=fraction, seed=seed, null_safe=null_safe,
        )
        # As in phase 3, a row is known by its ids or its values, and its site.
        if names is None:
            sample, known_by = digest_rows(sample, [*schema.names, "site"])
        else:
            known_by = names
        slotted.append(zip_slots(sample, how, SIDE[t], known_by))
    pairs = pair_on_slot(
        *slotted, keys, left_values=values, right_values=values, null_safe=null_safe
    )
    return _save(spark, [("join", None, None, pairs, out)], out_fmt, metrics)


def _path(root: str, phase: str, table: int, **levels: object) -> str:
    return "/".join([root, phase, f"table={table}", *(f"{k}={v!r}" for k, v in levels.items())])


def _read_sites(
    spark: SparkSession,
    root: str,
    phase: str,
    table: int,
    fmt: str,
    schema: StructType,
    *,
    sites: int,
    **levels: object,
) -> DataFrame:
    """One phase result of all sites as one scan; sites come back as a column.

    A site without a complete result is an error, and results of other sites are
    not read.
    """
    base = _path(root, phase, table, sites=sites, **levels)
    paths = [f"{base}/site={p}" for p in range(sites)]
    manifests = [read_manifest(spark, path) for path in paths]
    schema = StructType(list(schema.fields)).add("site", IntegerType())
    rows = read_table(spark, paths, fmt, schema, escaped=True, base=base)
    verify(rows, manifests, "site")
    return rows


def _read_whole(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    manifest = read_manifest(spark, path)
    rows = read_table(spark, path, fmt, schema, escaped=True)
    verify(rows, [manifest])
    return rows


def _keys(schema: StructType, key: Names) -> list[str]:
    keys = as_list(key)
    missing = [k for k in keys if k not in schema.names]
    if missing or not keys:
        raise ValueError(f"no such key columns: {missing}" if keys else "no key columns")
    return keys


def _row_ids(schema: StructType, ids: Names | None) -> list[str] | None:
    """Columns that tell all rows apart: those that do so at one site, and the site."""
    if ids is None:
        return None
    missing = [c for c in as_list(ids) if c not in schema.names]
    if missing:
        raise ValueError(f"no such id columns: {missing}")
    return [*as_list(ids), "site"]


def _count_schema(schema: StructType, key: Names) -> StructType:
    return StructType([schema[k] for k in _keys(schema, key)]).add("count", LongType())


def _save(
    spark: SparkSession,
    outputs: Sequence[tuple],
    fmt: str,
    metrics: str | None,
) -> Metrics:
    """Write ``(phase, table, site, rows, path)``, with an observation of their input or none."""
    written: Metrics = []
    for phase, table, site, df, path, *lines in outputs:
        counted, seen = observed(df, f"{phase}-{table}-{site}")
        write_table(counted, path, fmt, escaped=phase != "join")
        write_manifest(df, path, seen.get)
        size = {k: seen.get[k] for k in ("n_rows", "n_bytes")}
        size |= {k: lines[0].get[k] if lines else None for k in ("n_lines", "n_malformed")}
        written.append({"phase": phase, "table": table, "site": site, "path": path, **size})
    if metrics is not None:
        fields = (
            "phase string, table int, site int, path string, n_rows long, n_bytes long, "
            "n_lines long, n_malformed long"
        )
        lines = [tuple(w.values()) for w in written]
        spark.createDataFrame(lines, fields).coalesce(1).write.mode("append").json(metrics)
    return written
