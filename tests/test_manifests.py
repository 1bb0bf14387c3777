"""A phase result counts only if it is finished and as it was written."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from weftsample.plans import jobs
from weftsample.plans.manifests import (
    IncompletePhase,
    check_sums,
    observed,
    phase_report,
    read_manifest,
    verify,
    write_manifest,
)
from weftsample.sources import sites as files

SCHEMA = "key string, v string"
SITES, DRAW = 2, dict(fraction=0.5, seed=3)


@pytest.fixture
def phases(spark, tmp_path):
    """Two sites through counting; the prefix and the root."""
    for t in jobs.TABLES:
        rows = spark.range(60).selectExpr(
            "cast(id % 7 as string) as key", f"'{t}-' || id as v", "cast(id % 2 as int) as site"
        )
        prefix = files.write_sites(rows, f"{tmp_path}/tables", "small", t, SITES)
    schema = spark.createDataFrame([], SCHEMA).schema
    run = dict(sites=SITES, schema=schema)
    for p in range(SITES):
        jobs.run_count(spark, prefix, f"{tmp_path}/root", site=p, **run)
    return prefix, f"{tmp_path}/root", run


def part_files(folder):
    return sorted(glob.glob(f"{folder}/part-*"))


def counts_of(root, site, table=0):
    return jobs._path(root, "site_counts", table, sites=SITES, site=site)


def test_an_emptied_site_raises(spark, phases):
    prefix, root, run = phases
    for file in part_files(counts_of(root, 1)):
        os.remove(file)
    with pytest.raises(IncompletePhase, match="rows are not those"):
        jobs.run_merge(spark, root, **run)
    assert not os.path.exists(jobs._path(root, "global_counts", 0, sites=SITES))


def test_a_site_without_manifest_raises(spark, phases):
    """As a job leaves it that dies between the write and its end."""
    prefix, root, run = phases
    for file in glob.glob(f"{counts_of(root, 0)}/_manifest/part-*"):
        os.remove(file)
    with pytest.raises(IncompletePhase, match="no manifest"):
        jobs.run_merge(spark, root, **run)


def test_a_site_that_is_written_anew_has_no_manifest_until_the_end(spark, phases):
    prefix, root, run = phases
    rows = spark.read.parquet(counts_of(root, 0)).collect()
    assert read_manifest(spark, counts_of(root, 0))["n_rows"] == len(rows)
    files.write_table(spark.createDataFrame(rows), counts_of(root, 0))
    with pytest.raises(IncompletePhase, match="no manifest"):
        jobs.run_merge(spark, root, **run)


def test_edited_rows_raise(spark, phases, tmp_path):
    """The same number of rows with one count changed, under the old manifest."""
    prefix, root, run = phases
    folder = counts_of(root, 1, table=1)
    rows = spark.read.parquet(folder).collect()
    changed = spark.createDataFrame([(r.key, r["count"] + (r.key == "3")) for r in rows], "key string, count long")
    changed.coalesce(1).write.parquet(f"{tmp_path}/changed")
    for file in part_files(folder):
        os.remove(file)
    for hidden in glob.glob(f"{folder}/.part-*"):
        os.remove(hidden)
    os.rename(part_files(f"{tmp_path}/changed")[0], f"{folder}/part-0.parquet")
    with pytest.raises(IncompletePhase, match="rows are not those"):
        jobs.run_merge(spark, root, **run)


def test_later_phases_check_what_they_read(spark, phases, tmp_path):
    prefix, root, run = phases
    jobs.run_merge(spark, root, **run)
    jobs.run_sample(spark, prefix, root, site=0, **run, **DRAW)
    with pytest.raises(IncompletePhase, match="site=1 has no manifest"):
        jobs.run_join(spark, root, f"{tmp_path}/out", **run, **DRAW)
    jobs.run_sample(spark, prefix, root, site=1, **run, **DRAW)
    jobs.run_join(spark, root, f"{tmp_path}/out", **run, **DRAW, out_fmt="parquet")
    assert read_manifest(spark, f"{tmp_path}/out")["n_rows"] == spark.read.parquet(f"{tmp_path}/out").count()
    for file in part_files(jobs._path(root, "global_counts", 1, sites=SITES)):
        os.remove(file)
    with pytest.raises(IncompletePhase, match="global_counts"):
        jobs.run_sample(spark, prefix, root, site=0, **run, **DRAW)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_no_rows_are_a_complete_result(spark, phases, tmp_path, fmt):
    prefix, _, run = phases
    root, draw = f"{tmp_path}/other", dict(fraction=0.0, seed=3)
    for p in range(SITES):
        jobs.run_count(spark, prefix, root, site=p, fmt=fmt, **run)
    jobs.run_merge(spark, root, fmt=fmt, **run)
    for p in range(SITES):
        written = jobs.run_sample(spark, prefix, root, site=p, fmt=fmt, **run, **draw)
        assert [w["n_rows"] for w in written] == [0, 0]
    joined = jobs.run_join(spark, root, f"{tmp_path}/out", fmt=fmt, out_fmt=fmt, **run, **draw)
    assert joined[0]["n_rows"] == 0


def test_other_columns_raise(spark, phases):
    prefix, root, run = phases
    rows = spark.read.parquet(counts_of(root, 0)).withColumn("count", F.col("count").cast("int"))
    with pytest.raises(IncompletePhase, match="read as"):
        verify(rows, [read_manifest(spark, counts_of(root, 0))])


def test_sums_know_rows_and_not_their_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for _ in range(200)]

    def sums(rows):
        frame = spark.createDataFrame(rows, "a string, b long")
        return list(frame.repartition(3).agg(check_sums(["a", "b"])).first()[0])

    whole = sums(rows)
    assert sums(rng.sample(rows, 200)) == whole
    assert sums(rows[1:]) != whole != sums([*rows, rows[0]])
    assert sums([(None, 1), ("a", None)]) != sums([("a", 1), (None, None)])
    assert sums([("a", 1)] * 2) != sums([("a", 1)] * 4)  # repeats do not cancel


def test_report_of_results(spark, phases, tmp_path):
    prefix, root, run = phases
    paths = [counts_of(root, p, t) for p in range(SITES) for t in jobs.TABLES]
    report = phase_report(spark, paths).collect()
    assert sorted(r.path for r in report) == sorted(paths)
    assert {r.n_rows for r in report} == {7}
    with pytest.raises(IncompletePhase):
        phase_report(spark, [*paths, f"{root}/nothing"])


def test_manifest_of_odd_names(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1.5, None)], "`a.b` string, `c``d` double, e binary")
    counted, seen = observed(rows, "odd")
    counted.write.parquet(f"{tmp_path}/odd")
    write_manifest(rows, f"{tmp_path}/odd", seen.get)
    back = spark.read.parquet(f"{tmp_path}/odd")
    verify(back, [read_manifest(spark, f"{tmp_path}/odd")])
