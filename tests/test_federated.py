import pytest
from weftsample.plans.manifests import IncompletePhase
from pyspark.sql import functions as F

import weftsample as ws
from weftsample.plans import jobs
from weftsample.sources import sites as files
from weftsample.sources import synth

from .conftest import rows_of

ON = [("o_custkey", "user_id")]
IDS = dict(left_id="o_orderkey", right_id="event_id", seed=3)

ASSIGNMENTS = {
    "one site": "0",
    "two sites": "id % 2",
    "four sites": "id % 4",
    "skewed": "if(id % 10 < 9, 0, id % 3)",
    "by key": "k % 3",
}


@pytest.mark.parametrize("where", ASSIGNMENTS)
def test_equals_centralized(orders, events, where):
    def at(df, id_, key):
        text = ASSIGNMENTS[where].replace("id", id_).replace("k ", f"{key} ")
        return df.withColumn("site", F.expr(f"cast({text} as int)"))

    spread = ws.federated_join_sample(
        at(orders, "o_orderkey", "o_custkey"), at(events, "event_id", "user_id"), ON, 0.05, **IDS
    )
    assert rows_of(spread) == rows_of(ws.join_sample(orders, events, ON, 0.05, **IDS))


def test_one_dataframe_per_site_and_an_empty_site(orders, events):
    parts = {
        "north": orders.filter("o_orderkey % 2 = 0"),
        "south": orders.filter("o_orderkey % 2 = 1"),
        "empty": orders.limit(0),
    }
    spread = ws.federated_join_sample(parts, [events], ON, 0.05, **IDS)
    assert rows_of(spread) == rows_of(ws.join_sample(orders, events, ON, 0.05, **IDS))


def test_counts_of_sites_add_up(orders):
    sited = orders.withColumn("site", F.col("o_orderkey") % 3)
    merged = ws.merge_key_frequencies(ws.site_key_frequencies(sited, "o_custkey"), "o_custkey")
    assert rows_of(merged) == rows_of(ws.key_frequencies(orders, "o_custkey"))


def test_null_keys_are_one_group(hand):
    counts = {r.key: r["count"] for r in ws.key_frequencies(hand[1], "key").collect()}
    assert counts == {"a": 2, "b": 4, "d": 1, None: 2}


@pytest.fixture(scope="module")
def site_files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    positions = synth.key_positions(spark, 60)
    for t in (0, 1):
        rows = synth.synth_uniform(
            positions, 60, min_rpk=4, max_rpk=20, overlap=0.5, sites=3, value_size=4, table=t
        )
        prefix = files.write_sites(rows.drop("table"), folder, "small", t, 3)
    return prefix


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_phases_over_files_equal_the_centralized_job(spark, site_files, tmp_path, fmt):
    root, out, whole = f"{tmp_path}/phases", f"{tmp_path}/sample", f"{tmp_path}/whole"
    metrics = f"{tmp_path}/metrics"
    common = dict(fraction=0.1, seed=9, metrics=metrics)
    for p in range(3):
        jobs.run_count(spark, site_files, root, site=p, sites=3, fmt=fmt, metrics=metrics)
    merged = jobs.run_merge(spark, root, sites=3, fmt=fmt, metrics=metrics)
    for p in range(3):
        jobs.run_sample(spark, site_files, root, site=p, sites=3, fmt=fmt, **common)
    joined = jobs.run_join(spark, root, out, sites=3, fmt=fmt, **common)
    central = jobs.run_centralized(spark, site_files, whole, sites=3, **common)

    names = "key " + " ".join(f"value_{n}_{t}" for t in (1, 2) for n in "one two three four five".split())
    schema = ", ".join(f"{n} string" for n in names.split())
    phased = rows_of(files.read_table(spark, out, "csv", schema))
    assert phased == rows_of(files.read_table(spark, whole, "csv", schema))
    assert len(phased) > 100
    assert joined[0]["n_rows"] == central[0]["n_rows"] == len(phased)
    assert [m["n_rows"] for m in merged] == [60, 60]
    first = spark.read.json(metrics).filter("phase = 'count'").agg(
        F.sum("n_lines"), F.sum("n_malformed")
    ).first()
    both = [files.read_sites(spark, site_files, t, 3).count() for t in (0, 1)]
    assert tuple(first) == (sum(both), 0)
    # The metrics of all jobs: 3 x 2 counts, 2 merges, 3 x 2 samples, 2 joins.
    assert spark.read.json(metrics).count() == 16


def test_other_fractions_keep_their_own_files(spark, site_files, tmp_path):
    """Fractions that agree to six decimals do not overwrite each other."""
    a = jobs._path("r", "samples", 0, fraction=0.1234561, seed=1, site=0)
    b = jobs._path("r", "samples", 0, fraction=0.1234562, seed=1, site=0)
    assert a != b


def test_a_missing_site_is_an_error(spark, site_files, tmp_path):
    root, draw = f"{tmp_path}/phases", dict(fraction=0.1, seed=9)
    for p in (0, 2):
        jobs.run_count(spark, site_files, root, site=p, sites=3)
    with pytest.raises(IncompletePhase, match="no manifest"):
        jobs.run_merge(spark, root, sites=3)
    jobs.run_count(spark, site_files, root, site=1, sites=3)
    jobs.run_merge(spark, root, sites=3)
    for p in (0, 1):
        jobs.run_sample(spark, site_files, root, site=p, sites=3, **draw)
    with pytest.raises(IncompletePhase, match="no manifest"):
        jobs.run_join(spark, root, f"{tmp_path}/out", sites=3, **draw)


@pytest.mark.parametrize("ids", [None, "id"])
def test_phases_with_several_keys_and_ids(spark, tmp_path, ids):
    """Typed columns, two keys of which one has a dot, NULL keys, ids that sites share."""
    for t in jobs.TABLES:
        rows = spark.range(240).selectExpr(
            "id div 3 as id", "if(id % 11 = 0, NULL, cast(id % 5 as int)) as `k.1`",
            "'k' || id % 2 as k2", f"'{t}-' || id as v", "cast(id % 3 as int) as site",
        )
        prefix = files.write_sites(rows, f"{tmp_path}/tables", "two", t, 3)
    schema = rows.drop("site").schema
    run = dict(sites=3, schema=schema, key=["k.1", "k2"])
    draw = dict(fraction=0.2, seed=4, null_safe=True, ids=ids)
    root, out, whole = (f"{tmp_path}/{x}" for x in ("root", "out", "whole"))
    for p in range(3):
        jobs.run_count(spark, prefix, root, site=p, **run)
    jobs.run_merge(spark, root, **run)
    for p in range(3):
        jobs.run_sample(spark, prefix, root, site=p, **run, **draw)
    jobs.run_join(spark, root, out, out_fmt="parquet", **run, **draw)
    jobs.run_centralized(spark, prefix, whole, fmt="parquet", **run, **draw)
    phased = spark.read.parquet(out)
    assert phased.columns == ["k.1", "k2", "id_1", "v_1", "id_2", "v_2"]
    assert rows_of(phased) == rows_of(spark.read.parquet(whole))
    assert phased.filter("`k.1` IS NULL").count() > 0 and phased.count() > 200


@pytest.mark.parametrize("null_safe", [False, True])
def test_rows_without_a_partner_are_not_folded(spark, tmp_path, monkeypatch, null_safe):
    """The fold of equal rows shuffles them whole; a row whose key has no partner draws nothing."""
    for t in jobs.TABLES:
        rows = spark.range(3000).selectExpr(
            f"if(id % 10 = 0, if(id % 20 = 0, NULL, 'both'), '{t}-' || id) as key",
            "'v' || id % 7 as v", "cast(id % 2 as int) as site",
        )
        prefix = files.write_sites(rows, f"{tmp_path}/tables", "few", t, 2)
    folded, fold = [], jobs.identify_rows

    def counted(df, ids):
        folded.append(df.count())
        return fold(df, ids)

    run = dict(sites=2, schema=rows.drop("site").schema)
    draw = dict(fraction=0.01, seed=4, null_safe=null_safe)
    root, out, whole = (f"{tmp_path}/{x}" for x in ("root", "out", "whole"))
    for p in range(2):
        jobs.run_count(spark, prefix, root, site=p, **run)
    jobs.run_merge(spark, root, **run)
    monkeypatch.setattr(jobs, "identify_rows", counted)
    for p in range(2):
        jobs.run_sample(spark, prefix, root, site=p, **run, **draw)
    assert sum(folded) < 2 * 3000 * 0.2
    jobs.run_join(spark, root, out, out_fmt="parquet", **run, **draw)
    jobs.run_centralized(spark, prefix, whole, fmt="parquet", **run, **draw)
    phased = spark.read.parquet(out)
    assert rows_of(phased) == rows_of(spark.read.parquet(whole))
    assert phased.count() > 100 and (phased.filter("key IS NULL").count() > 0) == null_safe


def test_bad_columns_of_the_jobs(spark, tmp_path):
    with pytest.raises(ValueError, match="key columns"):
        jobs.run_merge(spark, str(tmp_path), sites=1, key="nope")
    with pytest.raises(ValueError, match="id columns"):
        jobs.run_join(spark, str(tmp_path), "out", sites=1, fraction=0.1, ids="nope")
