"""Samples of joins of three and more tables."""

import re

import pytest
from pyspark.sql import functions as F

import weftsample as ws

from .conftest import rows_of
from .test_law import mean_and_error, repeated

RUNS = 200

LEFT = [(1, "a"), (2, "a"), (3, "b"), (4, "x"), (5, None)]
MIDDLE = [(10, "a", 1), (11, "a", 2), (12, "b", 1), (13, "c", 1), (14, "a", None), (15, None, 2)]
RIGHT = [(20, 1), (21, 1), (22, 2), (23, 9), (24, None)]


def tables(spark):
    return (
        spark.createDataFrame(LEFT, "lid long, a string"),
        spark.createDataFrame(MIDDLE, "mid long, a string, b int"),
        spark.createDataFrame(RIGHT, "rid long, b int"),
    )


def whole_join():
    return {
        (left, mid, right)
        for left, a in LEFT
        for mid, ma, mb in MIDDLE
        for right, b in RIGHT
        if a is not None and a == ma and b is not None and b == mb
    }


IDS = dict(left_id="lid", middle_id="mid", right_id="rid")


def sample(spark, fraction=40.0, **options):
    return ws.join_sample_chain(*tables(spark), "a", "b", fraction, **(IDS | options))


@pytest.mark.parametrize("fraction", [0.5, 3.0])
def test_law(spark, fraction):
    """Each tuple of the join is drawn a Poisson number of times, apart from the others."""
    left, middle, right = (repeated(t, RUNS) for t in tables(spark))
    pairs = ws.join_sample_chain(
        left, middle, right, ["run", "a"], ["run", "b"], fraction,
        left_id=["run", "lid"], middle_id=["run", "mid"], right_id=["run", "rid"],
    )
    found = pairs.groupBy("run", "lid", "mid", "rid").count().collect()
    join = whole_join()
    assert {(r.lid, r.mid, r.rid) for r in found} == join
    sizes, cells = [0] * RUNS, dict.fromkeys(join, 0)
    for r in found:
        sizes[r.run - 1] += r["count"]
        cells[r.lid, r.mid, r.rid] += r["count"]
    mean = fraction * len(join)
    size, error = mean_and_error(sizes)
    assert abs(size - mean) < 4 * error
    # A Poisson number: its variance is its mean, with a deviation of sqrt(2 / 200).
    variance = sum((s - size) ** 2 for s in sizes) / (RUNS - 1)
    assert variance == pytest.approx(mean, rel=0.4)
    each = RUNS * fraction
    chi2 = sum((n - each) ** 2 / each for n in cells.values())
    assert chi2 < len(join) + 5 * (2 * len(join)) ** 0.5
    # Two tuples of one middle row, and of different ones, do not go together.
    counts = {c: [0] * RUNS for c in join}
    for r in found:
        counts[r.lid, r.mid, r.rid][r.run - 1] = r["count"]
    for other in ((2, 10, 21), (3, 12, 20)):
        one, two = counts[1, 10, 20], counts[other]
        covariance = sum((x - fraction) * (y - fraction) for x, y in zip(one, two)) / RUNS
        assert abs(covariance) < 4 * fraction / RUNS**0.5


def test_columns_and_rows(spark):
    pairs = sample(spark)
    assert pairs.columns == ["mid", "a", "b", "lid", "rid"]
    assert {(r.lid, r.mid, r.rid) for r in pairs.collect()} == whole_join()


def test_seed_decides_and_cuts_do_not(spark):
    once = rows_of(sample(spark, 2.0, seed=1))
    assert once == rows_of(sample(spark, 2.0, seed=1, slot_rows=2, part_rows=1))
    assert once != rows_of(sample(spark, 2.0, seed=2))


def test_agrees_with_the_join_of_two_tables(spark):
    """With a branch that has each key once, a chain is a join of two tables."""
    left, middle, _ = tables(spark)
    once = middle.select("b").distinct().filter("b IS NOT NULL").withColumn("rid", F.lit(7))
    pairs = ws.join_sample_chain(left, middle, once, "a", "b", 40.0, **IDS)
    join = left.join(middle.filter("b IS NOT NULL"), "a")
    assert {(r.lid, r.mid) for r in pairs.collect()} == {(r.lid, r.mid) for r in join.collect()}


def test_star_of_one_and_of_three_branches(spark):
    left, middle, right = tables(spark)
    one = ws.join_sample_star(middle, [ws.Branch(left, "a", "lid")], 30.0, middle_id="mid")
    assert {(r.lid, r.mid) for r in one.collect()} == {
        (left, mid) for left, a in LEFT for mid, ma, _ in MIDDLE if a and a == ma
    }
    third = spark.createDataFrame([(30, "a", 1), (31, "b", 1), (32, "a", 1)], "tid long, x string, y int")
    three = ws.join_sample_star(
        middle,
        [ws.Branch(left, "a", "lid"), ws.Branch(right, "b", "rid"),
         ws.Branch(third, [("a", "x"), ("b", "y")], "tid")],
        30.0, middle_id="mid",
    )
    assert three.columns == ["mid", "a", "b", "lid", "rid", "tid"]
    want = {
        (*t, tid) for t in whole_join() for tid, x, y in ((30, "a", 1), (31, "b", 1), (32, "a", 1))
        for mid, a, b in MIDDLE if mid == t[1] and (a, b) == (x, y)
    }
    assert {(r.lid, r.mid, r.rid, r.tid) for r in three.collect()} == want


def test_without_ids_equal_rows_count_each(spark):
    left = spark.createDataFrame([("a", "l")] * 3, "a string, v string")
    middle = spark.createDataFrame([("a", 1, "m")] * 4, "a string, b int, v string")
    right = spark.createDataFrame([(1, "r"), (1, "r"), (1, "s")], "b long, v string")
    pairs = ws.join_sample_chain(left, middle, right, "a", "b", 10.0, seed=4)
    assert pairs.columns == ["a", "b", "v_2", "v_1", "v_3"]
    counts = {r.v_3: r["count"] for r in pairs.groupBy("v_3").count().collect()}
    assert sum(counts.values()) == pytest.approx(360, abs=5 * 360**0.5)
    assert counts["r"] == pytest.approx(240, abs=5 * 240**0.5)


def test_odd_names(spark):
    left, middle, right = tables(spark)
    left = left.withColumnsRenamed({"a": "x.y", "lid": "k0"})
    middle = middle.withColumnsRenamed({"a": "c`d", "b": "v0"})
    pairs = ws.join_sample_chain(
        left, middle, right, [("c`d", "x.y")], [("v0", "b")], 40.0,
        left_id="k0", middle_id="mid", right_id="rid",
    )
    assert pairs.columns == ["mid", "c`d", "v0", "k0", "rid"]
    assert {(r.k0, r.mid, r.rid) for r in pairs.collect()} == whole_join()


def test_empty_tables_and_none(spark):
    left, middle, right = tables(spark)
    for one in ((left.limit(0), middle, right), (left, middle.limit(0), right), (left, middle, right.limit(0))):
        assert ws.join_sample_chain(*one, "a", "b", 5.0, **IDS).collect() == []
    assert sample(spark, 0.0).collect() == []


def test_bad_arguments(spark):
    left, middle, right = tables(spark)
    with pytest.raises(ValueError, match="no key column"):
        ws.join_sample_chain(left, middle, right, "nope", "b", 1.0)
    with pytest.raises(ValueError, match="no key column"):
        ws.join_sample_chain(left, middle, right, [("a", "nope")], "b", 1.0)
    with pytest.raises(ValueError, match="fraction"):
        ws.join_sample_chain(left, middle, right, "a", "b", -1.0)
    with pytest.raises(ValueError, match="not distinct"):
        ws.join_sample_chain(left.withColumnRenamed("lid", "rid"), middle, right, "a", "b", 1.0,
                             suffixes=("", "", ""))
    with pytest.raises(ValueError, match="id columns"):
        ws.join_sample_chain(left, middle, right, "a", "b", 1.0, left_id="nope")
    with pytest.raises(ValueError, match="no branches"):
        ws.join_sample_star(middle, [], 1.0)


def test_copies_are_not_broadcast(spark):
    """A few stored rows stand for many copies; they must not meet on the driver."""
    left = spark.range(40).selectExpr("id as lid", "'a' as a")
    middle = spark.range(40).selectExpr("id as mid", "'a' as a", "1 as b")
    right = spark.range(40).selectExpr("id as rid", "1 as b")
    for options in ({}, dict(slot_rows=20, part_rows=15)):
        triples = ws.join_sample_chain(left, middle, right, "a", "b", 0.5, **IDS, **options)
        triples.collect()
        plan = triples._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(\w+Join) \[[^\]]*_slot#", plan)
        assert joins and set(joins) == {"SortMergeJoin"}
        assert 31_000 < triples.count() < 33_000


def test_stages_of_the_picks_are_compiled(spark, capsys):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    middle = spark.range(40).selectExpr("id as mid", "id % 3 as a", "id % 2 as b", "id % 5 as c")
    branches = [
        ws.Branch(spark.range(30).selectExpr(f"id as {key}id", f"id % 7 as {key}"), key, f"{key}id")
        for key in "abc"
    ]
    asked = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ws.join_sample_star(middle, branches, 0.5, seed=1, middle_id="mid").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", asked)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8_000


def after_unrolling(df):
    """What the plan does to the copies once they are unrolled."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return plan[: plan.index("explode(sequence(((_block")]


def test_many_copies_are_not_shuffled(spark):
    """A million copies of 1,000 rows: the rows they may pick are shuffled, and they are not."""
    left = spark.range(1000).selectExpr("id as lid", "if(id < 900, 'a', 'b') as a")
    middle = spark.range(1000).selectExpr("id as mid", "if(id < 900, 'a', 'b') as a", "id as b")
    right = spark.range(3000).selectExpr("id as rid", "id % 1000 as b")
    for options in ({}, dict(slot_rows=20, part_rows=15)):
        triples = ws.join_sample_chain(left, middle, right, "a", "b", 0.5, **IDS, **options)
        triples.collect()
        assert "Exchange" not in after_unrolling(triples)
        assert 1_225_000 < triples.count() < 1_235_000


@pytest.mark.parametrize("share, ids", [(0, IDS), (10, {}), (1000, IDS)])
def test_lists_cells_and_copies_give_the_same_rows(spark, monkeypatch, share, ids):
    """Keys of several cells, rows of several blocks, repeated and NULL values, uneven types."""
    from weftsample.operators import draws
    from weftsample.plans import chains

    left = spark.range(60).selectExpr(
        "id as lid", "if(id < 40, 0.5D, if(id < 58, id % 5 * 1D, NULL)) as a", "if(id % 3 = 0, NULL, id % 4) as v"
    )
    middle = spark.range(50).selectExpr(
        "id as mid", "if(id < 35, 0.5D, id % 5 * 1D) as a", "cast(if(id = 7, NULL, id % 20) as int) as b"
    )
    middle = middle.unionAll(middle.filter("mid < 5"))
    right = spark.range(70).selectExpr("id as rid", "id % 30 as b", "cast(id % 2 as string) as v")
    right = right.unionAll(right.filter("rid < 9"))

    def sampled():
        return ws.join_sample_chain(
            left, middle, right, "a", "b", 3.0, seed=5, suffixes=("_l", "_m", "_r"), **ids
        )

    known = rows_of(sampled())
    assert len(known) > 10_000
    monkeypatch.setattr(chains, "FEW_COPIES", 0)
    monkeypatch.setattr(chains, "LIST_SHARE", share)
    monkeypatch.setattr(chains, "CELL_COPIES", 300)
    monkeypatch.setattr(chains, "CELL_SHARE", 2)
    for module in (chains, draws):
        monkeypatch.setattr(module, "COPY_BLOCK", 16)
    pairs = sampled()
    assert rows_of(pairs) == known
    # With 0 both branches have too long lists; one of them gets cells.
    assert ("SortMergeJoin" in after_unrolling(pairs)) == (share == 0)
    assert ("_cell#" in pairs._jdf.queryExecution().executedPlan().toString()) == (share < 1000)


def test_values_without_an_order_and_no_values(spark, monkeypatch):
    from weftsample.plans import chains

    left = spark.range(8).selectExpr("id as lid", "'a' as a", "map('k', id) as m")
    middle = spark.range(8).selectExpr("id as mid", "'a' as a", "1 as b")
    right = spark.createDataFrame([(1,), (1,), (2,)], "b int")

    def sampled():
        return ws.join_sample_chain(
            left, middle, right, "a", "b", 2.0, seed=5, left_id="lid", middle_id="mid"
        ).selectExpr("mid", "lid", "m['k']")

    known = rows_of(sampled())
    monkeypatch.setattr(chains, "FEW_COPIES", 0)
    assert len(known) > 200 and rows_of(sampled()) == known
