"""The distribution of the sample, over many seeds.

A seed per run is the same as a run number in the key and in the ids, since all
draws are hashes of the ids.  So all runs fit in one job.
"""

import math

import pytest
from pyspark.sql import functions as F

import weftsample as ws

RUNS = 400


def repeated(df, runs=RUNS):
    return df.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def pairs_of_runs(left, right, fraction, method, runs=RUNS, **options):
    return ws.join_sample(
        repeated(left, runs), repeated(right, runs), ["run", "key"], fraction,
        left_id=["run", "lid"], right_id=["run", "rid"], method=method, **options,
    )


def expected_min(mean):
    """E[min(X, Y)] of two independent Poisson numbers: sum of P(X >= n)^2."""
    total, tail, n = 0.0, 1.0, 0
    p = math.exp(-mean)
    while tail > 1e-12 or n < mean:
        tail -= p
        total += max(tail, 0.0) ** 2
        n += 1
        p *= mean / n
    return total


def mean_and_error(values):
    mean = sum(values) / len(values)
    variance = sum((v - mean) ** 2 for v in values) / (len(values) - 1)
    return mean, math.sqrt(variance / len(values))


def tables(spark, n_left, n_right):
    left = spark.range(n_left).selectExpr("id as lid", "'k' as key")
    right = spark.range(n_right).selectExpr("id as rid", "'k' as key")
    return left, right


@pytest.mark.parametrize("n_left,n_right,fraction", [(4, 5, 0.02), (3, 10, 0.1), (20, 30, 0.1)])
@pytest.mark.parametrize("method", ["zip", "indexed"])
def test_size(spark, n_left, n_right, fraction, method):
    left, right = tables(spark, n_left, n_right)
    found = pairs_of_runs(left, right, fraction, method).groupBy("run").count().collect()
    sizes = [r["count"] for r in found] + [0] * (RUNS - len(found))
    mean = fraction * n_left * n_right
    size, error = mean_and_error(sizes)
    assert abs(size - (expected_min(mean) if method == "zip" else mean)) < 4 * error
    if method == "indexed":  # a Poisson number: variance equals mean
        variance = sum((s - size) ** 2 for s in sizes) / (RUNS - 1)
        assert variance == pytest.approx(mean, rel=0.35)


def test_formula_for_the_smaller_side():
    # Kept shares E[min] / mean as listed in the survey of this method.
    for mean, share in ((0.01, 0.010), (0.1, 0.091), (1, 0.476), (10, 0.823), (100, 0.944)):
        assert expected_min(mean) / mean == pytest.approx(share, abs=6e-4)


@pytest.mark.parametrize("method", ["zip", "indexed"])
@pytest.mark.parametrize("slot_rows", [500_000, 10])
def test_pairs_are_uniform(spark, method, slot_rows):
    """No cell of R x S is preferred: chi-square over 8 x 9 cells."""
    left, right = tables(spark, 8, 9)
    pairs = pairs_of_runs(left, right, 1.0, method, slot_rows=slot_rows)
    found = {(r.lid, r.rid): r["count"] for r in pairs.groupBy("lid", "rid").count().collect()}
    total, cells = sum(found.values()), 72
    each = total / cells
    chi2 = sum((found.get((i, j), 0) - each) ** 2 / each for i in range(8) for j in range(9))
    # 71 degrees of freedom: mean 71, standard deviation 12.
    assert 71 - 5 * 12 < chi2 < 71 + 5 * 12
