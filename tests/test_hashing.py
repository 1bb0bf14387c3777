import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftsample.functions.hashing import (
    BITS,
    LETTERS,
    letters_from,
    mix52,
    mix52_array,
    with_row_bits,
    words_needed,
)
from weftsample.sources import synth

NUMBERS = {
    "counting": np.arange(200_000),
    "strided": np.arange(200_000) * 4096 + 5,
    "wide": np.arange(200_000) * (2**45 + 12345),
    "high": np.arange(200_000) << 40,
}


def uniforms(numbers, purpose="test", seed=1):
    return (mix52_array(numbers.astype(np.int64), purpose, seed) + 0.5) * 2.0**-BITS


def chi_square(found):
    """Distance from even counts in standard deviations."""
    each = found.sum() / found.size
    chi2, freedom = ((found - each) ** 2 / each).sum(), found.size - 1
    return (chi2 - freedom) / math.sqrt(2 * freedom)


@pytest.mark.parametrize("kind", NUMBERS)
def test_even_and_independent(kind):
    u = uniforms(NUMBERS[kind])
    v = uniforms(NUMBERS[kind], seed=2)
    w = uniforms(NUMBERS[kind], purpose="other")
    assert 0 < u.min() and u.max() < 1 and len(np.unique(u)) == len(u)
    assert abs(chi_square(np.histogram(u, 1000, (0, 1))[0])) < 5
    assert abs(chi_square(np.histogram(u * 2**20 % 1, 1000, (0, 1))[0])) < 5
    pairs = [(u[:-1], u[1:]), (u[:-7], u[7:]), (u[: 1 << 17], u[: 1 << 17] * 2**13 % 1), (u, v), (u, w)]
    for a, b in pairs:
        assert abs(chi_square(np.histogram2d(a, b, 40, ((0, 1), (0, 1)))[0])) < 5


@pytest.mark.parametrize("kind", NUMBERS)
def test_small_groups_vary_like_binomials(kind):
    """Hits among 50 neighbours, and among 50 numbers far apart."""
    hits = uniforms(NUMBERS[kind]) < 0.1
    for groups in (hits.reshape(-1, 50), hits.reshape(50, -1).T):
        counts = groups.sum(axis=1)
        assert counts.mean() == pytest.approx(5, abs=0.1)
        assert counts.var() == pytest.approx(4.5, rel=0.12)


def test_every_bit_matters():
    base = np.random.default_rng(3).integers(0, 2**62, 4000)
    before = mix52_array(base, "test", 1)
    for bit in range(63):
        changed = before ^ mix52_array(base ^ (1 << bit), "test", 1)
        flips = [((changed >> i) & 1).mean() for i in range(BITS)]
        assert 0.4 < min(flips) and max(flips) < 0.6


@pytest.mark.parametrize("step", [1, 2, 3, 10, 64, 1000, 4096, 1 << 20, 1 << 31, 1 << 40])
def test_lower_bits_of_ids_in_steps(step):
    """The lower 26 bits: even, unrelated between seeds, neighbours, places and halves."""
    ids = np.arange(1 << 17) * step
    wholes = [mix52_array(ids, "test", seed) for seed in range(5)]
    lows = [(w % 2**26) * 2.0**-26 for w in wholes]
    pairs = [(a, b) for i, a in enumerate(lows) for b in lows[:i]]
    for low, whole in zip(lows, wholes, strict=True):
        assert abs(chi_square(np.histogram(low, 1000, (0, 1))[0])) < 5
        pairs += [(low[1:], low[:-1]), (low, low * 2**8 % 1), (low, low * 2**13 % 1)]
        pairs.append((low, (whole >> 26) * 2.0**-26))
    for a, b in pairs:
        assert abs(chi_square(np.histogram2d(a, b, 32, ((0, 1), (0, 1)))[0])) < 5


def letters_by_digits(word, length):
    return "".join(LETTERS[word // 52**i % 52] for i in range(length))


@pytest.mark.parametrize("length", [0, 1, 2, 5, 6, 7, 16])
def test_letters_are_the_digits_of_the_words(spark, length):
    words = [f"w{i}" for i in range(words_needed(length))]
    rows = spark.range(200).selectExpr(
        "id", *[f"{mix52('id', f'letters{i}', 1)} as {w}" for i, w in enumerate(words)]
    )
    for r in rows.selectExpr("*", f"{letters_from(words, length)} as text").collect():
        want = "".join(
            letters_by_digits(r[w], min(6, length - 6 * i)) for i, w in enumerate(words)
        )
        assert r.text == want


def test_generated_code_of_letters_is_short(spark, capsys):
    """A method of more than 8,000 bytes is not compiled to machine code."""
    positions = synth.key_positions(spark, 100)
    rows = synth.synth_uniform(
        positions, 100, min_rpk=2, max_rpk=9, overlap=0.5, sites=4, value_size=8, table=0
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan before its first run
    try:
        rows.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8_000


def test_spark_and_numpy_agree(spark):
    numbers = np.random.default_rng(4).integers(-(2**62), 2**62, 500)
    df = spark.createDataFrame([(int(n),) for n in numbers], "n long")
    mixed = df.select(F.expr(mix52("n", "test", 1)).alias("m")).collect()
    assert [r.m for r in mixed] == mix52_array(numbers, "test", 1).tolist()


def test_row_bits_of_several_ids_and_of_text(spark):
    rows = spark.range(20_000).selectExpr("id % 100 as a", "id div 100 as b", "'x' || id as c")
    for ids in (["a", "b"], ["b", "a"], ["c"], ["a", "c"]):
        bits = [r._bits for r in with_row_bits(rows, ids, "test", 1).select("_bits").collect()]
        assert len(set(bits)) == 20_000
        assert abs(chi_square(np.histogram(bits, 200, (0, 2**52))[0])) < 5
