"""The Merkle manifest against a plain recursion, with superblocks of several sizes."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from weftsample.llm.merkle import fold, leaf_hash, merkle_manifest

FIELDS = ("doc_id", "source", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root and, for each node, its siblings left to right, level by level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(places):
            first = place // 3 * 3
            proofs[k] += [nodes[i] for i in range(first, min(first + 3, len(nodes))) if i != place]
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        places = [p // 3 for p in places]
    return nodes[0], proofs


def brute(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
        groups[row[1]].append((row[0] is not None, row[0] or 0, digest(*values)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    root, upper = tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        for (has, i, leaf), proof in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((i if has else None, leaf, trees[g][0], root, digest(*proof, *above)))
    return sorted(out, key=repr)


ODD = (
    [(i, f"s{i % 7}", f"text {i}") for i in range(40)]
    + [(100 + i, "hot", "é\n" * (i % 3)) for i in range(83)]
    + [(200, None, None), (201, None, ""), (None, "hot", "x"), (202, "", "y")]
    + [(300, "twice", "same")] * 4 + [(301, "alone", "z")]
)


def rows_of(spark, rows):
    frame = spark.createDataFrame(
        [(*r, "x", 0, "n") for r in rows],
        "doc_id long, source string, text string, grp string, rank long, node string",
    )
    return frame.repartition(5)


@pytest.mark.parametrize(("levels", "rows"), [(1, ODD), (2, ODD), (6, ODD), (1, ODD[:1])])
def test_against_a_plain_recursion(spark, levels, rows):
    got = merkle_manifest(rows_of(spark, rows), FIELDS, levels=levels).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute(rows)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_a_changed_row_is_found_out(spark):
    other = leaf_hash([F.col("doc_id"), F.col("source"), F.lit("changed")])
    found = F.when(F.col("doc_id") == 117, other)
    got = merkle_manifest(rows_of(spark, ODD), FIELDS, found=found, levels=2).collect()
    assert [r.id for r in got if not r.verified] == [117]
    assert {r.id for r in got if r.folded_root != r.root} == {117}


def test_fields_are_delimited(spark):
    """Values that run into each other, or a null beside a dash, give other leaves."""
    rows = [(1, "ab", "c"), (1, "a", "bc"), (1, "-", None), (1, None, "-"), (1, "", "0:")]
    frame = rows_of(spark, rows)
    leaves = frame.select(leaf_hash([F.col("source"), F.col("text")])).collect()
    assert len(set(leaves)) == len(rows)


def test_no_rows(spark):
    assert merkle_manifest(rows_of(spark, ODD).limit(0), FIELDS).collect() == []


def test_fold():
    assert fold("n", []) == "n"
    assert fold("n", ["a", "b", "", "c"]) == digest(digest("a", "n", "b"), "c")
