"""Merkle dataset manifest: superblocks of leaves exchange their tops for outer nodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, column, stored, table

#: Children of a node, as the contract has it.
ARITY = 3

#: Levels of the tree that are reduced inside one superblock of ``ARITY ** LEVELS`` nodes.
LEVELS = 6

#: Nodes that one call of the cogrouped function gets on average, and that a task gets.
GROUP_NODES, TASK_NODES = 4_096, 50_000

OUTER = "grp string, block long, path array<string>, subroot string, root string"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hex sha256 of the fields, each as ``length:value`` in UTF-8 bytes, a null as ``-``."""
    fields = []
    for value in values:
        text = value.cast("string")
        fields.append(
            F.coalesce(
                F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
            )
        )
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def group_key(value: Column) -> Column:
    """A text that sorts like the value, nulls first, and is never null."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0, inside ``grp``) and ``total`` (rows of ``grp``).

    Rows are dealt by ranges, so a group with a third of all rows is spread, and
    each task numbers its own; the sizes of the ranges before it are added.  Rows
    that are equal in ``order`` take any order among themselves.
    """
    salt = F.xxhash64(F.monotonically_increasing_id())
    keys = ["grp", *order, "salt"]
    spread = rows.withColumn("salt", salt).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(spread.drop("salt").withColumn("at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.expr("shiftright(at, 33)"))
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    runs = runs.selectExpr(
        "grp", "part", "first", "sum(n) OVER (PARTITION BY grp) AS total",
        "sum(n) OVER (PARTITION BY grp ORDER BY part) - n AS before",
    )
    ranked = placed.join(runs, ["grp", "part"]).withColumn("rank", F.expr("at - first + before"))
    return ranked.drop("at", "part", "first", "before")


def superblock(levels: int) -> Column:
    return F.expr(f"rank div {ARITY**levels}")


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The next nodes (``grp``, ``rank``, ``total``, ``node``): one per superblock.

    A superblock of a larger group is reduced by ``levels`` levels, also where
    it holds a single node; that of a small group until one node remains.
    """
    block = ARITY**levels
    level = f"""transform(sequence(0, int((size(a) - 1) div {ARITY})),
                          i -> sha2(concat_ws('', slice(a, {ARITY} * i + 1, {ARITY})), 256))"""
    reduced = F.expr(
        f"""aggregate(sequence(1, {levels}), nodes,
                      (a, k) -> if(size(a) > 1 OR total > {block}, {level}, a))[0]"""
    )
    # At most ARITY ** levels nodes in a list.
    lists = nodes.groupBy("grp", superblock(levels).alias("block")).agg(
        F.first("total").alias("total"),
        F.expr("transform(array_sort(collect_list(struct(rank, node))), x -> x.node)")
        .alias("nodes"),
    )
    total = F.expr(f"(total + {block - 1}) div {block}")
    return lists.select("grp", F.col("block").alias("rank"), total.alias("total"),
                        reduced.alias("node"))


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes and all that their superblocks are reduced to, up to one node a group.

    A round divides the nodes by ``ARITY ** levels``: ten thousand million leaves take four.
    """
    out = [nodes.select("grp", "rank", "total", "node")]
    while (out[-1].agg(F.max("total")).first()[0] or 1) > 1:
        out.append(stored(tops(out[-1], levels), "merkle-tops"))
    return out


def siblings(nodes: list[str], total: int, levels: int) -> Iterator[list[list[str]]]:
    """For each level of a superblock: the text left and right of each node's place in its run.

    Stops where ``tops`` stops.
    """
    for _ in range(levels):
        if len(nodes) == 1 and total <= ARITY**levels:
            return
        runs = [nodes[at : at + ARITY] for at in range(0, len(nodes), ARITY)]
        yield [
            ["".join(run[:place]), "".join(run[place + 1 :])]
            for run in runs
            for place in range(len(run))
        ]
        nodes = [sha256("".join(run).encode()).hexdigest() for run in runs]


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a node and its siblings (left, right, left, right, ...) lead to."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def _joined(nodes: pd.DataFrame, outer: pd.DataFrame, levels: int) -> Iterator[tuple]:
    """Each row of a group's superblocks, the outer row of its superblock, and its path."""
    above = {(o.grp, o.block): o for o in outer.itertuples(index=False)}
    nodes = nodes.sort_values("rank", kind="stable")
    for key, rows in nodes.groupby(["grp", "block"], sort=False):
        own = above[key]
        upper = list(own.path)
        inner = list(siblings(rows["node"].tolist(), int(rows["total"].iloc[0]), levels))
        for place, row in enumerate(rows.itertuples(index=False)):
            path = []
            for level in inner:
                path += level[place]
                place //= ARITY
            yield row, own, path + upper


def _paths(levels: int):
    """The outer row of each node: its siblings up to the root."""

    def paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = [
            (row.grp, row.rank, path, own.subroot, own.root)
            for row, own, path in _joined(nodes, outer, levels)
        ]
        return pd.DataFrame(out, columns=["grp", "block", "path", "subroot", "root"])

    return paths


def _proofs(levels: int):
    """Proofs of the leaves, and the roots that the leaves found lead to."""
    columns = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def proofs(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, own, path in _joined(nodes, outer, levels):
            proof = sha256("".join(path).encode()).hexdigest()
            folded = fold(row.node if row.found is None else row.found, path)
            out.append((row.id, row.node, own.subroot, own.root, proof, folded))
        frame = pd.DataFrame(out, columns=columns)
        frame["verified"] = frame["folded_root"] == frame["root"]
        return frame

    return proofs


def _exchange(nodes: DataFrame, outer: DataFrame, function, schema: str, levels: int) -> DataFrame:
    """Cogroup nodes with the outer rows of their superblocks.

    Superblocks, at most ``ARITY ** levels`` nodes each, are dealt to buckets by
    hash: a group of one leaf costs no call of its own.
    """
    rows = nodes.count()
    buckets = max(1, rows // GROUP_NODES)
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, rows // TASK_NODES)
    bucket = F.pmod(F.xxhash64("grp", "block"), F.lit(buckets)).alias("bucket")
    left = nodes.withColumn("block", superblock(levels)).select("*", bucket)
    right = outer.select("*", bucket)
    sides = [side.repartition(tasks, "bucket").groupBy("bucket") for side in (left, right)]
    return sides[0].cogroup(sides[1]).applyInPandas(function(levels), schema)


def _descend(nodes: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Outer rows of the nodes of the first round, down from those of the nodes above the last."""
    for lower in reversed(nodes):
        outer = stored(_exchange(lower, outer, _paths, OUTER, levels), "merkle-outer")
    return outer


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    *,
    id_col: str = "doc_id",
    group_col: str = "source",
    found: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Each row is a leaf over ``fields``; leaves ascend by id inside their group,
    groups ascend by name, nulls first.  ``found`` is the leaf that a later copy
    of the row has; where it is null, the leaf is as it was.  Its root is folded
    from the proof and compared with the manifest's.

    Nulls are marked in the leaf, so null and empty differ; a null id comes
    first and a null group is a group.  Rows of equal id are ordered by leaf;
    equal rows are leaves each.  Columns that are not in ``fields`` are not
    read.  A table of one row is its own root; an empty table gives an empty
    result.

    What passes the driver is the number of nodes of a round.
    """
    leaf = leaf_hash([column(c) for c in fields])
    leaves = docs.select(
        group_key(column(group_col)).alias("grp"),
        column(id_col).alias("id"),
        leaf.alias("node"),
        (F.lit(None).cast("string") if found is None else found).alias("found"),
    )
    id_type = leaves.schema["id"].dataType.simpleString()
    leaves = stored(numbered(leaves, ["id", "node"], "merkle-leaves"), "merkle-ranked")
    within = rounds(leaves, levels)
    subroots = within[-1].select(
        F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("node")
    )
    subroots = stored(numbered(subroots, ["member"], "merkle-subroots"), "merkle-ranked")
    across = rounds(subroots, levels)

    # From the root down: first to the subroots, then to the superblocks of leaves.
    top = across[-1].selectExpr(
        "grp", "rank AS block", "CAST(array() AS array<string>) AS path",
        "CAST(NULL AS string) AS subroot", "node AS root",
    )
    named = _descend(across[:-1], top, levels).drop("subroot").join(
        subroots.select(F.col("rank").alias("block"), "member", F.col("node").alias("subroot")),
        "block",
    )
    outer = named.selectExpr("member AS grp", "0L AS block", "path", "subroot", "root")
    # The last round of ``within`` holds the subroots; the leaves, its first, come last.
    outer = _descend(within[1:-1], outer, levels)
    schema = (
        f"id {id_type}, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string, verified boolean"
    )
    return _exchange(leaves, outer, _proofs, schema, levels)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    stripped = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = leaf_hash([stripped if c == "text" else F.col(c) for c in fields])
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle_manifest(docs, fields, found=F.when(even, tampered))
    return found.withColumnRenamed("id", "doc_id")


def _sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    parts = [f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


OP12_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('1' || source, '0') AS grp, {_sql_leaf("text")} AS leaf,
           CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % 2 = 0
                THEN {_sql_leaf("replace(text, chr(10), '')")}
                ELSE {_sql_leaf("text")} END AS found,
           row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx
    FROM documents
), low(level, grp, idx, node, n) AS (
    SELECT 0, grp, idx, leaf, count(*) OVER (PARTITION BY grp) FROM leaves
    UNION ALL
    SELECT level + 1, grp, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3
    FROM low WHERE n > 1 GROUP BY level, grp, idx // 3
), subroots AS (
    SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS idx FROM low WHERE n = 1
), high(level, idx, node, n) AS (
    SELECT 0, idx, node, count(*) OVER () FROM subroots
    UNION ALL
    SELECT level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 2) // 3
    FROM high WHERE n > 1 GROUP BY level, idx // 3
), steps AS (
    SELECT l.doc_id, o.level AS step,
           coalesce(string_agg(o.node, '' ORDER BY o.idx)
                    FILTER (o.idx < l.idx // CAST(3 ** o.level AS BIGINT)), '') AS lt,
           coalesce(string_agg(o.node, '' ORDER BY o.idx)
                    FILTER (o.idx > l.idx // CAST(3 ** o.level AS BIGINT)), '') AS rt
    FROM leaves l JOIN low o ON o.grp = l.grp AND o.n > 1
     AND o.idx // 3 = l.idx // CAST(3 ** (o.level + 1) AS BIGINT)
    GROUP BY l.doc_id, o.level
    UNION ALL
    SELECT l.doc_id, 1000 + o.level,
           coalesce(string_agg(o.node, '' ORDER BY o.idx)
                    FILTER (o.idx < s.idx // CAST(3 ** o.level AS BIGINT)), ''),
           coalesce(string_agg(o.node, '' ORDER BY o.idx)
                    FILTER (o.idx > s.idx // CAST(3 ** o.level AS BIGINT)), '')
    FROM leaves l JOIN subroots s ON s.grp = l.grp
    JOIN high o ON o.n > 1 AND o.idx // 3 = s.idx // CAST(3 ** (o.level + 1) AS BIGINT)
    GROUP BY l.doc_id, o.level
), paths AS (
    SELECT doc_id, list({{'lt': lt, 'rt': rt}} ORDER BY step) AS path,
           sha256(string_agg(lt || rt, '' ORDER BY step)) AS proof
    FROM steps GROUP BY doc_id
), folded AS (
    SELECT l.doc_id, l.leaf, s.node AS subroot, (SELECT node FROM high WHERE n = 1) AS root,
           coalesce(p.proof, sha256('')) AS proof_sha256,
           list_reduce(coalesce(p.path, []), lambda a, x: {{'lt': sha256(x.lt || a.lt || x.rt), 'rt': ''}},
                       {{'lt': l.found, 'rt': ''}}).lt AS folded_root
    FROM leaves l JOIN subroots s ON s.grp = l.grp LEFT JOIN paths p ON p.doc_id = l.doc_id
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""
