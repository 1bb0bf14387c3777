"""SimHash near-dedup: fingerprints meet at the anchors of a covering code."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored, table, text_bytes
from .components import components

#: Seed of XXH64, as the contract of the query has it.
SEED = 42

#: Bits of the summary of occupied anchors; its size does not grow with the data.
SUMMARY_BITS = 1 << 23


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included.

    A bit is set if over half of the shingle hashes have it.  Fewer words than
    a shingle: the whole sequence is the one shingle.  No words: zero.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1]
    pieces = map(joined.__getitem__, map(slice, starts.tolist(), ends[shingle - 1 :].tolist()))
    count = n - shingle + 1
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, count
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


class ProductCode:
    """A covering code of 64-bit words: two binary Golay codes, six 3-bit majorities.

    Bits 0-22 and 23-45 each round to a word of the perfect [23,12] code
    (covering radius 3), bits 46-63 to 000 or 111 in threes (radius 1 each), so
    that every fingerprint is within the covering radius, block by block, of
    one anchor: its *home*.  There are 2^30 anchors.  A block is known by its
    syndrome table, which is built from the generator polynomial.
    """

    GOLAY = 0b101011100011  # Fixed value: generator polynomial of the [23,12] code.
    BLOCKS = ((0, 23), (23, 23)) + tuple((46 + 3 * i, 3) for i in range(6))

    def __init__(self) -> None:
        # Remainders are linear: those of the upper and of the lower bits add up.
        self.upper = self._remainders(np.arange(1 << 11, dtype=np.uint32) << np.uint32(12))
        self.lower = self._remainders(np.arange(1 << 12, dtype=np.uint32))
        self.leader = np.zeros(1 << 11, np.uint32)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self.leader[self.syndrome(np.uint32(word))] = word
        self.majority = np.array([0, 0, 0, 7, 0, 7, 7, 7], np.uint64)

    def _remainders(self, words: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            words = words ^ ((words >> np.uint32(bit)) & np.uint32(1)) * np.uint32(
                self.GOLAY << (bit - 11)
            )
        return words

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        """Remainder of 23-bit words by the generator polynomial: zero for code words."""
        return self.upper[words >> np.uint32(12)] ^ self.lower[words & np.uint32(0xFFF)]

    def _golay(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.leader[self.syndrome(words)]

    def home(self, prints: np.ndarray) -> np.ndarray:
        """The anchor within the covering radius of each fingerprint."""
        out = np.zeros_like(prints)
        for at, width in self.BLOCKS:
            block = (prints >> np.uint64(at)) & np.uint64((1 << width) - 1)
            near = self.majority[block] if width == 3 else self._golay(block.astype(np.uint32)).astype(np.uint64)
            out |= near << np.uint64(at)
        return out

    def anchors(self, prints: np.ndarray, threshold: int) -> list[np.ndarray]:
        """All anchors within covering radius plus ``threshold`` of each fingerprint.

        The radius is counted block by block: an anchor is in reach if some
        word within ``threshold`` bits of the fingerprint has it as its home.
        """
        flips = [np.uint64(0)]
        for weight in range(1, threshold + 1):
            flips += [
                np.uint64(sum(1 << b for b in bits)) for bits in combinations(range(64), weight)
            ]
        near = self.home((prints[:, None] ^ np.array(flips, np.uint64)[None, :]).ravel())
        near = np.sort(near.reshape(len(prints), -1), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        return [row[new] for row, new in zip(near, first, strict=True)]


def _print_of(text_col: str, shingle: int) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        prints = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(prints.view(np.int64))

    return hashed(text_bytes(text_col))


_CODE: list[ProductCode] = []


def _code() -> ProductCode:
    """One code per worker."""
    if not _CODE:
        _CODE.append(ProductCode())
    return _CODE[0]


def _position(anchors: np.ndarray) -> np.ndarray:
    """Place of an anchor in the summary."""
    mixed = anchors * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(20)) % np.uint64(SUMMARY_BITS)


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (``print``) at most ``threshold`` bits apart.

    Each fingerprint is stored once, at its home anchor, and replicated to all
    anchors in reach; a pair meets at the home of either.  A summary of fixed
    size tells which anchors are anyone's home, so that most replicas are not
    even shuffled; where it fills up, more are, and nothing is lost.
    """

    @F.pandas_udf("struct<anchor: long, word: int, bit: int>")
    def at_home(values: pd.Series) -> pd.DataFrame:
        anchor = _code().home(values.to_numpy(np.int64).view(np.uint64))
        place = _position(anchor).astype(np.int64)
        return pd.DataFrame(
            {
                "anchor": anchor.view(np.int64),
                "word": (place >> 5).astype(np.int32),
                "bit": (place & 31).astype(np.int32),
            }
        )

    spark = prints.sparkSession
    homes = prints.select("print", at_home("print").alias("home"))
    homes = stored(homes.select("print", "home.anchor", "home.word", "home.bit"), "simhash-homes")
    words = homes.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    summary = np.zeros(SUMMARY_BITS >> 5, np.uint32)
    for word, bits in words.collect():  # at most SUMMARY_BITS / 32 rows of summary
        summary[word] = bits & 0xFFFFFFFF
    shared = spark.sparkContext.broadcast(summary)

    @F.pandas_udf("array<long>")
    def in_reach(values: pd.Series) -> pd.Series:
        occupied, out = shared.value, []
        own = values.to_numpy(np.int64).view(np.uint64)
        for at in range(0, len(own), 256):
            for anchors in _code().anchors(own[at : at + 256], threshold):
                place = _position(anchors)
                bit = occupied[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)
                out.append(anchors[(bit & 1) == 1].view(np.int64))
        return pd.Series(out, dtype=object)

    probes = homes.select(
        F.col("print").alias("a"), F.explode(in_reach("print")).alias("anchor")
    )
    stores = homes.select(F.col("print").alias("b"), "anchor")
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {int(threshold)}")
    return probes.join(stores, "anchor").filter(near).select("a", "b").distinct()


def print_components(rows: DataFrame, threshold: int) -> DataFrame:
    """``print``, ``component``: the smallest ``id`` reachable, once per fingerprint."""
    nodes = stored(rows.groupBy("print").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("print"), threshold), "a", "b")
    linked = nodes.join(roots, nodes["print"] == roots["node"]).select("print", "first", "root")
    linked = stored(linked, "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = linked.join(smallest, "root").select("print", "component")
    # Nodes without a link are their own component.
    alone = nodes.join(linked.select("print"), "print", "left_anti")
    return stored(
        named.unionByName(alone.selectExpr("print", "first as component")), "simhash-named"
    )


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    threshold: int = 2,
) -> DataFrame:
    """``id``, ``print``, ``component`` (smallest id reachable over links) of each row.

    Null texts count as empty; texts without words have fingerprint zero and
    link like any other.  Rows with the same fingerprint are one node, so a
    group of copies costs one row per task.  Null ids never name a component
    unless it has no other.  Other columns are not read.  An empty table gives
    an empty result.
    """
    rows = docs.select(column(id_col).alias("id"), _print_of(text_col, shingle).alias("print"))
    rows = stored(rows, "simhash-prints")
    return rows.join(print_components(rows, threshold), "print").select("id", "print", "component")


def keep_one_per_component(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    threshold: int = 2,
) -> DataFrame:
    """One row of ``docs`` per component, with all columns: that of the smallest id.

    Where rows repeat that id, the smallest fingerprint and then the smallest
    row decides.  Null ids count as larger than all others.
    """
    # One struct holds the columns, so that no name can clash with those added.
    boxed = docs.select(
        column(id_col).alias("id"), _print_of(text_col, shingle).alias("print"),
        F.struct(*[column(c) for c in docs.columns]).alias("doc"),
    )
    boxed = stored(boxed, "simhash-input")
    rows = boxed.select("id", "print")
    named = rows.join(print_components(rows, threshold), "print").filter("id <=> component")
    # A component without any id is known by its smallest fingerprint.
    order = F.coalesce(F.col("component").cast("string"), F.concat(F.lit("print "), "print"))
    best = named.groupBy(order.alias("which")).agg(F.min("print").alias("print"))
    chosen = named.select(order.alias("which"), "id", "print").join(best, ["which", "print"])
    chosen = stored(chosen.select("id", "print").distinct(), "simhash-kept")
    same = boxed["id"].eqNullSafe(chosen["id"]) & (boxed["print"] == chosen["print"])
    kept = boxed.join(chosen, same, "left_semi")
    return kept.groupBy("id", "print").agg(F.min("doc").alias("doc")).select("doc.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
