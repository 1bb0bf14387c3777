"""Best-fit packing: the fullest bin by subset sums, planned on length counts."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored, table, whole_text
from .tokens import encoder, vocabulary_path

#: Token of the documents' end, and the room of a sequence, as the contract has them.
END_ID = 2
CAPACITY = 1024

#: Rows that share a length and a bucket are numbered by one task.
ROWS_PER_BUCKET = 1_000


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces ``(start, length)``; only the first may be shorter than the capacity."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``crc`` and, if wanted, ``ids`` of each piece.

    A document is its ids and the end token; a null text is empty.
    """
    fields = "piece: int, start: bigint, length: bigint, crc: bigint"
    fields += ", ids: array<int>" if keep_ids else ""

    @F.pandas_udf(f"array<struct<{fields}>>")
    def pieces(texts: pd.Series) -> pd.Series:
        end, out = np.array([end_id], "<u4").tobytes(), []
        encode = encoder(vocabulary).encode
        for text in texts:
            ids, rows = encode(text).tobytes() + end, []
            for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                own = ids[4 * start : 4 * (start + length)]
                row = {"piece": number, "start": start, "length": length, "crc": zlib.crc32(own)}
                if keep_ids:
                    row["ids"] = np.frombuffer(own, "<i4")
                rows.append(row)
            out.append(rows)
        return pd.Series(out, dtype=object)

    return docs.select(column(id_col).alias("id"), F.inline(pieces(whole_text(text_col))))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within ``room``.

    A bitset holds the sums that the lengths so far reach, each as often as it
    is there.  Of equal sums the one with most of the largest length is taken,
    then of the next; so a choice stays the same for as long as it is available.
    """
    reach, seen, lengths = 1, [1], sorted(n for n in counts if n <= room)
    mask = (1 << room + 1) - 1
    for length in lengths:
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= reach << step * length & mask
            left, step = left - step, step * 2
        seen.append(reach)
    rest, chosen = reach.bit_length() - 1, {}
    for k in range(len(lengths) - 1, -1, -1):
        length = lengths[k]
        take = min(counts[length], rest // length)
        while not seen[k] >> rest - take * length & 1:
            take -= 1
        if take:
            chosen[length] = take
            rest -= take * length
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins by minimum slack: ``(how many of each length, number of such bins)``.

    Each bin starts with the longest piece left and takes the fullest feasible
    combination beside it.  The same combination would be chosen again for as
    long as its lengths last, so it is applied that often at once: the work
    depends on the number of lengths and not on the number of pieces.
    """
    left, bins = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest({n: c for n, c in left.items() if c}, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        bins.append((combination, times))
        for n, k in combination.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return bins


class Slots:
    """Where the pieces of each length go, as ranges of their ranks."""

    def __init__(self, bins: list[tuple[dict[int, int], int]]) -> None:
        self.first: dict[int, list[int]] = {}
        self.ranges: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for combination, times in bins:
            offset = 0
            for length in sorted(combination, reverse=True):
                many = combination[length]
                self.first.setdefault(length, []).append(used.get(length, 0))
                self.ranges.setdefault(length, []).append((sequence, many, offset))
                used[length] = used.get(length, 0) + many * times
                offset += many * length
            sequence += times
        self.sequences = sequence

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """Sequence and offset of the piece with this rank among those of its length."""
        k = bisect_right(self.first[length], rank) - 1
        sequence, many, offset = self.ranges[length][k]
        bin_, place = divmod(rank - self.first[length][k], many)
        return sequence + bin_, offset + place * length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``id``, ``piece``, ``start``, ``length``, ``crc``) and their places.

    Adds ``sequence_id`` and ``offset``.  What passes the driver is the number
    of pieces of each length, ``capacity`` rows at most, and the plan.  Pieces
    of a length are numbered in hash buckets, each by itself, and the sizes of
    the buckets before are added: a length that a third of all pieces have is
    spread like any other.
    """
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count("*").alias("n")).collect()}
    slots = Slots(plan_bins(total, capacity))
    buckets = max(16, sum(total.values()) // ROWS_PER_BUCKET)
    bucket = F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(buckets))
    pieces = pieces.withColumn("bucket", bucket)
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.expr(
        "sum(n) OVER (PARTITION BY length ORDER BY bucket "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n"
    )
    sizes = stored(sizes.withColumn("before", before).drop("n"), "packing-sizes")
    inside = F.expr(
        "row_number() OVER (PARTITION BY length, bucket ORDER BY id, piece, start, crc) - 1"
    )
    shared = pieces.sparkSession.sparkContext.broadcast(slots)

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        spots = map(shared.value.place, lengths.tolist(), ranks.tolist())
        return pd.DataFrame(list(spots), columns=["sequence_id", "offset"], dtype="int64")

    ranked = pieces.withColumn("inside", inside).join(sizes, ["length", "bucket"])
    placed = ranked.withColumn("place", place("length", F.col("inside") + F.col("before")))
    kept = [c for c in pieces.columns if c != "bucket"]
    return placed.select(*kept, "place.sequence_id", "place.offset")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: the tokens of each sequence, from pieces with ``ids``."""
    return packed.groupBy("sequence_id").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), p -> p.ids))")
        .alias("ids")
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    keep_ids: bool = True,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``id``, ``piece``, ``start``, ``length``, ``crc``,
    ``ids`` if wanted, ``sequence_id``, ``offset``.  Null and empty texts are
    the end token alone; repeated rows are packed each; other columns are not
    read; an empty table gives an empty result.
    """
    pieces = token_pieces(
        docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity, keep_ids=keep_ids
    )
    return pack(stored(pieces, "packing-pieces"), capacity)


def packed_table(docs: DataFrame) -> DataFrame:
    """The columns of the query, for any table with ``doc_id`` and ``text``."""
    packed = pack_documents(docs, vocabulary_path(), keep_ids=False)
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length",
        F.col("crc").alias("ids_crc32"), "sequence_id", "offset",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_table(table(spark, sf_dir, "documents"))
