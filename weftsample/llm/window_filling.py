"""Packing by non-negative least squares: how often each combination of lengths fills a window."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored, table, whole_text
from .packing import Slots
from .tokens import encoder, vocabulary_path

#: Token of the documents' end, and the room of a sequence, as the contract has them.
END_ID = 0
CAPACITY = 1024

#: Steps of the projected gradient; its size depends on the window and not on the data.
STEPS = 400

#: Rows that are handed back at a time.
OUT_ROWS = 20_000


def combinations(lengths: list[int], window: int) -> np.ndarray:
    """Combinations of two or three of the lengths that fill a window, padded with zero.

    For a window of 1,024 these are 87,893 at most.
    """
    there = np.zeros(window + 1, bool)
    there[[n for n in lengths if n < window]] = True
    out = [np.zeros((0, 3), np.int64)]
    for small in np.flatnonzero(there[: window // 2 + 1]):
        if there[window - small]:
            out.append(np.array([[small, window - small, 0]]))
        middle = np.arange(small, (window - small) // 2 + 1)
        middle = middle[there[middle] & there[window - small - middle]]
        third = window - small - middle
        out.append(np.stack([np.full_like(middle, small), middle, third], axis=1))
    return np.concatenate(out)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with the least squares of (lengths that x combinations use) - histogram.

    Projected gradient with momentum; a combination touches three lengths, so a
    step is two gathers over the combinations.
    """

    def used(x):
        total = np.bincount(combos.ravel(), np.repeat(x, 3), len(histogram))
        total[0] = 0  # the padding
        return total

    def gradient(rest):
        return rest[combos].sum(axis=1)

    scale = max(histogram.max(), 1.0)
    goal = histogram / scale
    vector = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue bounds the step
        vector = gradient(used(vector))
        vector /= np.linalg.norm(vector)
    step = 1 / (1.02 * np.linalg.norm(gradient(used(vector))))
    x = ahead = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(ahead - step * gradient(used(ahead) - goal), 0)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / next_momentum * (new - x)
        x, momentum = new, next_momentum
    return x * scale


def fill_windows(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Combinations that fill a window and how often each is used; never more than there are.

    Repeat counts are rounded down, the largest first; what then is left fills
    more windows for as long as some combination can be made of it.
    """
    combos = combinations(list(counts), window)
    if not len(combos):
        return []
    histogram = np.zeros(window + 1)
    for length, count in counts.items():
        histogram[length] = count
    wanted = repeat_counts(combos, histogram)
    left, times = dict(counts), np.zeros(len(combos), np.int64)
    order = np.argsort(-wanted, kind="stable")
    needs = [dict(zip(*np.unique(c[c > 0], return_counts=True), strict=True)) for c in combos]
    for rounding in (True, False):
        for k in order.tolist():
            most = min(left[n] // need for n, need in needs[k].items())
            take = min(most, int(wanted[k])) if rounding else most
            if take:
                times[k] += take
                for n, need in needs[k].items():
                    left[n] -= need * take
    return [
        ({int(n): int(need) for n, need in needs[k].items()}, int(times[k]))
        for k in order.tolist()
        if times[k]
    ]


class Plan:
    """Where every remainder goes: a place in a combination, or a stretch of the residual stream.

    Lengths that fill no window stand one after the other in a stream that is
    cut at each window's end.  Its last window is cut into powers of two, which
    need no padding, so no sequence is padded.
    """

    def __init__(self, counts: dict[int, int], window: int) -> None:
        bins = fill_windows(counts, window)
        self.window, self.slots = window, Slots(bins)
        self.combined: dict[int, int] = {}
        for combination, times in bins:
            for n, k in combination.items():
                self.combined[n] = self.combined.get(n, 0) + k * times
        self.base, total = {}, 0
        for n in sorted(counts, reverse=True):
            self.base[n] = total
            total += n * (counts[n] - self.combined.get(n, 0))
        self.full = total // window
        # Ends of the stream's last sequences, and the number of all planned ones.
        self.ends, at = [], self.full * window
        for bit in reversed(range(window.bit_length())):
            if total - self.full * window >> bit & 1:
                at += 1 << bit
                self.ends.append(at)
        self.sequences = self.slots.sequences + self.full + len(self.ends)

    def pieces(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` of a remainder's pieces, by its rank."""
        if rank < self.combined.get(length, 0):
            yield 0, length, *self.slots.place(length, rank)
            return
        at = self.base[length] + (rank - self.combined.get(length, 0)) * length
        start, end = 0, at + length
        while at < end:
            if at < self.full * self.window:
                number, offset = divmod(at, self.window)
                stop = (number + 1) * self.window
            else:
                k = next(k for k, stop in enumerate(self.ends) if at < stop)
                stop = self.ends[k]
                begin = self.ends[k - 1] if k else self.full * self.window
                number, offset = self.full + k, at - begin
            size = min(stop, end) - at
            yield start, size, self.slots.sequences + number, offset
            start, at = start + size, at + size


def _encoded(vocabulary: str, capacity: int, end_id: int):
    """Tokens of a task's documents, numbered inside the task.

    ``rank``: how many earlier ones have the same remainder; ``windows``: whole
    windows of earlier ones.
    """

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        width = "<u2" if max(own.size, end_id + 1) <= 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        seen, windows = np.zeros(capacity, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for text in batch.column("text").to_pylist():
                ids = np.append(own.encode(text), end_id).astype(width)
                rest = len(ids) % capacity
                rows.append((part, len(ids), rest, int(seen[rest]), windows, ids.tobytes()))
                seen[rest] += 1
                windows += len(ids) // capacity
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            names = ["id", "part", "tokens", "rest", "rank", "windows", "ids"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    return encoded


def _placed(shared, capacity: int, keep_ids: bool):
    """One row per piece of the documents of a batch."""

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            names = ["tokens", "rest", "rank", "windows", "ids"]
            whole = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            rows, owners = [], []

            def flush():
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * keep_ids
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_tokens", "start", "length", "crc", "sequence_id", "offset", "ids"]
                ids = batch.column("id").take(pa.array(owners))
                return pa.RecordBatch.from_arrays([ids, *columns], names=["id", *names[: len(kinds)]])

            for place, (tokens, rest, rank, windows, packed) in enumerate(whole):
                ids = np.frombuffer(packed, "<u2" if len(packed) == 2 * tokens else "<u4")
                cuts = [
                    (k * capacity, capacity, plan.sequences + windows + k, 0)
                    for k in range(tokens // capacity)
                ]
                if rest:
                    first = tokens - rest
                    cuts += [(first + s, *other) for s, *other in plan.pieces(rest, rank)]
                for start, length, sequence, offset in cuts:
                    own = ids[start : start + length].astype("<u4")
                    row = (tokens, start, length, zlib.crc32(own.tobytes()), sequence, offset)
                    rows.append((*row, own.astype("<i4")) if keep_ids else row)
                    owners.append(place)
                if len(rows) >= OUT_ROWS:
                    yield flush()
                    rows.clear()
                    owners.clear()
            if rows:
                yield flush()

    return placed


def fill_sequences(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
) -> DataFrame:
    """Pack all documents, each with the end token, into sequences without padding.

    One row per piece: ``id``, ``doc_tokens``, ``start``, ``length``, ``crc``,
    ``sequence_id``, ``offset``, and ``ids`` if wanted.  Whole windows of a
    document are sequences of their own.  What remains, shorter than a window,
    is combined with one or two others that fill a window with it; least squares
    on the counts of lengths say how often each combination is used.  The rest
    is cut where windows end.

    Null and empty texts are the end token alone; repeated rows are packed each;
    a text of any length is cut as often as needed; other columns are not read;
    an empty table gives an empty result.

    The driver sees the number of remainders of each length, ``capacity`` rows
    at most.  Documents are numbered by the tasks that encode them, and a
    length's numbers of the tasks before are added, so no length is sorted or
    brought together, however many documents have it.
    """
    rows = docs.select(column(id_col).alias("id"), whole_text(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    fields = f"id {id_type}, part long, tokens long, rest long, rank long, windows long, ids binary"
    coded = stored(
        rows.mapInArrow(_encoded(vocabulary, capacity, end_id), fields), "filling-tokens"
    )
    sizes = stored(
        coded.groupBy("part", "rest").agg(
            F.count("*").alias("n"), F.sum(F.expr(f"tokens div {capacity}")).alias("w")
        ),
        "filling-sizes",
    )
    totals = sizes.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()
    plan = Plan({r["rest"]: r["n"] for r in totals}, capacity)
    shared = coded.sparkSession.sparkContext.broadcast(plan)  # bounded by the combinations

    ranks = sizes.selectExpr(
        "part", "rest", "sum(n) OVER (PARTITION BY rest ORDER BY part) - n AS rank_before"
    )
    # One row per task.
    parts = sizes.groupBy("part").agg(F.sum("w").alias("w")).selectExpr(
        "part", "sum(w) OVER (ORDER BY part) - w AS windows_before"
    )
    before = ranks.join(parts, "part")
    whole = coded.join(before, ["part", "rest"]).select(
        "id", "tokens", "rest", F.expr("rank + rank_before").alias("rank"),
        F.expr("windows + windows_before").alias("windows"), "ids",
    )
    schema = (
        f"id {id_type}, doc_tokens long, start long, length long, crc long, "
        "sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    )
    return whole.mapInArrow(_placed(shared, capacity, keep_ids), schema)


def op13_window_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = fill_sequences(docs, vocabulary_path(), keep_ids=False)
    return packed.select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
