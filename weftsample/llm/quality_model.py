"""Quality classifier: hashed word n-grams, logistic regression by FTRL."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_WORDS, column, held_out, labelled_sample, table, text_bytes

#: The query never learns from rows whose crc32(id) leaves 1 when divided by 3.
HELD_OUT = (3, 1)

#: Labelled documents that a fit uses at most.
SAMPLE_ROWS = 12_000


@dataclass(frozen=True)
class Settings:
    """``bits``: weights are hashed to 2^bits places.  The rest is FTRL's."""

    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 1.0
    epochs: int = 4
    scale: float = 10.0
    sample_rows: int = SAMPLE_ROWS


def _shape_table() -> bytes:
    """Byte to its kind: letters by case, digits, other signs as they are."""
    kinds = bytearray(range(256))
    for c in range(256):
        if 48 <= c < 58:
            kinds[c] = ord("0")
        elif 65 <= c < 91:
            kinds[c] = ord("A")
        elif 97 <= c < 123 or c >= 128:
            kinds[c] = ord("a")
    return bytes(kinds)


_SHAPES = _shape_table()
_RUN = re.compile(rb"(.)\1+", re.S)


class WordHashes(dict):
    """Word to two hashes in one number: the word's own, and that of its shape."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPES))
        both = xxhash.xxh32_intdigest(word) << 32 | xxhash.xxh32_intdigest(shape[:16], 7)
        self[word] = both
        return both


def places(text: bytes, hashes: WordHashes, bits: int) -> np.ndarray:
    """Hashed n-grams of a text: words, pairs of words, pairs and triples of word shapes.

    A pair of shapes also knows whether its words are the same.
    """
    words = text.split()
    n = len(words)
    both = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    grams = [_mix(word, 1, bits)]
    if n > 1:
        same = (word[1:] == word[:-1]).astype(np.uint64)
        pair = word[:-1] * np.uint64(0x85EBCA6B) + word[1:]
        shapes = shape[:-1] * np.uint64(0xC2B2AE35) + shape[1:] * np.uint64(5) + same
        grams += [_mix(pair, 2, bits), _mix(shapes, 3, bits)]
        if n > 2:
            triple = shapes[:-1] * np.uint64(0x27D4EB2F) + shape[2:]
            grams.append(_mix(triple, 4, bits))
    return np.concatenate(grams)


def _mix(keys: np.ndarray, kind: int, bits: int) -> np.ndarray:
    salt = np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)
    mixed = (keys + salt) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - bits)).astype(np.int64)


def fit_ftrl(examples, settings: Settings) -> np.ndarray:
    """Weights, the bias last.  ``examples``: (text, label) pairs, whole texts.

    Features are the shares of each n-gram in its document, times ``scale``.
    Follow-the-regularised-leader: each step first takes the weights that z
    and n stand for, then adds the gradient to both.
    """
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    hashes, data = WordHashes(), []
    for text, label in examples:
        at, counts = np.unique(places(text, hashes, settings.bits), return_counts=True)
        share = settings.scale * counts / max(1, counts.sum())
        data.append((np.append(at, size).astype(np.int32), np.append(share, 1.0), label))
    order = np.random.default_rng(1)
    for _ in range(settings.epochs):
        for i in order.permutation(len(data)):
            at, value, label = data[i]
            weight = _weights(z[at], n[at], settings)
            gradient = (_sigmoid(weight @ value) - label) * value
            square = gradient * gradient
            pace = (np.sqrt(n[at] + square) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - pace * weight
            n[at] += square
    return _weights(z, n, settings)


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    # Shares are small, so the first penalty is scaled to them.
    l1 = s.l1 / 100
    shrunk = np.sign(z) * l1 - z
    return np.where(np.abs(z) <= l1, 0.0, shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2 / 100))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    without: tuple[int, int] | None = HELD_OUT,
) -> np.ndarray:
    """Learn from labelled documents outside the fold ``without``.

    The fit is one task over at most ``settings.sample_rows`` labelled rows;
    ids, languages and sources are not among its inputs.  Without any label all
    weights are zero, and each score is 0.5.
    """
    sample = labelled_sample(
        docs, labels, label_col, rows=settings.sample_rows, id_col=id_col, text_col=text_col,
        without=without,
    )

    def fit(batches):
        parts = list(batches)
        rows = pd.concat(parts) if parts else pd.DataFrame(columns=["id", "text", "label"])
        rows = rows.sort_values(["id", "label"], kind="stable")
        weights = fit_ftrl(zip(rows["text"], rows["label"], strict=True), settings)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()]})

    fitted = sample.repartition(1).mapInPandas(fit, "weights binary").first()
    if fitted is None:
        return np.zeros((1 << settings.bits) + 1, np.float32)
    return np.frombuffer(fitted["weights"], np.float32)


_HASHES = WordHashes()


def quality_score(
    spark: SparkSession, weights: np.ndarray, settings: Settings = Settings(), text_col="text"
) -> Column:
    """Score of each whole text, 0 to 1: the sparse dot product with the weights.

    Null counts as empty; an empty text scores as the bias says.
    """
    shared = spark.sparkContext.broadcast(weights)  # 2^bits numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weight = shared.value

        def margin(text: bytes) -> float:
            at = places(text, _HASHES, settings.bits)
            total = settings.scale * float(weight[at].mean(dtype=np.float64)) if len(at) else 0.0
            return total + float(weight[-1])

        margins = np.fromiter(map(margin, texts), np.float64, len(texts))
        return pd.Series(_sigmoid(margins))

    return score(text_bytes(text_col))


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, all columns kept."""
    weights = fit_quality(docs, labels, settings, text_col=text_col)
    score = quality_score(docs.sparkSession, weights, settings, text_col)
    return docs.filter(score >= 0.5)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit_quality(docs, labels)
    scored = docs.select(
        "doc_id",
        held_out(column("doc_id"), *HELD_OUT).alias("held_out"),
        quality_score(spark, weights).alias("score"),
    )
    return scored.withColumn("predicted", F.expr("cast(score >= 0.5 as int)"))
