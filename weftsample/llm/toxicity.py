"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_WORDS, column, held_out, labelled_sample, table, text_bytes

#: The query never learns from rows whose crc32(id) leaves 0 when divided by 5.
HELD_OUT = (5, 0)

#: Labelled documents that a fit uses at most.
SAMPLE_ROWS = 12_000

#: Words of a sentence at most; longer ones are several instances.
SENTENCE_WORDS = 32

#: A word is also known by its first letters, so many bytes of them.
PREFIXES = (3, 4, 5, 6)

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_NO_LETTERS = bytes(sorted(set(range(256)) - set(_LETTERS)))


@dataclass(frozen=True)
class Settings:
    """``bits``: weights are hashed to 2^bits places.  ``bias``: margin of a sentence at first.

    Features of fewer than ``least_documents``, or whose share of toxic documents
    exceeds the general one by a chi-square below ``least_chi``, get no weight.
    """

    bits: int = 18
    rate: float = 1.0
    l1: float = 0.03
    bias: float = -5.0
    epochs: int = 10
    least_documents: int = 3
    least_chi: float = 12.0
    sample_rows: int = SAMPLE_ROWS


class Words(dict):
    """Word to its number and, in the lowest bit, whether it ends a sentence.

    ``places[number]`` holds the hashed features of the word: its letters in
    lower case, and their beginnings, so that unseen compounds of a known stem
    have a score as well.
    """

    def __init__(self, bits: int) -> None:
        self.mask = (1 << bits) - 1
        self.places: list[tuple[int, ...]] = []

    def renew(self) -> None:
        """Forget all words if there are too many; numbers hold until then."""
        if len(self) > MEMO_WORDS:
            self.clear()
            self.places.clear()

    def __missing__(self, word: bytes) -> int:
        letters = word.lower().translate(None, _NO_LETTERS)
        parts = [letters, *(letters[:n] + b"-" for n in PREFIXES if len(letters) > n)]
        self.places.append(tuple(xxhash.xxh32_intdigest(p) & self.mask for p in parts))
        self[word] = both = len(self) << 1 | (word.rstrip(b"\"')]")[-1:] in b".!?")
        return both


def sentence_starts(text: bytes, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word, and where each sentence starts.

    A sentence ends after a word that ends in ``.``, ``!`` or ``?``, and after
    ``SENTENCE_WORDS`` words.
    """
    words = text.split()
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    at = np.arange(len(words))
    begins = np.ones(len(words), bool)
    begins[1:] = (both[:-1] & 1) == 1
    start = np.maximum.accumulate(np.where(begins, at, 0))
    return both >> 1, np.flatnonzero((at - start) % SENTENCE_WORDS == 0)


def instances(text: bytes, known: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of a text, each once per sentence; their sentences; the number of sentences.

    A text without words is one empty sentence.
    """
    at, starts = sentence_starts(text, known)
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    pairs = np.unique(sentence << 32 | at)
    return pairs & 0xFFFFFFFF, pairs >> 32, max(1, len(starts))


class Scorer:
    """Margins of sentences; each distinct word is weighed once."""

    def __init__(self, weights: np.ndarray, bits: int) -> None:
        self.weights, self.known = weights, Words(bits)
        self.of_word = np.zeros(0)

    def margins(self, text: bytes) -> np.ndarray:
        """Margin of each sentence: the sum of its words' weights and the bias."""
        self.known.renew()
        at, sentence, n = instances(text, self.known)
        places = self.known.places
        if len(places) < len(self.of_word):
            self.of_word = np.zeros(0)
        if len(places) > len(self.of_word):
            new = places[len(self.of_word) :]
            flat = np.fromiter((p for word in new for p in word), np.int64)
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
            sums = np.add.reduceat(self.weights[flat].astype(np.float64), np.append(0, ends[:-1]))
            self.of_word = np.append(self.of_word, sums)
        return np.bincount(sentence, self.of_word[at], n) + float(self.weights[-1])


def noisy_or(margin: np.ndarray) -> float:
    """Probability that any sentence is toxic."""
    return float(-np.expm1(-np.logaddexp(0, margin).sum()))


def fit_noisy_or(examples, settings: Settings) -> np.ndarray:
    """Weights, the bias last, from ``(text, label)`` pairs over whole texts.

    A clean document pushes each of its sentences down; a toxic one pulls up
    each sentence by its share in the document's score.  Adaptive steps with a
    soft threshold: words that tell nothing keep weight zero.
    """
    size = 1 << settings.bits
    weights, squares = np.zeros(size), np.ones(size)
    bias, bias_square = settings.bias, 1.0
    known, data, documents = Words(settings.bits), [], np.zeros((2, size))
    for text, label in examples:
        known.renew()
        words, of, n = instances(text, known)
        places = [known.places[w] for w in words.tolist()]
        at = np.fromiter((p for word in places for p in word), np.int64)
        data.append((at, np.repeat(of, [len(p) for p in places]), n, label))
        documents[label, np.unique(at)] += 1
    total = documents.sum(axis=0)
    toxic = np.mean([label for *_, label in data]) if data else 0.0
    excess = documents[1] - toxic * total
    chi = excess * excess / np.maximum(total * toxic * (1 - toxic), 1e-9)
    telling = (total >= settings.least_documents) & (excess > 0) & (chi >= settings.least_chi)
    data = [(at[telling[at]], of[telling[at]], n, label) for at, of, n, label in data]
    order = np.random.default_rng(1)
    for _ in range(settings.epochs):
        for i in order.permutation(len(data)):
            at, sentence, n, label = data[i]
            margin = np.bincount(sentence, weights[at], n) + bias
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            whole = max(noisy_or(margin), 1e-9)
            pull = -p * (1 - whole) / whole if label else p
            unique, inverse = np.unique(at, return_inverse=True)
            slope = np.bincount(inverse, pull[sentence], len(unique))
            squares[unique] += slope * slope
            pace = settings.rate / np.sqrt(squares[unique])
            moved = weights[unique] - pace * slope
            shrunk = np.abs(moved) - pace * settings.l1 * np.abs(pull).max()
            weights[unique] = np.sign(moved) * np.maximum(shrunk, 0)
            slope = pull.sum()
            bias_square += slope * slope
            bias -= settings.rate * slope / np.sqrt(bias_square)
    return np.append(weights, bias)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    without: tuple[int, int] | None = HELD_OUT,
) -> np.ndarray:
    """Learn from labelled documents outside the fold ``without``.

    The fit is one task over at most ``settings.sample_rows`` labelled rows;
    ids, languages and sources are not among its inputs.  Without any label no
    word has a weight, and each sentence scores as the bias says.
    """
    sample = labelled_sample(
        docs, labels, label_col, rows=settings.sample_rows, id_col=id_col, text_col=text_col,
        without=without,
    )

    def fit(batches):
        parts = list(batches)
        rows = pd.concat(parts) if parts else pd.DataFrame(columns=["id", "text", "label"])
        rows = rows.sort_values(["id", "label"], kind="stable")
        weights = fit_noisy_or(zip(rows["text"], rows["label"], strict=True), settings)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()]})

    fitted = sample.repartition(1).mapInPandas(fit, "weights binary").first()
    if fitted is None:
        return np.append(np.zeros(1 << settings.bits), settings.bias).astype(np.float32)
    return np.frombuffer(fitted["weights"], np.float32)


def toxicity_score(
    spark: SparkSession, weights: np.ndarray, settings: Settings = Settings(), text_col="text"
) -> Column:
    """Score of each whole text, 0 to 1; null and empty texts are one empty sentence."""
    shared = spark.sparkContext.broadcast(weights)  # 2^bits numbers
    scorer: list[Scorer] = []  # one per worker

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not scorer:
            scorer.append(Scorer(shared.value, settings.bits))
        scores = (noisy_or(scorer[0].margins(t)) for t in texts)
        return pd.Series(np.fromiter(scores, np.float64, len(texts)))

    return score(text_bytes(text_col))


def toxic_sentences(
    docs: DataFrame,
    weights: np.ndarray,
    settings: Settings = Settings(),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
) -> DataFrame:
    """Where the offence is: ``id``, ``sentence`` (number), ``first_word``, ``n_words``, ``score``, ``words``.

    One row per sentence that by itself scores ``threshold`` or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    row = "sentence: int, first_word: int, n_words: int, score: double, words: string"

    @F.pandas_udf(f"array<struct<{row}>>")
    def found(texts: pd.Series) -> pd.Series:
        scorer, out = Scorer(shared.value, settings.bits), []
        for text in texts:
            score = -np.expm1(-np.logaddexp(0, scorer.margins(text)))
            at, starts = sentence_starts(text, scorer.known)
            words, ends = text.split(), np.append(starts, len(at))
            out.append(
                [
                    {
                        "sentence": int(k),
                        "first_word": int(ends[k]),
                        "n_words": int(ends[k + 1] - ends[k]),
                        "score": float(score[k]),
                        "words": b" ".join(words[ends[k] : ends[k + 1]]).decode("utf-8", "replace"),
                    }
                    for k in np.flatnonzero(score >= threshold)
                    if len(at)
                ]
            )
        return pd.Series(out, dtype=object)

    return docs.select(column(id_col).alias("id"), F.inline(found(text_bytes(text_col))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit_toxicity(docs, labels)
    scored = docs.select(
        "doc_id",
        held_out(column("doc_id"), *HELD_OUT).alias("held_out"),
        toxicity_score(spark, weights).alias("score"),
    )
    return scored.withColumn("predicted", F.expr("cast(score >= 0.5 as int)"))
