"""Quality rules: boosted trees over document statistics, scored as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, column, labelled_sample, table, text_bytes

#: The signs that count as symbols, and the window of repeated words.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: A document fails the base rules below so many words, or above this share.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

#: Labelled documents that a fit uses at most, and the fold it never sees, as for the classifier.
SAMPLE_ROWS = 12_000
HELD_OUT = (3, 1)

#: What the trees see, and the direction in which a feature may move the score:
#: -1 never up, 1 never down, 0 either.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "same_as_last_share": -1,
    "distinct_word_share": 0,
    "upper_share": -1,
    "digit_share": -1,
    "exclamations_per_word": -1,
    "stops_per_word": 0,
}

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".?"


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that a text holds twice or more.

    ``numbers`` are the words' numbers in the text, so equal windows are found
    exactly: they are packed into 64 bits where they fit, else numbered anew
    word by word.
    """
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    bits = int(numbers.max()).bit_length()
    if bits * window <= 63:
        keys = np.zeros(n, np.int64)
        for k in range(window):
            keys = keys << bits | numbers[k : k + n]
    else:
        keys, size = numbers[:n], int(numbers.max()) + 1
        for k in range(1, window):
            _, keys = np.unique(keys * size + numbers[k : k + n], return_inverse=True)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.zeros(len(numbers) + 1, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    starts[at] += 1
    np.subtract.at(starts, at + window, 1)
    return int((np.cumsum(starts) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Counts of the base rules, and the features of the trees, of one whole text."""
    words = text.split()
    n = len(words)
    number: dict[bytes, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    signs = text.translate(None, SPACES)
    chars = len(signs.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(numbers)
    per_word, per_sign = 1 / max(1, n), 1 / max(1, len(signs))
    same = int((numbers[1:] == numbers[:-1]).sum())
    features = [
        np.log1p(n),
        chars * per_word,
        symbols * per_word,
        dup_lines / max(1, len(lines)),
        repeats * per_word,
        same * per_word,
        len(number) * per_word,
        (len(signs) - len(signs.translate(None, _UPPER))) * per_sign,
        (len(signs) - len(signs.translate(None, _DIGITS))) * per_sign,
        signs.count(b"!") * per_word,
        (len(signs) - len(signs.translate(None, _STOPS))) * per_word,
    ]
    return [n, chars, symbols, dup_lines, repeats], features


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    l2: float = 1.0
    least_hessian: float = 1.0
    least_gain: float = 1e-3
    sample_rows: int = SAMPLE_ROWS


@dataclass(frozen=True)
class Forest:
    """Full binary trees, flattened: node k has the children 2k+1 and 2k+2.

    ``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees,
    leaves).  A value up to the threshold goes left; a node without a split has
    an infinite threshold.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Margin of each row of features, all trees at once."""
        trees = np.arange(len(self.leaf))
        inner = self.threshold.shape[1]
        out = np.full(len(rows), self.base)
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            node = np.zeros((len(part), len(trees)), np.int64)
            pick = np.arange(len(part))[:, None]
            while inner and node[0, 0] < inner:
                feature = self.feature[trees, node]
                right = part[pick, feature] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[at : at + 4096] += self.leaf[trees, node - inner].sum(axis=1)
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def fit_forest(
    rows: np.ndarray, labels: np.ndarray, directions: list[int], settings: Settings
) -> Forest:
    """Newton boosting of logistic loss over feature histograms.

    A constrained feature may only split where the child on the allowed side
    has the larger value, and the middle of the two bounds both subtrees; so
    the sum of trees is monotonic in it.
    """
    inner, leaves = 2**settings.depth - 1, 2**settings.depth
    shape = (settings.trees, inner)
    feature, threshold = np.zeros(shape, np.int64), np.full(shape, np.inf)
    leaf = np.zeros((settings.trees, leaves))
    if not len(rows):
        return Forest(0.0, feature, threshold, leaf)
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    steps = np.linspace(0, 1, settings.bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(column, steps)) for column in rows.T]
    # A value equal to a cut lies left of it.
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, rows.T, strict=True)])
    margin = np.full(len(rows), base)
    for tree in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - labels, p * (1 - p)
        node = np.zeros(len(rows), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(inner):
            inside = np.flatnonzero(node == k)
            split = _best_split(
                binned[:, inside], gradient[inside], hessian[inside], cuts, directions,
                bounds[k], settings,
            )
            low, high = bounds[k]
            bounds[2 * k + 1] = bounds[2 * k + 2] = bounds[k]
            right = np.zeros(len(inside), bool)
            if split:
                f, cut, middle = split
                feature[tree, k], threshold[tree, k] = f, cuts[f][cut]
                right = binned[f, inside] > cut
                if directions[f]:
                    small, large = (low, middle), (middle, high)
                    order = (small, large) if directions[f] > 0 else (large, small)
                    bounds[2 * k + 1], bounds[2 * k + 2] = order
            node[inside] = 2 * k + 1 + right
        for k in range(leaves):
            inside = node == inner + k
            value = -gradient[inside].sum() / (hessian[inside].sum() + settings.l2)
            leaf[tree, k] = settings.rate * np.clip(value, *bounds[inner + k])
        margin += leaf[tree, node - inner]
    return Forest(base, feature, threshold, leaf)


def _best_split(binned, gradient, hessian, cuts, directions, bounds, s: Settings):
    """Feature, cut and middle value of the split of largest gain that keeps the directions."""
    best, found = s.least_gain, None
    total_g, total_h = gradient.sum(), hessian.sum()
    for f, own in enumerate(cuts):
        if not len(own):
            continue
        g = np.cumsum(np.bincount(binned[f], gradient, len(own) + 1))[:-1]
        h = np.cumsum(np.bincount(binned[f], hessian, len(own) + 1))[:-1]
        left = np.clip(-g / (h + s.l2), *bounds)
        right = np.clip(-(total_g - g) / (total_h - h + s.l2), *bounds)
        gain = _gain(g, h, left, s) + _gain(total_g - g, total_h - h, right, s)
        whole = np.clip(-total_g / (total_h + s.l2), *bounds)
        gain -= _gain(total_g, total_h, whole, s)
        allowed = (h >= s.least_hessian) & (total_h - h >= s.least_hessian)
        allowed &= directions[f] * (right - left) >= 0
        gain = np.where(allowed, gain, -np.inf)
        cut = int(np.argmax(gain))
        if gain[cut] > best:
            best, found = gain[cut], (f, cut, float(left[cut] + right[cut]) / 2)
    return found


def _gain(g, h, value, s: Settings):
    return -(g * value + 0.5 * (h + s.l2) * value * value)


def fit_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    without: tuple[int, int] | None = HELD_OUT,
) -> Forest:
    """Learn from labelled documents outside the fold ``without``.

    Statistics are taken where the documents lie; the fit is one task over at
    most ``settings.sample_rows`` rows of them.  Without any label every score
    is 0.5 and every document that passes the base rules is kept.
    """
    sample = labelled_sample(
        docs, labels, label_col, rows=settings.sample_rows, id_col=id_col, text_col=text_col,
        without=without,
    )

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: statistics(t)[1])

    measured = sample.select("id", "label", features("text").alias("features"))
    shapes = [("feature", np.int64), ("threshold", np.float64), ("leaf", np.float64)]

    def fit(batches):
        parts = list(batches)
        if parts:
            rows = pd.concat(parts).sort_values(["id", "label"], kind="stable")
            values, known = np.array(rows["features"].tolist()), rows["label"].to_numpy(float)
            forest = fit_forest(values, known, list(FEATURES.values()), settings)
            arrays = {name: getattr(forest, name).tobytes() for name, _ in shapes}
            yield pd.DataFrame([{"base": forest.base, **arrays}])

    row = measured.repartition(1).mapInPandas(
        fit, "base double, feature binary, threshold binary, leaf binary"
    ).first()
    if row is None:
        return fit_forest(np.zeros((0, len(FEATURES))), np.zeros(0), [], settings)
    trees = [np.frombuffer(row[name], kind).reshape(settings.trees, -1) for name, kind in shapes]
    return Forest(row["base"], *trees)


def quality_verdicts(
    docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, counts of the base rules, ``base_failed``, ``score`` and ``kept`` of each row.

    Null texts have no words and fail.  A document is kept if it passes the
    base rules and the trees score it 0.5 or more.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # bounded by Settings
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = ", ".join(f"{c} bigint" for c in counts)

    @F.pandas_udf(f"{fields}, score double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        found = [statistics(t) for t in texts]
        out = pd.DataFrame([c for c, _ in found], columns=counts, dtype="int64")
        features = np.array([f for _, f in found]).reshape(-1, len(FEATURES))
        out["score"] = shared.value.score(features)
        return out

    found = docs.select(column(id_col).alias("id"), measured(text_bytes(text_col)).alias("m"))
    failed = F.expr(
        f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"
    )
    return (
        found.select("id", "m.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", F.expr("NOT base_failed AND score >= 0.5"))
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality_verdicts(docs, fit_quality_rules(docs, labels))
    return found.withColumnRenamed("id", "doc_id")
