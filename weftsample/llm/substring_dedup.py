"""Substring dedup: automata of confirmed recurring phrases locate repeated passages."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MEMO_WORDS, column, stored, table, text_bytes

#: Words of a window, and of a phrase.  Every window holds one chosen phrase.
WINDOW = 50
PHRASE = 8

#: Text of one shard of documents, and with it the size of its automaton.
SHARD_BYTES = 8_000_000

#: Hash buckets of documents with candidates; the size of the broadcast, whatever the data.
ID_BUCKETS = 1 << 18

#: Window starts that are minimised at a time; bounds memory for very long texts.
BLOCK = 1 << 15

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Word to a 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def chosen_phrases(words: list[bytes], window: int = WINDOW, phrase: int = PHRASE) -> np.ndarray:
    """For each window, the position of its chosen phrase: that of least hash, leftmost of equals.

    The choice depends on the words of the window alone, so equal windows of any
    two documents choose the same phrase at the same place.
    """
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    count = len(words) - phrase + 1
    keys = np.zeros(count, np.uint64)
    for k in range(phrase):
        keys = keys * _MULTIPLIER + hashes[k : k + count]
    keys ^= keys >> np.uint64(31)
    keys *= _MULTIPLIER
    span = window - phrase + 1
    out = np.empty(n, np.int64)
    for at in range(0, n, BLOCK):
        part = keys[at : min(n, at + BLOCK) + span - 1]
        least = np.lib.stride_tricks.sliding_window_view(part, span).argmin(axis=1)
        out[at : at + len(least)] = least + np.arange(at, at + len(least))
    return out


def _phrases(texts: pd.Series) -> pd.DataFrame:
    """Chosen phrases of each text, each once, and half of the key of its words."""
    rows = []
    for text in texts:
        words = text.split()
        places = np.unique(chosen_phrases(words)).tolist()
        chosen = list({b" ".join(words[p : p + PHRASE]) for p in places})
        rows.append((_key(words)[0], chosen))
    return pd.DataFrame(rows, columns=["high", "phrases"])


def _key(words: list[bytes]) -> tuple[int, int]:
    """128 bits that stand for the words of a text, as two signed numbers."""
    key = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (key >> 64) - 2**63, (key & (1 << 64) - 1) - 2**63


def _automaton(phrases: list[bytes]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in phrases:
        # Spaces on both sides: whole words only.
        padded = " " + _text(phrase) + " "
        found.add_word(padded, len(padded))
    found.make_automaton()
    return found


def _text(words: bytes) -> str:
    return words.decode("utf-8", "surrogateescape")


def _occurrences(words: list[bytes], phrases: ahocorasick.Automaton) -> np.ndarray:
    """Positions of the words at which any of the phrases occurs."""
    text = " " + _text(b" ".join(words)) + " "
    begins = [end - length + 1 for end, length in phrases.iter(text)]
    starts = np.cumsum([0] + [len(w) + 1 for w in text[1:-1].split(" ")])
    return np.searchsorted(starts, np.array(begins, np.int64))


def _blocks_of(text: bytes, phrases: ahocorasick.Automaton) -> list[dict]:
    """Runs of windows that choose the same recurring phrase, as content hashes."""
    words = text.split()
    chosen = chosen_phrases(words)
    if not len(chosen):
        return []
    recurring = np.zeros(len(words) + 1, bool)
    recurring[_occurrences(words, phrases)] = True
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends, out = ends.tolist(), []
    for start, stop in zip(first.tolist(), last.tolist(), strict=True):
        at = int(chosen[start])
        if not recurring[at]:
            continue
        windows = [
            xxhash.xxh3_64_intdigest(joined[begins[i] : ends[i + WINDOW - 1]])
            for i in range(start, stop)
        ]
        whole = joined[begins[start] : ends[stop + WINDOW - 2]]
        phrase = joined[begins[at] : ends[at + PHRASE - 1]]
        out.append(
            {
                "start": start,
                "n": stop - start,
                "phrase": xxhash.xxh3_64_intdigest(phrase) - 2**63,
                "block": xxhash.xxh3_128_digest(whole + b" %d" % (at - start)),
                "windows": (np.array(windows, np.uint64)).view(np.int64),
            }
        )
    return out


BLOCK_FIELDS = (
    "id bigint, text_hash bigint, start int, n int, phrase bigint, block binary, "
    "windows array<bigint>"
)


def _content(texts: pd.Series) -> pd.DataFrame:
    """The key of the words of a text, and how many they are."""
    rows = []
    for text in texts:
        words = text.split()
        rows.append((*_key(words), len(words)))
    return pd.DataFrame(rows, columns=["high", "low", "n_words"])


def repeated_ranges(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Where windows repeat that start in a document of a smaller id.

    Returns ranges of words per document, ``id``, ``text_hash``, ``ranges``
    (array of ``first``, ``stop``; they may overlap), and the hash buckets of
    ids outside which no document has any.

    1. Documents of the same words are one: the smallest id stands for them, and
       the others lose all their words if they have a window.
    2. Each document gives its chosen phrases; phrases of two documents of
       different words are confirmed by their full words.
    3. Documents are dealt into shards by a hash of their id.  A shard compiles
       an automaton of the confirmed phrases that its own documents chose, so
       the automata together grow with the corpus and each is bounded by its
       shard; the documents are streamed through it.
    4. At each occurrence that is a window's choice, the run of windows with
       this choice is a block.  Equal blocks need one row to tell the smallest
       id; the windows of different blocks of a phrase are compared one by one.

    A phrase, block or window that many documents share is folded per task
    before it is shuffled.  Rows without an id neither lose nor remove words.
    """
    id_ = column(id_col).cast("bigint")
    texts = docs.select(id_.alias("id"), text_bytes(text_col).alias("text"))
    texts = texts.filter("id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))

    content = F.pandas_udf(_content, "high bigint, low bigint, n_words bigint")
    units = texts.select("id", "text_hash", content("text").alias("c")).select(
        "id", "text_hash", "c.*"
    )
    units = stored(units.filter(F.col("n_words") >= WINDOW), "substring-units")
    least = units.groupBy("high", "low").agg(F.min("id").alias("least"))
    least = stored(least, "substring-first")
    copies = units.join(least, ["high", "low"]).filter("least < id")
    copies = copies.select(
        "id", "text_hash", F.lit(0).alias("first"), F.col("n_words").cast("int").alias("stop")
    )

    phrases_of = F.pandas_udf(_phrases, "high bigint, phrases array<binary>")
    phrases = texts.select("id", phrases_of("text").alias("p"))
    phrases = phrases.select("id", "p.high", F.explode("p.phrases").alias("phrase"))
    phrases = stored(phrases, "substring-phrases")
    confirmed = phrases.groupBy("phrase").agg(F.min("high").alias("a"), F.max("high").alias("b"))
    confirmed = stored(confirmed.filter("a < b").select("phrase"), "substring-confirmed")
    first = least.select("high", F.col("least").alias("id"))
    hits = phrases.join(confirmed, "phrase").join(first, ["high", "id"], "left_semi")
    hits = stored(hits.select("id", "phrase"), "substring-hits")

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    suspects = texts.join(
        F.broadcast(_buckets(hits)), id_bucket(F.col("id")) == F.col("bucket"), "left_semi"
    ).select("id", "text_hash", "text", shard.alias("shard"))

    def locate(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found, wanted = [], set(own["id"])
        automaton = _automaton(own["phrase"].unique().tolist()) if wanted else None
        for row in rows.itertuples(index=False):
            if row.id in wanted:
                for block in _blocks_of(row.text, automaton):
                    found.append({"id": row.id, "text_hash": row.text_hash, **block})
        names = ["id", "text_hash", "start", "n", "phrase", "block", "windows"]
        return pd.DataFrame(found, columns=names)

    blocks = (
        hits.withColumn("shard", shard)
        .groupBy("shard")
        .cogroup(suspects.groupBy("shard"))
        .applyInPandas(locate, BLOCK_FIELDS)
    )
    blocks = stored(blocks, "substring-blocks")
    narrow = blocks.select("id", "text_hash", "start", "n", "phrase", "block")
    smallest = narrow.groupBy("phrase", "block").agg(F.min("id").alias("least"))
    smallest = stored(smallest, "substring-smallest")
    known = narrow.join(smallest, ["phrase", "block"])
    whole = known.filter("least < id").select(
        "id", "text_hash", F.col("start").alias("first"),
        (F.col("start") + F.col("n") + (WINDOW - 1)).alias("stop"),
    )

    # The first document of a block stands for all that have it.
    several = smallest.groupBy("phrase").agg(F.count("*").alias("n")).filter("n > 1")
    firsts = known.filter("least = id").join(several.select("phrase"), "phrase", "left_semi")
    firsts = stored(firsts.select("id", "text_hash", "start"), "substring-firsts")
    windows = blocks.join(firsts, ["id", "text_hash", "start"], "left_semi").select(
        "id", "text_hash", "phrase", "start", F.posexplode("windows").alias("at", "window")
    )
    windows = windows.select(
        # 128 bits: a window is equal if its phrase and its words are.
        F.xxhash64("phrase", "window").alias("key"), "window", "id", "text_hash",
        (F.col("start") + F.col("at")).alias("first"),
    )
    windows = stored(windows, "substring-windows")
    shared = windows.groupBy("key", "window").agg(
        F.min("id").alias("least"), F.max("id").alias("most")
    )
    shared = stored(shared.filter("least < most").select("key", "window", "least"), "substring-shared")
    single = (
        windows.join(shared, ["key", "window"])
        .filter("least < id")
        .select("id", "text_hash", "first", (F.col("first") + WINDOW).alias("stop"))
    )
    ranges = copies.unionByName(whole).unionByName(single).groupBy("id", "text_hash")
    ranges = ranges.agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))
    ranges = stored(ranges, "substring-ranges")
    return ranges, _buckets(ranges)


def _buckets(rows: DataFrame) -> DataFrame:
    """Hash buckets of the ids: at most ``ID_BUCKETS`` rows."""
    return stored(rows.select(id_bucket(F.col("id")).alias("bucket")).distinct(), "substring-ids")


def id_bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(ID_BUCKETS))


def kept_words(text: bytes, ranges) -> tuple[list[bytes], int]:
    """Words outside the ranges, and how many words the text has."""
    words = text.split()
    if ranges is None or not len(ranges):
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        change[r["first"]] += 1
        change[r["stop"]] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], len(words)


def _with_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, ``ranges`` of each row; rows without any never leave their scan."""
    ranges, buckets = repeated_ranges(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(column(id_col).alias("id"), text_bytes(text_col).alias("text"))
    key = id_bucket(F.col("id").cast("bigint"))
    near = F.broadcast(buckets)
    suspects = rows.join(near, key == F.col("bucket"), "left_semi")
    others = rows.join(near, key == F.col("bucket"), "left_anti")
    found = suspects.withColumn("text_hash", F.xxhash64("text"))
    found = found.join(ranges, ["id", "text_hash"], "left").select("id", "text", "ranges")
    none = F.lit(None).cast("array<struct<first: int, stop: int>>")
    return found.unionByName(others.withColumn("ranges", none))


def without_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``text`` (kept words joined by a space), ``n_words``, ``n_removed`` of each row."""

    @F.pandas_udf("text string, n_words bigint, n_removed bigint")
    def kept(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, ranges, strict=True):
            words, n = kept_words(text, own)
            rows.append((b" ".join(words).decode("utf-8", "replace"), n, n - len(words)))
        return pd.DataFrame(rows, columns=["text", "n_words", "n_removed"])

    rows = _with_ranges(docs, id_col, text_col)
    return rows.select("id", kept("text", "ranges").alias("kept")).select("id", "kept.*")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def digests(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, ranges, strict=True):
            words, n = kept_words(text, own)
            rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    rows = _with_ranges(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = rows.select(F.col("id").alias("doc_id"), digests("text", "ranges").alias("found"))
    return found.select("doc_id", "found.*")
