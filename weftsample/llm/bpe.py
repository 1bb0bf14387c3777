"""Byte-level BPE in two tiers: a minimal perfect hash, then a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table, whole_text

#: Bytes of chunks and of pre-tokens that a worker remembers; texts longer than this are not.
CHUNK_BYTES, WORD_BYTES, LONGEST_KNOWN = 128 << 20, 128 << 20, 64

#: Cuts where one space stands between two signs that are not white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)").split
ODD_SPACE = re.compile(r"\s | \s").search


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of byte strings by displacement, with its keys and values.

    Keys fall into buckets of two on average; the fullest first, each bucket
    gets a displacement that puts its keys on free places.  A bucket of one key
    stores its place directly.  A lookup is one hash, one displacement and one
    comparison with the key at the place.
    """

    def __init__(self, items: dict[bytes, int]) -> None:
        self.size, self.buckets = len(items), max(1, len(items) // 2)
        hashes = {key: xxhash.xxh3_64_intdigest(key) for key in items}
        if len(set(hashes.values())) < self.size:
            raise ValueError("two keys have the same hash")
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key, h in hashes.items():
            groups[h % self.buckets].append(key)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.size
        self.values = [0] * self.size
        free = 0
        for group in sorted(groups, key=len, reverse=True):
            if not group:
                break
            bucket = hashes[group[0]] % self.buckets
            if len(group) == 1:
                while self.keys[free] is not None:
                    free += 1
                places = [free]
                self.shift[bucket] = -free - 1
            else:
                shift = 0
                while True:
                    places = [self._place(hashes[key], shift) for key in group]
                    if len(set(places)) == len(group) and all(
                        self.keys[p] is None for p in places
                    ):
                        break
                    shift += 1
                self.shift[bucket] = shift
            for key, place in zip(group, places, strict=True):
                self.keys[place], self.values[place] = key, items[key]

    def _place(self, h: int, shift: int) -> int:
        mixed = (h ^ shift * 0x9E3779B97F4A7C15) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
        return (mixed >> 32) * self.size >> 32

    def get(self, key: bytes) -> int | None:
        if not self.size:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.buckets]
        place = -shift - 1 if shift < 0 else self._place(h, shift)
        return self.values[place] if self.keys[place] == key else None


def merge_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """The token that two tokens side by side make, by ``left << 32 | right``."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    return pairs


def merge_bytes(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of a pre-token from those of its bytes: always the pair of lowest rank is
    merged, the leftmost of equals.

    The parts are a linked list over byte positions.  The heap holds rank and
    position of a pair as one integer; an entry is stale once its left part is
    gone or the pair there makes another token.
    """
    n, get, pop, push = len(ids), pairs.get, heappop, heappush
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    # Token of the pair that starts at each position; -1 where there is none.
    made = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
    made.append(-1)
    heap = [rank << 32 | i for i, rank in enumerate(made) if rank >= 0]
    heapify(heap)
    while heap:
        entry = pop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        if made[i] != rank:
            continue
        j = after[i]
        end = after[j]
        ids[i], after[i] = rank, end
        made[i] = made[j] = ids[j] = -1
        if end < n:
            before[end] = i
            found = made[i] = get(rank << 32 | ids[end], -1)
            if found >= 0:
                push(heap, found << 32 | i)
        left = before[i]
        if left >= 0:
            found = made[left] = get(ids[left] << 32 | rank, -1)
            if found >= 0:
                push(heap, found << 32 | left)
    return [i for i in ids if i >= 0]


class Memory(dict):
    """Ids of texts seen, bounded in bytes: when full, the half that came first goes."""

    #: Bytes that an entry takes beside its text and ids.
    ENTRY = 200

    def __init__(self, encode: Callable[[str], bytes], most: int) -> None:
        self.encode, self.most, self.size = encode, most, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        if len(text) <= LONGEST_KNOWN:
            self[text] = ids
            self.size += len(text) + len(ids) + self.ENTRY
            if self.size > self.most:
                for old in list(islice(self, len(self) // 2)):
                    self.size -= len(old) + len(self.pop(old)) + self.ENTRY
        return ids


class TwoTierEncoder:
    """Ids of whole texts as packed 32-bit numbers.

    A pre-token holds no space between two signs that are not white space, but
    at its start.  So texts are cut there first, and the chunks are remembered
    by what follows that space.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.whole = PerfectHash(self.ranks)
        self.pairs = merge_pairs(self.ranks)
        self.split = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = np.array(tokens, object)
        self.words = Memory(self._word, WORD_BYTES)
        self.chunks = Memory(lambda chunk: self._parts(" " + chunk), CHUNK_BYTES)

    def encode(self, text: str) -> bytes:
        # Most texts have no space beside white space; a plain split cuts them alike.
        plain = not ODD_SPACE(text) and text[:1] != " " and text[-1:] != " "
        first, *rest = text.split(" ") if plain else BETWEEN(text)
        return self._parts(first) + b"".join(map(self.chunks.__getitem__, rest))

    def _parts(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(chunk)))

    def _word(self, part: str) -> bytes:
        word = part.encode()
        rank = self.whole.get(word)
        if rank is not None:
            return rank.to_bytes(4, "little")
        return np.array(merge_bytes([self.single[b] for b in word], self.pairs), "<u4").tobytes()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.tokens[np.frombuffer(packed, "<u4")].tolist())


_ENCODERS: dict[tuple[str, str], TwoTierEncoder] = {}


def _encoder(path: str, pattern: str) -> TwoTierEncoder:
    """One encoder per worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TwoTierEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``ids``: tokens of each whole text; null and empty texts have none.

    Special tokens are never made.  Rows are encoded each; other columns are
    not read.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = _encoder(path, pattern).encode
        return pd.Series([np.frombuffer(encode(t), "<i4") for t in texts], dtype=object)

    return docs.select(column(id_col).alias("id"), ids(whole_text(text_col)).alias("ids"))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``id``, ``bytes``: what the ids of ``encode_documents`` stand for; null ids are none."""

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        decode = _encoder(path, pattern).decode
        return pd.Series([decode(np.asarray(i, "<u4").tobytes()) for i in ids], dtype=object)

    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return encoded.select("id", decoded(ids).alias("bytes"))


def token_digests(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: both ways in one pass."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        encoder, rows = _encoder(path, pattern), []
        for text in texts:
            packed = encoder.encode(text)
            own = hashlib.sha256(packed).hexdigest()
            back = hashlib.sha256(encoder.decode(packed)).hexdigest()
            rows.append((len(packed) // 4, own, back))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(column(id_col).alias("id"), digests(whole_text(text_col)).alias("found"))
    return found.select("id", "found.*")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = token_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")
