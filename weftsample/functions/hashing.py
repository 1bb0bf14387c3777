"""Uniform numbers and letters that depend on row content only.

A draw that is a function of (row id, purpose, seed) comes out the same when a
task is retried, when the data is laid out differently and when adaptive
execution changes the plan.

Whole numbers are mixed by a few multiplications and shifts, which takes some
tens of nanoseconds inside generated code; ids of other types go through an md5
once per row.  All of it is SQL text made of built-in functions.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

# Fixed values.
BITS = 52  # of a hash: as many as a double between 0 and 1 can hold
HALF_BITS = 26
WORD = 2**32 - 1
FACTORS = (0x21F0AAAD, 0x735A2D97)  # of a public 32-bit mixer; below 2**31, so that
#                                     the product with a word fits a BIGINT
HASH_DIGITS = 13  # hex digits that make 52 bits
LETTERS = string.ascii_letters  # alphabet of generated keys and values
LETTERS_PER_HASH = 6  # 52**6 << 2**52, so the letters are even to 5e-6
PAIRS = [a + b for b in LETTERS for a in LETTERS]  # two letters by their number
KEY_BUCKETS = 262_144  # a power of two; most rows of the guide in operators.weights


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def salts(purpose: str, seed: int) -> tuple[int, int, int]:
    """Three words that set one purpose and seed apart from all others."""
    digest = hashlib.md5(f"{purpose}|{seed}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16))


def mix52(number: str, purpose: str, seed: int) -> str:
    """52 well-mixed bits of a BIGINT; both are SQL texts.

    Each half of the result goes through two rounds of its own, and both words of
    the number enter both: ids in steps give even and unrelated halves.
    """
    one, two, three = salts(purpose, seed)
    low = f"(({number} ^ shiftright({number}, 29)) & {WORD}L)"
    high = f"((shiftright({number}, 31) & {WORD}L) ^ ((({number} & {WORD}L) * {FACTORS[1]}L) & {WORD}L))"
    x = _times_factors(f"({low} ^ {one}L)")
    x = f"({x} ^ {high} ^ {two}L)"
    x = _times_factors(f"({x} ^ shiftright({x}, 16))")
    rest = _times_factors(f"({high} ^ {three}L)")
    rest = f"((({rest} ^ shiftright({rest}, 16)) * {FACTORS[0]}L) & {WORD}L)"
    shift = 32 - HALF_BITS
    return f"(shiftright({x}, {shift}) * {2**HALF_BITS}L + shiftright({rest}, {shift}))"


def mix52_array(numbers: np.ndarray, purpose: str, seed: int) -> np.ndarray:
    """``mix52`` of a numpy array of int64."""

    def times_factors(x: np.ndarray) -> np.ndarray:
        x = (x * FACTORS[0]) & WORD
        return ((x ^ (x >> 15)) * FACTORS[1]) & WORD

    one, two, three = salts(purpose, seed)
    low = (numbers ^ (numbers >> 29)) & WORD
    high = ((numbers >> 31) & WORD) ^ (((numbers & WORD) * FACTORS[1]) & WORD)
    x = times_factors(low ^ one) ^ high ^ two
    x = times_factors(x ^ (x >> 16))
    rest = times_factors(high ^ three)
    rest = ((rest ^ (rest >> 16)) * FACTORS[0]) & WORD
    shift = 32 - HALF_BITS
    return (x >> shift) * 2**HALF_BITS + (rest >> shift)


def uniform(bits: str) -> str:
    """Number in (0, 1) from 52 bits."""
    return f"(({bits} + 0.5D) * {2.0**-BITS!r}D)"


def with_row_bits(rows: DataFrame, ids: Sequence[str], purpose: str, seed: int) -> DataFrame:
    """Add ``_bits``, 52 bits that depend on the columns ``ids``, unless it is there."""
    if "_bits" in rows.columns:
        return rows
    types = {field.name: field.dataType for field in rows.schema.fields}
    whole = [c for c in ids if isinstance(types[c], IntegralType)]
    other = [c for c in ids if c not in whole]
    if other:
        rows = rows.withColumn("_bits", text_bits(other))
        rows = rows.withColumn("_bits", F.expr(mix52("_bits", purpose, seed)))
    for i, name in enumerate(whole):
        # Ids are not NULL; saying so spares the optimizer a null check by hash.
        number = f"coalesce(cast({quoted(name)} as bigint), 0L)"
        if other or i:
            number = f"(_bits ^ {number})"
        rows = rows.withColumn("_bits", F.expr(mix52(number, purpose, seed)))
    return rows


def text_bits(columns: Sequence[str]) -> Column:
    return F.expr(digest_bits(f"md5({row_text(columns)})", 0))


def row_text(columns: Sequence[str]) -> str:
    """SQL text: the values of a row as one text that tells any two rows apart.

    JSON keeps fields apart and marks NULLs; times are written to the
    microsecond and in UTC, so the session's time zone does not matter.
    """
    names = ", ".join(map(quoted, columns))
    options = {
        "ignoreNullFields": "false",
        "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "timeZone": "UTC",
    }
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in options.items())
    return f"to_json(struct({names}), map({pairs}))"


def digest_bits(digest: str, part: int) -> str:
    """52 bits from the hex digits of a digest: part 0 or part 1 of them."""
    digits = f"substring({digest}, {1 + part * HASH_DIGITS}, {HASH_DIGITS})"
    # Never NULL; saying so spares the optimizer a second digest as a null check.
    return f"coalesce(cast(conv({digits}, 16, 10) as bigint), 0L)"


def letters_from(words: Sequence[str], length: int, start: int = 0) -> str:
    """SQL text for ``length`` letters a-zA-Z of the 52-bit columns, six from each.

    ``start`` letters are passed over, so that several texts can share the columns.

    Two letters at a time are an element of a constant array, which is found
    without a walk over a text; the array is folded when the query is planned.
    """
    letters, at, end = [], start, start + length
    while at < end:
        word, place = divmod(at, LETTERS_PER_HASH)
        two = at + 1 < end and place + 1 < LETTERS_PER_HASH
        own = PAIRS if two else list(LETTERS)
        number = f"({words[word]} div {len(LETTERS) ** place}L)" if place else words[word]
        digit = f"cast({number} % {len(own)}L as int)"
        letters.append(f"get(split('{','.join(own)}', ','), {digit})")
        at += 1 + two
    return f"concat({', '.join(letters)})" if letters else "''"


def words_needed(length: int) -> int:
    return -(-length // LETTERS_PER_HASH)


def key_hash(rows: DataFrame, keys: Sequence[str]) -> Column:
    """64 bits of the join key; equal keys share them.

    Texts under a collation are equal in more than one spelling, which no hash
    function knows; they take no part in it.
    """
    types = {field.name: field.dataType for field in rows.schema.fields}
    names = ", ".join(quoted(k) for k in keys if not _collated(types[k])) or "0"
    return F.expr(f"xxhash64({names})")


def key_bucket(rows: DataFrame, keys: Sequence[str]) -> Column:
    """One of ``KEY_BUCKETS`` buckets of the join key, by its hash."""
    return key_hash(rows, keys).bitwiseAND(F.lit(KEY_BUCKETS - 1).cast("long")).cast("int")


def _collated(kind: DataType) -> bool:
    return isinstance(kind, StringType) and kind.collation != "UTF8_BINARY"


def _times_factors(x: str) -> str:
    x = f"(({x} * {FACTORS[0]}L) & {WORD}L)"
    return f"((({x} ^ shiftright({x}, 15)) * {FACTORS[1]}L) & {WORD}L)"
