"""A set of hashes as a bit set that is broadcast: drops rows without a partner before a shuffle.

The set is sized by the number of its members, about ``BITS_PER_MEMBER`` bits
for each, and never beyond ``MOST_BITS``; so it lets about one in as many
strangers through and its size is bounded whatever the data.  A member always
passes.  It lies in pages of ``PAGE_WORDS`` words, one row each: a look-up is a
broadcast join on the page and one element of its array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values; all are powers of two.
BITS_PER_MEMBER = 32
WORD_BITS = 64
PAGE_WORDS = 512
MOST_BITS = 1 << 28  # 32 MB


def bits_for(members: int) -> int:
    """Bits of a set with so many members: a power of two, one page at least."""
    wanted = max(members * BITS_PER_MEMBER, WORD_BITS * PAGE_WORDS)
    return min(1 << (wanted - 1).bit_length(), MOST_BITS)


def bit_set(hashes: DataFrame, column: str, members: int) -> DataFrame:
    """``page``, ``words``: the set of the 64-bit hashes in ``column``, for ``members_of``.

    ``members`` estimates how many different ones there are; a wrong estimate
    costs selectivity only.  Bits are put together per task before the shuffle.
    """
    bits = bits_for(members)
    place = f"(`{column}` & {bits - 1}L)"
    words = hashes.selectExpr(
        f"{place} div {WORD_BITS}L as word",
        f"shiftleft(1L, cast({place} & {WORD_BITS - 1}L as int)) as bits",
    )
    # Words without a member, so that each page is whole and its words stand in order.
    blank = hashes.sparkSession.range(0, bits // WORD_BITS, 1, max(1, bits >> 22))
    words = words.groupBy("word").agg(F.expr("bit_or(bits) as bits")).unionAll(
        blank.selectExpr("id as word", "0L as bits")
    )
    words = words.groupBy("word").agg(F.expr("bit_or(bits) as bits"))
    pages = words.groupBy(F.expr(f"word div {PAGE_WORDS}L as page")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    )
    return pages.select("page", F.col("words.bits").alias("words"))


def mark_members(
    rows: DataFrame, hash_: Column, pages: DataFrame, members: int, name: str
) -> DataFrame:
    """Add the boolean ``name``: true if the hash is in the set, and seldom if it is not.

    ``members`` is the number that the set was made with; ``hash_`` is never NULL.
    """
    bits = bits_for(members)
    placed = rows.withColumn("_place", hash_.bitwiseAND(F.lit(bits - 1).cast("long")))
    named = pages.select(F.col("page").alias("_page"), F.col("words").alias("_words"))
    page = F.expr(f"_place div {WORD_BITS * PAGE_WORDS}L")
    word = f"get(_words, cast((_place div {WORD_BITS}L) % {PAGE_WORDS}L as int))"
    bit = f"cast(_place & {WORD_BITS - 1}L as int)"
    return (
        placed.join(F.broadcast(named), page == F.col("_page"))
        .withColumn(name, F.expr(f"(shiftright({word}, {bit}) & 1L) = 1L"))
        .drop("_place", "_page", "_words")
    )


def members_of(rows: DataFrame, hash_: Column, pages: DataFrame, members: int) -> DataFrame:
    """``rows`` whose hash is in the set, and few others; NULL is in no set."""
    return mark_members(rows, hash_, pages, members, "_member").filter("_member").drop("_member")
