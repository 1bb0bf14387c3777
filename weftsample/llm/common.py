"""What the operators share: null rules, words, stored tables, labelled samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and the letters that case folding touches.
SPACES = b" \t\n\r\x0b\x0c"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: crc32 of an ASCII text for DuckDB, bit by bit; the fixed value is the reversed polynomial.
CRC32_SQL = """xor(list_reduce(
    list_transform(range(length({0})), lambda i: ord(({0})[i + 1])::BIGINT),
    lambda c, b: list_reduce(range(8),
        lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
    4294967295), 4294967295)"""

#: Distinct words that a task remembers before it starts anew; bounds its memory.
MEMO_WORDS = 60_000

#: Bytes of text that are handed to Python at a time.  Batches are counted in rows
#: by default, and ten thousand whole documents can be more than a worker holds.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(text: str) -> Column:
    """A text column as UTF-8, null as empty.

    ``bytes.split()`` then yields the words ``[^\\x20\\x09-\\x0D]+``, and
    ``bytes.lower()`` lower-cases A-Z only.
    """
    bound_batches()
    return F.coalesce(column(text).cast("binary"), F.lit(b""))


def whole_text(text: str) -> Column:
    """A text column, null as empty."""
    bound_batches()
    return F.coalesce(column(text), F.lit(""))


def bound_batches() -> None:
    """Hand at most ``BATCH_BYTES`` to Python at a time in this session from here on."""
    SparkSession.active().conf.set(BATCH_CONF, str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors both see.

    Below ``spark.checkpoint.dir``; where that is unset, below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; false for a null id."""
    part = F.crc32(id_.cast("string").cast("binary")) % folds
    return F.coalesce(part == fold, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    *,
    rows: int,
    id_col: str,
    text_col: str,
    without: tuple[int, int] | None = None,
) -> DataFrame:
    """``text`` (binary) and ``label`` of at most ``rows`` labelled documents.

    The bound is on label rows, chosen by a hash of their id, so the choice
    does not depend on order or partitions.  Rows without id or label, and the
    fold ``without = (folds, fold)``, never take part.
    """
    id_ = column(id_col)
    known = labels.select(id_.alias("id"), column(label).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)")
    if without:
        known = known.filter(~held_out(F.col("id"), *without))
    # A document labelled twice counts once.
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(id_.alias("id"), text_bytes(text_col).alias("text"))
    # At most ``rows`` ids and labels: a bound that does not grow with the data.
    return texts.join(F.broadcast(chosen), "id").select("id", "text", "label")
