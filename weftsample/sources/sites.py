"""Read and write tables that are split over sites.

Two layouts: one CSV path per table and site, named by a template, as existing
data sets have it; and phase results (counts, samples) under one root with
``table=`` / ``site=`` directories, which one scan reads and prunes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    AnsiIntervalType,
    ArrayType,
    CalendarIntervalType,
    DataType,
    MapType,
    NullType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

from ..functions.hashing import quoted

# The schemas and the path template of the input tables.
TABLE_SCHEMA = StructType(
    [
        StructField("key", StringType()),
        StructField("value_one", StringType()),
        StructField("value_two", StringType()),
        StructField("value_three", StringType()),
        StructField("value_four", StringType()),
        StructField("value_five", StringType()),
    ]
)
TABLE_PATH = "{prefix}_t_{table}_p_{site}_of_{sites}.csv"
SITE_PATTERN = r"_p_(\d+)_of_\d+\.csv"

FORMATS = ("parquet", "csv")


def table_path(prefix: str, table: int, site: int, sites: int) -> str:
    if not 0 <= site < sites:
        raise ValueError(f"site {site} is not one of {sites} sites")
    return TABLE_PATH.format(prefix=prefix, table=table, site=site, sites=sites)


def read_sites(
    spark: SparkSession,
    prefix: str,
    table: int,
    sites: int,
    *,
    schema: StructType = TABLE_SCHEMA,
    only: int | Sequence[int] | None = None,
    escaped: bool = False,
) -> DataFrame:
    """One table from the CSV paths of its sites, with a ``site`` column.

    All sites are one scan over a list of paths.  ``only`` reads some sites'
    paths and leaves the others untouched.  ``escaped`` says that the files were
    written so.  Lines that do not fit the schema are read as far as they do, with
    NULL for the rest; ``read_sites_counted`` tells how many there are.
    """
    rows = _site_lines(spark, prefix, table, sites, schema, only, escaped, {})
    return _unescape(rows) if escaped else rows


def read_sites_counted(
    spark: SparkSession,
    prefix: str,
    table: int,
    sites: int,
    *,
    schema: StructType = TABLE_SCHEMA,
    only: int | Sequence[int] | None = None,
    escaped: bool = False,
) -> tuple[DataFrame, Observation]:
    """``read_sites``, and an observation with ``n_lines``, ``n_malformed``, ``n_nulls``.

    A line is malformed if it has too few or too many fields, or a field that is
    not of its type.  To know that, every column is parsed, whatever the query
    needs.  Read the observation after an action that ran over the rows.
    """
    rows = _malformed_apart(spark, prefix, table, sites, schema, only, escaped)
    seen = Observation(f"lines-{uuid.uuid4().hex}")
    nulls = " + ".join(f"int({quoted(c)} IS NULL)" for c in schema.names)
    counted = rows.observe(
        seen,
        F.count(F.lit(1)).alias("n_lines"),
        F.count(MALFORMED).alias("n_malformed"),
        F.coalesce(F.sum(F.expr(nulls)), F.lit(0)).alias("n_nulls"),
    ).drop(MALFORMED)
    return (_unescape(counted) if escaped else counted), seen


def malformed_lines(
    spark: SparkSession,
    prefix: str,
    table: int,
    sites: int,
    *,
    schema: StructType = TABLE_SCHEMA,
    only: int | Sequence[int] | None = None,
) -> DataFrame:
    """``site``, ``line``, ``fields``: the lines that do not fit the schema, as they stand in
    the files, and what is read of them."""
    rows = _malformed_apart(spark, prefix, table, sites, schema, only, False)
    # Only columns that are asked for are parsed, and a line may fail in any of them.
    fields = F.struct(*map(quoted, schema.names))
    kept = F.when(F.col(MALFORMED).isNotNull(), F.struct(F.col(MALFORMED), fields.alias("fields")))
    lines = rows.select("site", F.explode(F.array(kept)).alias("kept")).filter("kept IS NOT NULL")
    return lines.select("site", F.col(f"kept.{MALFORMED}").alias("line"), "kept.fields")


def _malformed_apart(spark, prefix, table, sites, schema, only, escaped) -> DataFrame:
    wide = StructType(list(schema.fields)).add(MALFORMED, StringType())
    whole = dict(columnNameOfCorruptRecord=MALFORMED, columnPruning=False)
    return _site_lines(spark, prefix, table, sites, wide, only, escaped, whole)


def _site_lines(spark, prefix, table, sites, schema, only, escaped, options) -> DataFrame:
    wanted = range(sites) if only is None else [only] if isinstance(only, int) else only
    paths = [table_path(prefix, table, site, sites) for site in wanted]
    site = F.regexp_extract(F.col("_metadata.file_path"), SITE_PATTERN, 1).cast("int")
    reader = spark.read.schema(schema).options(header=False, **_options(escaped), **options)
    return reader.csv(paths).withColumn("site", site)


def write_sites(
    df: DataFrame,
    folder: str,
    name: str,
    table: int,
    sites: int,
    *,
    site: str = "site",
    escaped: bool = False,
) -> str:
    """Write a table with a ``site`` column in one pass; returns the prefix to read it by.

    Each site becomes a path of the template, under ``folder/file=name``.  A
    table replaces its own paths and leaves other tables in the folder alone.
    With ``escaped`` every value reads back as it was; see ``write_table``.
    """
    if any(mark in name for mark in "/=%"):
        raise ValueError(f"{name!r} cannot be part of a file name")
    number = F.col(site).cast("string")
    path = F.concat(F.lit(f"{name}_t_{table}_p_"), number, F.lit(f"_of_{sites}.csv"))
    (
        (_escape(df) if escaped else _plain(df, site))
        .withColumn("file", path)
        .drop(site)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file")
        .options(header=False, **_options(escaped))
        .csv(folder)
    )
    return f"{folder}/file={name}"


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: StructType | None = None,
    *,
    escaped: bool = False,
    base: str | None = None,
) -> DataFrame:
    """One scan of a path or of several; ``base`` is where their partition folders begin."""
    _check(fmt)
    reader = spark.read if schema is None else spark.read.schema(schema)
    reader = reader if base is None else reader.option("basePath", base)
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "parquet":
        return reader.parquet(*paths)
    if schema is None:
        raise ValueError("headerless CSV needs a schema")
    rows = reader.options(header=False, **_options(escaped)).csv(paths)
    return _unescape(rows) if escaped else rows


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", *, escaped: bool = False
) -> None:
    """Overwrite ``path``; CSV comes without a header.

    Plain CSV cannot tell an empty text from NULL, a line break ends a row, and a
    line with nothing on it is none.  Rows with such values are an error there.
    With ``escaped``, ``%N`` stands for NULL in any column, texts hold ``%E`` for
    empty and ``%25 %0A %0D %22 %5C`` for ``%``, line breaks, quotes and
    backslashes, and files stay splittable; read them with ``escaped`` as well.
    Times are written to the microsecond.
    """
    _check(fmt)
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    writer = (_escape(df) if escaped else _plain(df)).write.mode("overwrite")
    writer.options(header=False, **_options(escaped)).csv(path)


def _options(escaped: bool) -> dict[str, object]:
    """CSV options; spaces around a value belong to it in files of our own."""
    spaces = dict(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if not escaped:
        # A fraction of a second may have any number of digits when it is read.
        return spaces
    return spaces | TIMES | dict(nullValue=NULL)


# Signs that plain CSV loses or changes, and what stands for them.
ESCAPES = (("%", "%25"), ("\n", "%0A"), ("\r", "%0D"), ('"', "%22"), ("\\", "%5C"))
EMPTY, NULL = "%E", "%N"
NOT_PLAIN = r"\A\z|[\n\r]"  # an empty text, or one with a line break
TIMES = dict(
    timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
)

#: Column that a reader puts a malformed line in.
MALFORMED = "_malformed"


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _escape(df: DataFrame) -> DataFrame:
    out = {}
    for name in _texts(df):
        text = F.col(quoted(name))
        for sign, code in ESCAPES:
            text = F.replace(text, F.lit(sign), F.lit(code))
        out[name] = F.when(text == "", EMPTY).otherwise(text)
    return df.withColumns(out) if out else df


def _plain(df: DataFrame, *beside: str) -> DataFrame:
    """Rows that plain CSV holds as they are; the first other one fails the write."""
    out = {}
    for name in _texts(df):
        text = F.col(quoted(name))
        # One search: with three for each column, the code generated for a table made of
        # hashes has over 8,000 bytes, and is not compiled to machine code.
        lost = text.cast("string").rlike(NOT_PLAIN)
        why = f"column {name}: plain CSV cannot hold an empty text or a line break"
        out[name] = F.when(lost, F.raise_error(F.lit(why)).cast("string")).otherwise(text)
    values = [c for c in df.columns if c not in beside]
    if len(values) == 1:
        name = values[0]
        value = out.get(name, F.col(quoted(name)))
        why = F.raise_error(F.lit(f"column {name}: plain CSV has no line for a single NULL"))
        out[name] = F.when(value.isNull(), why.cast(df.schema[name].dataType)).otherwise(value)
    return df.withColumns(out) if out else df


def _unescape(df: DataFrame) -> DataFrame:
    out = {}
    for name in _texts(df):
        text = F.when(F.col(quoted(name)) == EMPTY, "").otherwise(F.col(quoted(name)))
        for sign, code in reversed(ESCAPES):
            text = F.replace(text, F.lit(code), F.lit(sign))
        out[name] = text
    return df.withColumns(out) if out else df


def rendered_bytes(df: DataFrame, columns: Sequence[str] | None = None):
    """SQL expression: bytes of a row written as comma-separated text."""
    names = list(columns or df.columns)
    text = [f"coalesce(octet_length(cast({quoted(c)} as string)), 0)" for c in names]
    return F.expr(f"cast({' + '.join(text)} + {len(names)} as bigint)")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors both see.

    Below ``spark.checkpoint.dir``; where that is unset, below the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a scratch folder and read it back.

    What is read more than once is computed once so, and a lost executor costs
    one step.  Types that Parquet lacks (void, intervals) leave the table as it is.
    """
    if not all(_storable(f.dataType) for f in df.schema.fields):
        return df
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _storable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return len(kind) > 0 and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (NullType, AnsiIntervalType, CalendarIntervalType, VariantType))


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
