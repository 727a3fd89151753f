"""Readers, explicit schemas and input checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import records

RAW_COLUMNS = ("mode", "purpose", "ownership", "agency", "vehicle",
               "date_raw", "unit", "qty_raw")

# Texts that the usual CSV reader of data frames takes as missing.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                 "nan", "null")

# All text on read; parsing is a separate, reported step.
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])


def scan_csv(spark: SparkSession, paths: str | Sequence[str],
             schema: T.StructType = RAW_SCHEMA, headers: Mapping[str, str] | None = None,
             by_position: bool = False, most_lines: int = 64,
             source: int | None = None) -> DataFrame:
    """Read CSV files with a header, plus ``source_file``; a damaged record is an error.

    The schema is given, so there is no inference pass over the files.  Columns are bound
    by name, each path in the order of its own header; ``headers`` translates published
    names into ours.  A path whose names are not those of the schema is an error, and so is
    a file in a folder whose header differs from its neighbours'.  ``by_position`` ignores
    the names.  Texts that stand for a missing value become null.

    A quoted field may go on over line ends, up to ``most_lines`` lines to a record; it
    comes back with ``\\n`` between them.  Records with too few or too many fields, and
    quotes that do not close, are damaged; :func:`scan_csv_rejects` returns them instead.

    With ``source``, the rows carry ``ingest_seq`` as :func:`with_ingest_seq` makes it, from
    file, block and line.
    """
    read = _read_csv(spark, paths, schema, headers, by_position, most_lines)
    message = F.concat(F.lit("damaged record ("), F.col("reason"), F.lit(") in "),
                       F.col("source_file"), F.lit(": "), F.left("record", F.lit(200)))
    sound = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean"))
    seq = [] if source is None else [F.struct(
        F.lit(source).cast("bigint").alias("source"), "file", "block",
        F.col("line").alias("row")).alias("ingest_seq")]
    return read.where(sound).select(*schema.names, "source_file", *seq)


def scan_csv_rejects(spark: SparkSession, paths: str | Sequence[str],
                     schema: T.StructType = RAW_SCHEMA,
                     headers: Mapping[str, str] | None = None, by_position: bool = False,
                     most_lines: int = 64) -> tuple[DataFrame, DataFrame]:
    """The sound rows as :func:`scan_csv` gives them, and the damaged records: ``source_file,
    block, line, reason, record``.

    ``block`` is where the record's part of the file starts, in bytes, and ``line`` its line
    inside that part, from 0.  The reason is ``too few fields``, ``too many fields`` ``open
    quote`` or, for columns that are not text, ``unreadable value``.  Rows, rejects, header and blank lines add up to the file.
    """
    read = _read_csv(spark, paths, schema, headers, by_position, most_lines)
    good = read.where("reason IS NULL").select(*schema.names, "source_file")
    return good, read.where("reason IS NOT NULL").select(
        "source_file", "block", "line", "reason", "record")


def _read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
              headers: Mapping[str, str] | None, by_position: bool, most_lines: int
              ) -> DataFrame:
    """Schema columns, ``source_file, block, line, record, reason`` for every record."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    headers = headers or {}

    def one(path: str) -> DataFrame:
        found = csv_header(spark, path).columns
        ours = schema.names if by_position else [headers.get(c, c) for c in found]
        if sorted(ours) != sorted(schema.names) or len(found) != len(ours):
            raise ValueError(f"columns of {path}: {found}, wanted: {schema.names}")
        lines = spark.read.text(path).select(
            "value", F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block"))
        read = records.records(lines, len(found), None if by_position else found, most_lines)
        named = T.StructType([T.StructField(c, schema[c].dataType) for c in ours]
                             + [T.StructField("_damaged", T.StringType())])
        parsed = read.withColumn("_row", F.from_csv(
            "record", named.simpleString()[len("struct<"):-1].replace(":", " "),
            {"escape": '"', "columnNameOfCorruptRecord": "_damaged", "mode": "PERMISSIVE",
             "maxCharsPerColumn": "-1"}))
        at = lambda c: F.col(f"_row.`{c}`")
        reason = F.coalesce("reason", F.when(F.col("_row._damaged").isNotNull(), F.lit("unreadable value")))
        return parsed.select(
            *[F.when(~at(c).isin(*MISSING_TEXTS), at(c)).alias(c) for c in schema.names],
            "file", "source_file", "block", "line", "record", reason.alias("reason"))

    return reduce(DataFrame.unionByName, map(one, paths))


def with_ingest_seq(df: DataFrame, source: int = 0) -> DataFrame:
    """Number the rows of one source, to decide which of several copies came first.

    The number is a struct, compared field by field: the source in its given order, then
    file, block of the file, and row.  Its fields have room for any table; nothing is packed.
    A frame that is not a scan of files has no file and block, only rows.  Apply it to a
    scan and write the result: the numbers belong to that reading of the files.
    """
    def numbered(file, block) -> DataFrame:
        return df.withColumn("ingest_seq", F.struct(
            F.lit(source).cast("bigint").alias("source"), file.alias("file"),
            block.alias("block"), F.monotonically_increasing_id().alias("row")))

    try:
        rows = numbered(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
        rows.schema                     # fails here unless the rows are read from files
        return rows
    except AnalysisException:
        return numbered(F.lit(""), F.lit(0).cast("bigint"))


def csv_header(spark: SparkSession, path: str) -> DataFrame:
    """An empty frame carrying the column names of one file, for ``schema_check``."""
    return spark.read.option("header", True).csv(path).limit(0)


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def schema_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per column seen on either side, and where it is missing.  Only the names are
    compared; no row is read."""
    names = sorted({*left.columns, *right.columns})
    rows = [(c, c in left.columns, c in right.columns,
             c in left.columns and c in right.columns) for c in names]
    return left.sparkSession.createDataFrame(
        rows, "column_name string, in_left boolean, in_right boolean, matches boolean")


def require_same_columns(left: DataFrame, right: DataFrame) -> None:
    only_left = sorted(set(left.columns) - set(right.columns))
    only_right = sorted(set(right.columns) - set(left.columns))
    if only_left or only_right:
        raise ValueError(f"columns differ: only left {only_left}, only right {only_right}")


def union_sources(*inputs: DataFrame) -> DataFrame:
    """Concatenate inputs with equal column sets; no shuffle."""
    for other in inputs[1:]:
        require_same_columns(inputs[0], other)
    return reduce(DataFrame.unionByName, inputs)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Fail when the frame is empty; reads no more than one row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def nonempty_guard(df: DataFrame) -> DataFrame:
    """Row count with the verdict, for reports; ``require_rows`` is the raising form."""
    return df.agg(F.count("*").alias("rows")).withColumn("nonempty", F.col("rows") > 0)
