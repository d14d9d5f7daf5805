"""Reading preference tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.text import length_delta
from pairlens.lineage import cut_lineage
from pairlens.schema import PREFERENCES, ColumnNames

# Readable file suffixes.
FORMATS = {".json": "json", ".jsonl": "json", ".parquet": "parquet", ".csv": "csv"}


def file_format(path: str) -> str:
    for suffix, fmt in FORMATS.items():
        if path.endswith(suffix):
            return fmt
    raise ValueError(f"unsupported file extension: {path}")


def load_preferences(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    columns: ColumnNames = ColumnNames(),
    extra: tuple[str, ...] = (),
    multi_line: bool = False,
) -> DataFrame:
    """Preference rows with the library's column names and a surrogate ``row_id``.

    Types are given, never inferred, so only needed columns are read. ``extra`` names further
    (string) columns, such as split columns. JSON means one object per line. A required column
    that the file lacks, a line that is no record, a label or length that is no number raise
    ValueError; true and false are the labels 1 and 0.

    CSV files are split among tasks; ``multi_line`` reads each whole, for quoted texts that span
    lines. Later jobs read the rows several times and meet again by ``row_id``, so the id must not
    depend on how a scan happens to be cut into tasks. Parquet rows are numbered by file and
    position in it; JSON and CSV are numbered while being copied once to a Parquet table.
    """
    fmt = fmt or file_format(path)
    renamed = {
        columns.prompt: "prompt",
        columns.response_a: "response_A",
        columns.response_b: "response_B",
        columns.label: "label",
    }
    back = {new: old for old, new in renamed.items()}
    wanted = {back.get(f.name, f.name): f.dataType for f in PREFERENCES.fields}
    wanted |= {c: T.StringType() for c in extra if c not in wanted}
    if fmt == "parquet":
        df = _numbered_by_file(spark.read.parquet(path), wanted, set(renamed))
    elif fmt in ("json", "csv"):
        df = _numbered_copy(_records(spark, path, fmt, wanted, multi_line), wanted, set(renamed))
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return with_length_delta(df.withColumnsRenamed(renamed))


FILE_POSITION = ("file_path", "row_index")
ROW_BITS = 36  # rows within one file
BAD_LINE = "_bad_line"
SCHEME_SLASHES = "^([A-Za-z][A-Za-z0-9+.-]*):/+"


def _records(spark: SparkSession, path: str, fmt: str, wanted: dict[str, T.DataType], multi_line: bool) -> DataFrame:
    """The wanted columns as text, and what of a line could not be read."""
    names = list(wanted)
    if fmt == "csv":
        # Columns are matched by header name, so the header is read first; one line.
        head = spark.read.csv(path, multiLine=multi_line, escape='"', inferSchema=False).limit(1).collect()
        names = [c if c is not None else f"_column{i}" for i, c in enumerate(head[0])] if head else []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BAD_LINE]])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    if fmt == "json":
        return reader.json(path)
    return reader.csv(path, header=True, multiLine=multi_line, escape='"', enforceSchema=True)


def _number(text: Column, kind: T.DataType) -> Column:
    told = F.lower(F.trim(text))
    value = F.when(told == "true", 1.0).when(told == "false", 0.0).otherwise(told.try_cast("double"))
    return value.cast(kind) if isinstance(kind, T.DoubleType) else F.round(value).cast(kind)


def _numbered_copy(records: DataFrame, wanted: dict[str, T.DataType], required: set[str]) -> DataFrame:
    """Typed and numbered rows in a table of the shared folder, checked while they are written."""
    _require(required - set(records.columns))
    columns, unread = [], []
    for name, kind in wanted.items():
        text = F.col(name) if name in records.columns else F.lit(None).cast("string")
        if isinstance(kind, T.StringType):
            columns.append(text.alias(name))
            continue
        given = F.nullif(F.trim(text), F.lit(""))
        columns.append(_number(given, kind).alias(name))
        unread.append(given.isNotNull() & _number(given, kind).isNull())
    bad = F.col(BAD_LINE).isNotNull()
    for wrong in unread:
        bad = bad | wrong
    table = cut_lineage(records.select(*columns, bad.alias("_bad"), F.monotonically_increasing_id().alias("row_id")))
    # One pass over the columns' null masks and flags of the copy.
    found = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("_bad").alias("bad"),
        *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(sorted(required))],
    ).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} of {found['rows']} rows are malformed or hold a label or length that is no number")
    if found["rows"]:
        _require({c for i, c in enumerate(sorted(required)) if not found[f"n_{i}"]})
    return table.drop("_bad")


def _require(missing: set[str]) -> None:
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")


def _numbered_by_file(stored: DataFrame, wanted: dict[str, T.DataType], required: set[str]) -> DataFrame:
    """Row id from the rank of the file name and the position in the file.

    The file list is the one Spark planned the scan with; no row is read for it.
    """
    _require(required - set(stored.columns))
    columns = [
        (F.col(c) if c in stored.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()
    ]
    rows = stored.select(*columns, *[F.col(f"_metadata.{m}").alias(f"_{m}") for m in FILE_POSITION])
    # "file:///a" and "file:/a" are the same place.
    rows = rows.withColumn("_file_path", F.regexp_replace("_file_path", SCHEME_SLASHES, "$1:/"))
    paths = sorted(re.sub(SCHEME_SLASHES, r"\1:/", path) for path in stored.inputFiles())
    ranks = [(path, rank) for rank, path in enumerate(paths, 1)]
    files = stored.sparkSession.createDataFrame(ranks, "_file_path string, _file long")
    unknown = F.raise_error(F.concat(F.lit("file not in the list: "), F.col("_file_path"))).cast("long")
    file = F.when(F.col("_file").isNull(), unknown).otherwise(F.col("_file"))
    return (
        rows.join(files, "_file_path", "left")
        .withColumn("row_id", F.shiftleft(file, ROW_BITS) + F.col("_row_index"))
        .drop("_file_path", "_file", "_row_index")
    )


def with_length_delta(df: DataFrame, a: str = "response_A", b: str = "response_B") -> DataFrame:
    """Words of A minus words of B, wherever ``length_delta`` is not given already."""
    counted = length_delta(F.col(a), F.col(b))
    if "length_delta" in df.columns:
        return df.withColumn("length_delta", F.coalesce(F.col("length_delta"), counted))
    return df.withColumn("length_delta", counted)
