"""Landed postings: JSON files as a batch or a stream, and what of them can't be used.

A file is one JSON array (or object), or holds a record a line (``lines``), which Spark splits at any size. A record is a posting, the
metadata record (it has ``legal``), or rejected: text that is no JSON or has a value of the wrong type is ``malformed``,
a record without id, slug, url and position is ``empty``. Postings and rejected records together are all records but the metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = (
    "id string, slug string, url string, position string, company string, description string, location string, tags array<string>, "
    "salary_min long, salary_max long, date string, legal string"
)
CORRUPT = "_corrupt"
LANDED = "_landed"  # struct: when the file came, its path, the split and the place in it; postings are in this order


def _options(lines: bool) -> dict:
    return {"multiLine": not lines, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _counted(df: DataFrame) -> DataFrame:
    """Adds ``_place``, as monotonically_increasing_id() would, which streams do not have."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(seen, seen + batch.num_rows), pa.int64())], names=[*batch.schema.names, "_place"])
            seen += batch.num_rows

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField("_place", T.LongType())]))


def _arrived(df: DataFrame) -> DataFrame:
    """Adds LANDED; a location given as a list arrives as its JSON text: join it."""
    listed = F.from_json("location", "array<string>")
    place = F.when(F.col("location").startswith("["), F.array_join(listed, ", ")).otherwise(F.col("location"))
    names = {"at": "file_modification_time", "path": "file_path", "start": "file_block_start"}
    df = df.select("*", *[F.col(f"_metadata.{m}").alias(f"_{n}") for n, m in names.items()])
    df = _counted(df) if df.isStreaming else df.withColumn("_place", F.monotonically_increasing_id())
    landed = F.struct(*[F.col(f"_{n}").alias(n) for n in (*names, "place")])
    return df.withColumn(LANDED, landed).withColumn("location", place).drop(*[f"_{n}" for n in (*names, "place")])


def arrival(landed: str = LANDED) -> Column:
    """LANDED as a text of the same order."""
    at = F.date_format(f"{landed}.at", "yyyyMMddHHmmssSSSSSS")
    inside = [F.lpad(F.col(f"{landed}.{n}").cast("string"), 20, "0") for n in ("start", "place")]
    return F.concat_ws(" ", at, f"{landed}.path", *inside)


def _reason() -> Column:
    """Why a record is rejected; null for postings and the metadata record."""
    empty = F.coalesce("id", "slug", "url", "position").isNull()
    return F.when(F.col(CORRUPT).isNotNull(), "malformed").when(F.col("legal").isNull() & empty, "empty")


def _good(df: DataFrame) -> DataFrame:
    return df.where(_reason().isNull() & F.col("legal").isNull()).drop("legal", CORRUPT)


def _rejected(df: DataFrame) -> DataFrame:
    """(reason, record, path): the text of a malformed record, what is left of an empty one."""
    kept = [c for c in df.columns if c not in (CORRUPT, LANDED)]
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*kept)))
    return df.withColumn("reason", _reason()).where("reason is not null").select("reason", record.alias("record"), F.col(f"{LANDED}.path").alias("path"))


def read_landed(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, rejected records) of the files at ``path``. A missing path gives an empty batch."""
    from pyspark.errors import AnalysisException

    schema = f"{SCHEMA}, {CORRUPT} string"
    try:
        df = _arrived(spark.read.schema(schema).options(**_options(lines)).json(path))
    except AnalysisException:
        df = spark.createDataFrame([], f"{schema}, {LANDED} struct<at: timestamp, path: string, start: bigint, place: bigint>")
    return _good(df), _rejected(df)


def read_postings(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """The postings alone."""
    df = read_landed(spark, path, lines)[0].drop(LANDED)
    return df if limit is None else df.limit(limit)


def stream_landed(spark: SparkSession, path: str, lines: bool = False, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, rejected records) as streams; ``files``: at most so many for each micro-batch."""
    options = _options(lines) | ({"maxFilesPerTrigger": files} if files else {})
    df = _arrived(spark.readStream.schema(f"{SCHEMA}, {CORRUPT} string").options(**options).json(path))
    return _good(df), _rejected(df)
