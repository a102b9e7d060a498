"""Frames written to the shared folder, and rows numbered in an order.

Numbers are given to what was written, never to a lazy frame: two evaluations of one plan may deal its rows to other
partitions, and a number that depends on the partition then belongs to another row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}  # folder by application, where no shared one is named
_ROW = (1 << 33) - 1  # monotonically_increasing_id: the partition above these bits, the row in it below


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without that setting a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="staging-")
    return _OWN[application]


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again."""
    path = folder(df.sparkSession, "staging")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes what staged() or numbered() wrote for this frame, and nothing else."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("staging-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _column(name: str):
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, *order, name: str = "number", after: int = 0) -> DataFrame:
    """``df`` with consecutive numbers from ``after`` + 1 on in ``order``; equals are numbered as they come.

    One shuffle by ranges of the order. Rows that are equal in it are split over ranges too, as their place in the input
    is its last part. The table of range sizes has a row for each range.
    """
    spread = df.withColumn("_seen", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange(*order, "_seen").sortWithinPartitions(*order, "_seen").drop("_seen")
    placed = staged(ranges.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit(_ROW)) + F.lit(1 + after)
    out = placed.withColumn("_part", part).join(sizes, "_part")
    return out.withColumn(name, number.cast("long")).select(*[_column(c) for c in df.columns if c != name], name)
