"""The last interaction date of parents, kept up to date by a stream of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.mutations import touch_parents
from tidewright.sources.partitioned import PartitionedTable
from tidewright.sources.staging import staged, unstage
from tidewright.sources.tables import SCHEMAS


def last_dates(interactions: DataFrame) -> DataFrame:
    """(opportunity_id, id, date) of the last row, by id, of each parent; over a stream it is state for each parent."""
    last = F.max(F.struct("id", "date"))  # of rows with one id the latest, as touch_parents() has it
    return interactions.where("opportunity_id is not null").groupBy("opportunity_id").agg(last.alias("_last")).select("opportunity_id", "_last.*")


def start_touch(spark: SparkSession, source: str, parents: PartitionedTable, checkpoint: str, every: str | None = "1 minute", files: int | None = None):
    """Interactions that land as Parquet change their parents' dates; only folders of parents that they name are rewritten.

    Update mode: a micro-batch carries the parents it changed, with the last row that the stream has seen of each, so a batch that
    runs again changes nothing further.
    """

    def one(batch, _):
        last = staged(batch)  # read twice below; a batch of a stateful stream is computed once
        parents.change(last.select("opportunity_id"), lambda rows: touch_parents(rows, last))
        unstage(last)

    reader = spark.readStream.schema(SCHEMAS["interactions"])
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    writer = last_dates(reader.parquet(source)).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
