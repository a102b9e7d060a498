"""Scheduled ingest as a stream: each posting is stored once, the first of its id, however the files come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.scoring import Rules
from tidewright.operators.ingest import KEYWORDS, REQUIRED, identified, map_postings, relevant, score_postings
from tidewright.sources.postings import arrival, stream_landed
from tidewright.sources.snapshots import SnapshotStore
from tidewright.sources.staging import staged, unstage
from tidewright.sources.tables import migrate


HELD = 1 << 14  # rows of a task among which the first of each key are taken at once


def _firsts(batches):
    """Of each key of a part the row of the smallest order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def first(tables):
        held = pa.concat_tables(tables)
        order = pc.sort_indices(held.select(["key", "order"]), sort_keys=[("key", "ascending"), ("order", "ascending")])
        keys = held.column("key").combine_chunks().take(order)
        new = pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])])
        return held.take(order.filter(new))

    held, rows, most = [], 0, HELD
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= most:
                held = [first(held)]
                rows = held[0].num_rows
                most = max(HELD, 2 * rows)
    if held:
        yield from first(held).to_batches(max_chunksize=1024)


def first_of_key(rows: DataFrame, key: str, order: Column, known: DataFrame | None = None) -> DataFrame:
    """Of each key of a stream the first row ever; inside a micro-batch the first by ``order``, a text. No row for keys of the stream ``known``.

    A micro-batch comes down to a row for each key; whether a key is new is asked of Spark's state store, which holds keys alone
    and is dealt by key: no micro-batch reads the table that rows go to.
    """
    sent = rows.select(F.col(key).alias("key"), order.alias("order"), F.struct(*rows.columns).alias("row"))
    kind = sent.schema["row"].dataType
    if known is not None:
        sent = sent.unionByName(known.select(F.col(key).alias("key"), F.lit("").alias("order"), F.lit(None).cast(kind).alias("row")))
    kept = sent.repartition("key").mapInArrow(_firsts, T.StructType([T.StructField("key", T.StringType()), T.StructField("order", T.StringType()), T.StructField("row", kind)]))
    return kept.dropDuplicates(["key"]).where("row is not null").select("row.*")


def _known(spark: SparkSession, store: SnapshotStore, checkpoint: str) -> DataFrame:
    """A stream of the keys that the store had when the checkpoint was new; written beside it once."""
    path = f"{checkpoint}-known"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        store.read()["scraped_jobs"].select("external_id").write.mode("overwrite").parquet(path)
    return spark.readStream.schema("external_id string").parquet(path)


def start_ingest(
    spark: SparkSession, source: str, store: SnapshotStore, rules: Rules, checkpoint: str, every: str | None = "6 hours", keywords=KEYWORDS,
    lines: bool = False, files: int | None = None,
):
    """Reads landed files as they come and appends new rows, with ids, to scraped_jobs. ``every`` None: what is there, then stop.

    Whether a key is new is asked of the stream's state, which starts from the keys of the store; the stream is the table's one writer.
    A batch that runs again after a failure finds its number in the store and writes nothing twice. A batch
    writes its own rows alone; compact() of the store joins the parts that many batches leave.
    """
    name = f"ingest {checkpoint}"

    def one(batch, number):
        if store.marks().get(name, -1) >= number:
            return
        fresh = staged(batch)  # numbering reads its rows twice; a batch of a stateful stream is computed once
        scored = staged(score_postings(fresh, rules).withColumn("imported_to_opportunities", F.lit(False)))
        new, _counts = identified(scored, store.read()["scraped_jobs"])
        store.append({"scraped_jobs": migrate(new, "scraped_jobs")}, mark=(name, number))
        for df in (fresh, scored, new):
            unstage(df)

    postings = stream_landed(spark, source, lines, files)[0]
    mapped = map_postings(relevant(postings, keywords), F.current_timestamp())
    for c in ("external_id", *REQUIRED):
        mapped = mapped.where(F.col(c).isNotNull())
    first = first_of_key(mapped, "external_id", arrival("_ordinal"), _known(spark, store, checkpoint))
    writer = first.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def start_rejects(spark: SparkSession, source: str, to: str, checkpoint: str, every: str | None = "6 hours", lines: bool = False):
    """The dead letters of the same files: each rejected record once, as JSON below ``to``."""
    rejected = stream_landed(spark, source, lines)[1]
    writer = rejected.writeStream.format("json").option("path", to).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
