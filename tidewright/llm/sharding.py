"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters rows by a seeded hash of the whole row over buckets that fit in memory: of ``bucket_rows`` rows and
``bucket_bytes`` bytes on average, whichever makes more of them. Pass two applies a Fisher-Yates shuffle to each bucket, with
draws from a seeded hash, and writes it: the buckets in their order are one permutation of all rows, which is
cut into shards whose row counts differ by one at most (law ``rows``).

Whole rows cross the network once. Only rows that occur more than once need a number first: a slim table of names says which they
may be, and they alone are brought together, and kept as a table of each row and its times.

Defined results: nulls are values like others; repeated rows are told apart by a number, so that no
bucket grows with them; a text longer than a bucket is alone in it, or nearly so; an empty table gives an empty table; reruns
agree, whatever the partitioning, since order within a bucket follows from the hash. Columns must be orderable (no maps).
``shard`` and ``slot`` are written over columns of these names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, column, prefix_sums, table

SEED = 42
SHARDS = 40
BUCKET_ROWS = 512
BUCKET_BYTES = 8 << 20
FEW = 1 << 18  # buckets whose offsets (16 bytes each) are broadcast; beyond, they are joined by shuffle
WORDS = 1 << 18  # of 64 marks each; a row marked by chance is counted like a repeated one, with the same result


def _named(df: DataFrame) -> DataFrame:
    """Rows as structs, apart from the names that are used here, with a hash of 128 bits."""
    columns = [column(c) for c in df.columns]
    return df.select(F.struct(*columns).alias("row"), F.xxhash64(F.lit(SEED), *columns).alias("a"), F.xxhash64(F.lit(SEED + 1), *columns).alias("b"))


def _marked(named: DataFrame, words: int) -> DataFrame:
    """``named`` with its place in a bitmap of so many words: ``word``, ``bit``."""
    return named.withColumns({"word": F.expr(f"pmod(a, {words}L)"), "bit": F.expr("shiftleft(1L, cast(pmod(b, 64L) as int))")})


def _once_and_often(rows: DataFrame, names: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows that occur once, and all others: those with the mark of a name that ``names`` counts more than once."""
    marks = _marked(names.where("times > 1"), words).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    known = _marked(rows, words).join(F.broadcast(marks), "word", "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")), F.lit(0)) != 0
    return known.where(~hit).select("a", "b", "row"), known.where(hit).select("a", "b", "row")


def _scatter(counted: DataFrame, n_buckets: int) -> DataFrame:
    """Each row as often as it occurs, with its number, in its bucket."""
    x = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    x = x.withColumn("h", F.xxhash64(F.lit(SEED + 2), "a", "b", "copy"))
    return x.withColumn("bucket", F.pmod("h", F.lit(n_buckets)).cast("long"))


def buckets_for(rows: int, size: int, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So many buckets that a mean one holds neither more rows nor more bytes than these."""
    return max(1, -(-rows // bucket_rows), -(-size // bucket_bytes))


def external_shuffle(
    df: DataFrame, n_shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, words: int = WORDS, scratch: Scratch | None = None,
) -> DataFrame:
    """All rows of ``df`` with shard (0 to n_shards - 1) and slot (from 0, without gaps in a shard).

    Rows that occur once cross the network once: they are scattered. Repeated ones are first brought together, as one row and its
    times, then scattered as well. Tasks hold ranges of buckets, so they write their rows where they are. What is returned reads
    ``names`` and ``repeated`` of ``scratch``.
    """
    scratch = scratch or Scratch(df.sparkSession)
    df = df.drop("shard", "slot")
    size = [F.coalesce(F.octet_length(column(f.name)), F.lit(0)).cast("long") if f.dataType.typeName() in ("string", "binary") else F.lit(8).cast("long") for f in df.schema]
    sizes = df.select(reduce(lambda a, b: a + b, size).alias("bytes"))
    total, volume = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_buckets = buckets_for(total, volume, bucket_rows, bucket_bytes)
    rows, times = _named(df), F.count(F.lit(1)).alias("times")
    names = scratch.save(rows.groupBy("a", "b").agg(times), "names")
    once, often = _once_and_often(rows, names, words)
    repeated = scratch.save(often.groupBy("a", "b", "row").agg(times), "repeated")
    scattered = _scatter(once.withColumn("times", F.lit(1).cast("long")).unionByName(repeated), n_buckets)
    counts = _scatter(names, n_buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = prefix_sums(counts, "bucket", "n", "offset").drop("n")

    record = F.struct("h", "a", "b", "copy", "row")
    buckets = scattered.repartitionByRange("bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(record)).alias("rows"))

    def step(done, i):
        j = F.pmod(F.xxhash64(F.lit(SEED + 3), F.col("bucket"), i), i + 1).cast("int")
        moved = F.concat(F.slice(done, 1, j), F.array(i), F.slice(done, j + 2, i - j - 1), F.slice(done, j + 1, 1))
        return F.when(i == j, F.concat(done, F.array(i))).otherwise(moved)

    order = F.aggregate(F.sequence(F.lit(0), F.size("rows") - 1), F.array().cast("array<int>"), step)
    buckets = buckets.withColumn("order", order).join(F.broadcast(offsets) if n_buckets <= FEW else offsets, "bucket")
    placed = buckets.select("offset", F.posexplode(F.transform("order", lambda i: F.get("rows", i)["row"])).alias("pos", "row"))
    placed = placed.withColumn("at", F.col("offset") + F.col("pos"))
    placed = placed.withColumn("shard", F.expr(f"(at * {n_shards}L) div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(cast(shard as long) * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("slot", (F.col("at") - first).cast("long")).select("row.*", "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Writes what external_shuffle() gives, as folders shard=N, each file in the order of its slots, from the tasks that shuffled."""
    df.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def sharded(df: DataFrame, **options) -> DataFrame:
    """``df`` shuffled, written as shards to the shared folder and read again, with shard and slot."""
    scratch = Scratch(df.sparkSession)
    out = external_shuffle(df, scratch=scratch, **options)
    with scratch.settings():
        write_shards(out, f"{scratch.base}/shards")
    scratch.drop("names", "repeated")
    return df.sparkSession.read.schema(out.schema).parquet(f"{scratch.base}/shards").select(*out.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """Whole documents are shuffled and written; sizes and checksums are those of the texts read from the shards."""
    out = stage(spark, table(spark, sf_dir, "documents"), sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.col("text").cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, from the written shards."""
    return sharded(docs)
