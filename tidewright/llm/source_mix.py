"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated up to ``cap`` times. A queued
document gets the virtual finish time (words of its source up to and with it) / (target of its
source); the queues are served in the order of that time until the budget is used up.

A source's queue is cut into slices of about ``ROWS`` rows by its shuffled order, so a hot source is dealt over many tasks;
virtual time is cut into slices as fine, of which only the one in which the budget ends is added up row by row. Both counts
grow with the rows. What one task holds besides is a row for each source.

Defined results: null text counts 0 words; null sources are one source, the last; repeated rows
are documents of their own; an empty table gives an empty table; columns of any other name are
kept, and only ``size source_size target copies taken`` are written (over clashing columns).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import Scratch, prefix_sums, table, word_count

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
CAP = 3
ROWS = 1024  # of a slice of a queue or of virtual time, on average


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_none, _source, source_size) to the same with target: shares by weight, none above cap times its size.

    One row for each source. Sources ordered by cap * size / weight fill up in that order, so the level
    at which the others stand follows from running sums.
    """
    by_name = Window.orderBy("_none", "_source")
    by_fill = Window.orderBy(F.col("_ceiling") / F.col("_weight"), "_none", "_source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("_weight", weight.cast("long")).withColumn("_ceiling", (F.col("source_size") * cap).cast("long"))
    x = x.withColumn("_before", F.coalesce(F.sum("_ceiling").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_left", F.sum("_weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    x = x.withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
    x = x.withColumn("_level", (F.col("_total") - F.col("_before")).cast("double") / F.col("_left").cast("double"))
    x = x.withColumn("_full", F.col("_ceiling").cast("double") / F.col("_weight").cast("double") <= F.col("_level"))
    level = F.max_by("_level", F.when(~F.col("_full"), -F.col("_before"))).over(Window.partitionBy())
    x = x.withColumn("_final", level)
    full = F.col("_full") | F.col("_final").isNull()
    return x.withColumn("target", F.when(full, F.col("_ceiling").cast("double")).otherwise(F.col("_final") * F.col("_weight").cast("double"))).select("_none", "_source", "source_size", "target")


def _order_key(doc_id: Column, size: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), size.cast("string")).cast("binary"))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, size: Column | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text) with size, source_size, target, copies and taken.

    Shuffles: the rows once by (source, slice of the shuffled order), so that a hot source is dealt
    over thousands of tasks, and written once to the scratch folder; all else is sums by source and
    slice. The tables of slices and cuts have a row for each source (and slice): joins leave it to
    their measured size whether they are broadcast.
    """
    mine = ["size", "source_size", "target", "copies", "taken"]
    scratch = Scratch(docs.sparkSession)
    size = word_count(F.col("text")) if size is None else size
    columns = [c for c in docs.columns if c not in mine]
    x = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id"), size.alias("size"), F.col("source").isNull().alias("_none"), F.coalesce(F.col("source"), F.lit("")).alias("_source"))
    bits = min(32, (docs.count() // ROWS).bit_length())  # slices of all queues together are as many as this power of two, or a few for each source
    x = x.withColumn("_key", _order_key(F.col("doc_id"), F.col("size"))).drop("doc_id")
    x = x.withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - bits))
    tie = ["_key", "size"] + [f"_row.{c}" for c in columns if c == "text"]
    inside = Window.partitionBy("_none", "_source", "_bucket").orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    x = scratch.save(x.withColumn("_inside", F.sum("size").over(inside)), "queues")

    slices = x.groupBy("_none", "_source", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_none", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    goal = scratch.save(targets(x.groupBy("_none", "_source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    slices = scratch.save(slices.join(goal, ["_none", "_source"]), "slices")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(slices, ["_none", "_source", "_bucket"]).withColumn("_at", F.col("_base") + F.col("_inside"))

    cuts = scratch.save(_cuts(placed(x.select("_none", "_source", "_bucket", "_inside", "size")), cap, 1 << bits), "cuts")
    x = placed(x).join(cuts, ["_none", "_source"], "left")
    served = [F.when(F.col("_at") + F.col("source_size") * F.lit(e) <= F.col("_cut"), 1).otherwise(0) for e in range(cap)]
    copies = F.when(F.col("size") > 0, reduce(lambda a, b: a + b, served)).otherwise(0)
    x = x.withColumn("copies", copies.cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return x.select("_row.*", *mine)


def _cuts(x: DataFrame, cap: int, slices: int) -> DataFrame:
    """(_none, _source, _cut): the place in each source's queue up to which the budget serves it.

    Pass one sums words by slices of virtual time and finds the slice in which the budget ends. Pass
    two adds up the queue in that slice alone, in full order.
    """
    turn = x.where("size > 0").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    turn = turn.withColumn("_place", F.col("_at") + F.col("source_size") * F.col("_turn"))
    turn = turn.withColumn("_time", F.col("_place").cast("double") / F.col("target")).where("target > 0")
    turn = turn.withColumn("_slice", F.floor(F.least(F.col("_time"), F.lit(4.0)) * slices).cast("long"))
    sums = turn.groupBy("_slice").agg(F.sum("size").alias("_words"))
    budget = x.agg(F.sum("size").alias("b")).first()["b"] or 0  # 100 % of all words
    over = prefix_sums(sums, "_slice", "_words", "_before").where(F.col("_before") + F.col("_words") > budget).orderBy("_slice").first()
    last, left = (over["_slice"], budget - over["_before"]) if over else (1 << 62, 0)
    order = Window.orderBy("_time", "_none", "_source", "_place").rowsBetween(Window.unboundedPreceding, 0)
    edge = turn.where(F.col("_slice") == last).withColumn("_run", F.sum("size").over(order)).where(F.col("_run") <= left)
    kept = turn.where(F.col("_slice") < last).select("_none", "_source", "_place").unionByName(edge.select("_none", "_source", "_place"))
    return kept.groupBy("_none", "_source").agg(F.max("_place").alias("_cut"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return fair_mix(docs, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = fair_mix(docs).where("copies > 0")
    return taken.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


SQL = rf"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size) AS k
  FROM (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)
), s AS (
  SELECT none, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY none, src
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1 AS BIGINT) AS weight, source_size * {CAP} AS ceiling FROM s
), f AS (
  SELECT *, CAST(coalesce(sum(ceiling) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS remaining,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM w WINDOW o AS (ORDER BY CAST(ceiling AS DOUBLE) / CAST(weight AS DOUBLE), none, src)
), l AS (
  SELECT *, CAST(total - before AS DOUBLE) / CAST(remaining AS DOUBLE) AS lvl FROM f
), t AS (
  SELECT none, src, source_size, total,
         CASE WHEN CAST(ceiling AS DOUBLE) / CAST(weight AS DOUBLE) <= lvl
                OR (SELECT min(before) FROM l WHERE CAST(ceiling AS DOUBLE) / CAST(weight AS DOUBLE) > lvl) IS NULL
              THEN CAST(ceiling AS DOUBLE)
              ELSE (SELECT arg_min(lvl, before) FROM l WHERE CAST(ceiling AS DOUBLE) / CAST(weight AS DOUBLE) > lvl) * CAST(weight AS DOUBLE) END AS target
  FROM l
), q AS (
  SELECT d.*, t.source_size, t.target, t.total,
         CAST(sum(size) OVER (PARTITION BY none, src ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS place
  FROM d JOIN t USING (none, src)
), e AS (
  SELECT doc_id, k, none, src, size, total, target, place + source_size * r AS at_, CAST(place + source_size * r AS DOUBLE) / target AS vft
  FROM q, (SELECT unnest([0, 1, 2]) AS r) WHERE size > 0 AND target > 0
), a AS (
  SELECT *, sum(size) OVER (ORDER BY vft, none, src, at_ ROWS UNBOUNDED PRECEDING) AS run FROM e
), c AS (
  SELECT none, src, max(at_) AS cut FROM a WHERE run <= total GROUP BY none, src
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (CAST(place <= coalesce(cut, -1) AS BIGINT) + CAST(place + source_size <= coalesce(cut, -1) AS BIGINT)
            + CAST(place + 2 * source_size <= coalesce(cut, -1) AS BIGINT)) END AS BIGINT) AS taken
FROM q LEFT JOIN c USING (none, src)
"""
