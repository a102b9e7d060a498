"""Data quality: each check gives the rows, or the counts, that tell whether the data hold what they must."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import count_where, pct, yes
from tidewright.operators import queries, views
from tidewright.sources.tables import ARCHIVED, DOMAINS


def totals(opportunities: DataFrame) -> DataFrame:
    """Active and archived add up to all, but for null statuses."""
    counts = opportunities.agg(F.count(F.lit(1)).alias("total"), count_where(queries.active()).alias("active"), count_where(F.col("status").isin(*ARCHIVED)).alias("archived"))
    return counts.withColumn("consistent", F.col("active") + F.col("archived") == F.col("total"))


def orphans(interactions: DataFrame, opportunities: DataFrame) -> DataFrame:
    return interactions.join(opportunities.select(F.col("id").alias("opportunity_id")), "opportunity_id", "left_anti")


def outside_domain(df: DataFrame, table: str, column: str) -> DataFrame:
    return df.where(~F.col(column).isin(*DOMAINS[table, column]))


def parity(opportunities: DataFrame, interactions: DataFrame) -> DataFrame:
    """As many active rows by the view as by the filter."""
    a = views.active_pipeline(opportunities, interactions).agg(F.count(F.lit(1)).alias("n")).withColumn("by", F.lit("view"))
    return a.unionByName(opportunities.where(queries.active()).agg(F.count(F.lit(1)).alias("n")).withColumn("by", F.lit("filter")))


def gaps_too_good(gaps: DataFrame) -> DataFrame:
    """Rows of learning_gaps that should not be there."""
    return gaps.where("avg_performance >= 4")


def time_travel(df: DataFrame, as_of) -> DataFrame:
    """Rows updated before they were created, or created after now."""
    return df.where((F.col("updated_at") < F.col("created_at")) | (F.col("created_at") > F.lit(as_of).cast("timestamp")))


def score_bounds(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("match_score") < 0) | (F.col("match_score") > 100))


def mastery_recomputed(mastery: DataFrame) -> DataFrame:
    """Keywords whose accuracy differs from the one recomputed from its parts."""
    return mastery.where(pct(F.col("correct_count").cast("double"), F.col("practice_count")) != F.col("accuracy_percentage"))


def accuracy(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(pct(F.sum(yes(F.col(flag))), F.count(F.lit(1))).alias("accuracy"))
