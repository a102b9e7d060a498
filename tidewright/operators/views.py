"""The views: functions of tables (and a day) that give frames. Orders that a limit relies on are total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import count_where, pct, rounded_avg, week_label, yes
from tidewright.sources.tables import ARCHIVED

PIPELINE = ["id", "company", "role", "status", "is_remote", "priority", "tech_stack", "discovered_date", "last_interaction_date"]


def active_pipeline(opportunities: DataFrame, interactions: DataFrame) -> DataFrame:
    """Active rows with how many interactions they have and the latest. Interactions are summed before the join."""
    sums = interactions.groupBy(F.col("opportunity_id").alias("id")).agg(F.count("id").alias("interaction_count"), F.max("date").alias("latest_interaction"))
    x = opportunities.where(~F.col("status").isin(*ARCHIVED)).join(sums, "id", "left")
    return x.select(*PIPELINE, F.coalesce("interaction_count", F.lit(0)).cast("long").alias("interaction_count"), "latest_interaction", "updated_at").orderBy(F.desc("priority"), F.desc("updated_at"), "id")


def agenda(interactions: DataFrame, opportunities: DataFrame) -> DataFrame:
    o = opportunities.select(F.col("id").alias("opportunity_id"), "company", "role", "status")
    return interactions.join(o, "opportunity_id").select("id", "type", "date", "time", "meet_link", "company", "role", "status", "participants", "summary")


def todays_agenda(interactions: DataFrame, opportunities: DataFrame, as_of) -> DataFrame:
    """All interactions of the day, of any type."""
    return agenda(interactions.where(F.col("date") == F.lit(as_of).cast("date")), opportunities).orderBy(F.col("time").asc_nulls_first(), "id")


def _accuracy():
    right = F.sum(yes(F.col("is_correct")))
    return right.cast("long"), pct(right, F.count(F.lit(1)))


def keyword_mastery(sessions: DataFrame) -> DataFrame:
    """Per keyword of the comma-separated lists, repeats counted."""
    x = sessions.withColumn("keyword", F.explode(F.split("keywords_used", ","))).withColumn("keyword", F.trim("keyword")).where("keyword <> ''")
    right, accuracy = _accuracy()
    x = x.groupBy("keyword").agg(F.count(F.lit(1)).alias("practice_count"), right.alias("correct_count"), accuracy.alias("accuracy_percentage"), rounded_avg(F.col("time_spent_minutes")).alias("avg_time_minutes"))
    return x.orderBy(F.desc("practice_count"), F.col("accuracy_percentage").asc_nulls_first(), "keyword")


def weekly_summary(sessions: DataFrame) -> DataFrame:
    right, accuracy = _accuracy()
    level = lambda name: count_where(F.col("difficulty") == name)
    x = sessions.groupBy(week_label(F.col("practice_date")).alias("week")).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.count_distinct("platform").alias("platforms_used"), right.alias("correct_answers"), accuracy.alias("accuracy_percentage"),
        F.sum("time_spent_minutes").cast("long").alias("total_minutes"), level("Easy").alias("easy_questions"), level("Medium").alias("medium_questions"), level("Hard").alias("hard_questions"),
    )
    return x.orderBy(F.desc("week"))


def common_mistakes(sessions: DataFrame, limit: int = 10) -> DataFrame:
    x = sessions.where("error_made is not null and error_made <> ''").groupBy("error_made").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.array_join(F.array_sort(F.collect_set("keywords_used")), ",").alias("related_keywords"),
        rounded_avg(F.col("time_spent_minutes")).alias("avg_recovery_time"),
    )
    x = x.withColumn("related_keywords", F.when(F.col("related_keywords") != "", F.col("related_keywords")))
    return x.orderBy(F.desc("occurrence_count"), "error_made").limit(limit)


def progress_by_difficulty(sessions: DataFrame) -> DataFrame:
    right, accuracy = _accuracy()
    x = sessions.groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("total_attempted"), right.alias("correct"), accuracy.alias("accuracy_percentage"),
        F.avg(F.col("time_spent_minutes").cast("double")).alias("avg_time_minutes"), F.min("practice_date").alias("first_attempt"), F.max("practice_date").alias("latest_attempt"),
    )
    order = F.when(F.col("difficulty") == "Easy", 1).when(F.col("difficulty") == "Medium", 2).when(F.col("difficulty") == "Hard", 3)
    return x.orderBy(order.asc_nulls_first(), "difficulty")


def work_progress(log: DataFrame) -> DataFrame:
    done = F.col("next_stone").isNotNull() & (F.col("next_stone") != "")
    return log.select("id", "date", "stone_number", "stone_title", "time_spent_minutes", "what_built", "insights", "next_stone", "felt_sense", F.when(done, "Complete").otherwise("In Progress").alias("status"), "created_at").orderBy("stone_number")


def work_stats(log: DataFrame) -> DataFrame:
    total = F.sum("time_spent_minutes").cast("long")
    return log.agg(
        F.count(F.lit(1)).alias("total_stones"), total.alias("total_minutes"), rounded_avg(F.col("time_spent_minutes")).alias("avg_minutes_per_stone"),
        F.min("date").alias("first_stone_date"), F.max("date").alias("latest_stone_date"), F.round(total / F.lit(60.0), 1).alias("total_hours"),
    )


def learning_gaps(questions: DataFrame) -> DataFrame:
    """Reconstructed: per type and difficulty, where the mean rating is below 4; weak is a rating of 2 or less."""
    x = questions.groupBy(F.coalesce("question_type", F.lit("General")).alias("question_type"), "difficulty").agg(
        F.count(F.lit(1)).alias("question_count"), F.avg(F.col("my_rating").cast("double")).alias("avg_performance"), F.min("my_rating").alias("min_rating"),
        pct(F.sum(yes(F.col("my_rating") <= 2)), F.count(F.lit(1))).alias("weak_percentage"),
    )
    return x.where("avg_performance < 4").orderBy("avg_performance", "question_type", F.col("difficulty").asc_nulls_first())


def study_priority(topics: DataFrame) -> DataFrame:
    """Reconstructed: priority times what is missing to mastery of 5."""
    return topics.withColumn("priority_score", F.col("priority") * (F.lit(5.0) - F.col("mastery_level"))).orderBy(F.col("priority_score").desc_nulls_last(), "id")


def archived_pipeline(opportunities: DataFrame) -> DataFrame:
    return opportunities.where(F.col("status").isin(*ARCHIVED))
