"""The weekly report: eight sections over the practice log. The correlation section also reads questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import minutes_text, percent_text, snippet, yes
from tidewright.operators import views

# fixed values: topics that the correlation looks at, and the keyword of each
TOPICS = {"Technical SQL": "JOIN", "Data Warehouse": "WINDOW"}


def last_weeks(sessions: DataFrame, n: int = 4) -> DataFrame:
    mixed = F.concat(F.col("easy_questions").cast("string"), F.lit("E / "), F.col("medium_questions").cast("string"), F.lit("M / "), F.col("hard_questions").cast("string"), F.lit("H"))
    x = views.weekly_summary(sessions).limit(n)
    return x.select("week", F.col("total_sessions").alias("sessions"), percent_text(F.col("accuracy_percentage")).alias("accuracy"), minutes_text(F.col("total_minutes")).alias("time"), mixed.alias("difficulty"))


def mastery(sessions: DataFrame, n: int = 10) -> DataFrame:
    x = views.keyword_mastery(sessions).limit(n)
    return x.select("keyword", F.col("practice_count").alias("practices"), percent_text(F.col("accuracy_percentage")).alias("accuracy"), minutes_text(F.round("avg_time_minutes", 1)).alias("avg_time"))


def mistakes(sessions: DataFrame, n: int = 5) -> DataFrame:
    x = views.common_mistakes(sessions).limit(n)
    return x.select(F.col("error_made").alias("mistake"), F.col("occurrence_count").alias("count"), minutes_text(F.round("avg_recovery_time", 1)).alias("avg_recovery"))


def levels(sessions: DataFrame) -> DataFrame:
    x = views.progress_by_difficulty(sessions)
    return x.select(
        F.col("difficulty").alias("level"), F.col("total_attempted").alias("attempted"), "correct", percent_text(F.col("accuracy_percentage")).alias("accuracy"),
        minutes_text(F.round("avg_time_minutes", 1)).alias("avg_time"), F.col("latest_attempt").alias("latest_practice"),
    )


def _last_week(sessions: DataFrame, as_of) -> DataFrame:
    return sessions.where(F.col("practice_date") >= F.date_sub(F.lit(as_of).cast("date"), 7))


def recent(sessions: DataFrame, as_of) -> DataFrame:
    x = _last_week(sessions, as_of).orderBy(F.desc("practice_date"), F.desc("created_at"), "id")
    return x.select(
        "practice_date", "platform", F.col("difficulty").alias("level"), F.when(F.col("is_correct"), "✅").otherwise("❌").alias("result"),
        snippet(F.col("question_text"), 60).alias("question"), minutes_text(F.col("time_spent_minutes")).alias("time"),
    )


def recommended(sessions: DataFrame, n: int = 5) -> DataFrame:
    x = views.keyword_mastery(sessions).where("accuracy_percentage < 70 and practice_count >= 2").orderBy(F.desc("practice_count"), "keyword").limit(n)
    return x.select(F.concat(F.lit("Practice: "), "keyword").alias("recommendation"), F.concat(F.lit("Current Accuracy: "), percent_text(F.col("accuracy_percentage"))).alias("reason"))


def correlation(questions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per topic: questions, mean rating, and the practice sessions whose keywords hold the topic's keyword.

    Both sides are summed first: ratings are not weighted by sessions. The sessions' sums are one row,
    turned into a row for each topic.
    """
    asked = questions.where(F.col("question_type").isin(*TOPICS)).groupBy("question_type").agg(F.count_distinct("id").alias("interview_questions"), F.avg(F.col("my_rating").cast("double")).alias("interview_rating"))
    held = sessions.agg(*[F.count(F.when(F.col("keywords_used").ilike(f"%{word}%"), F.lit(1))).alias(topic) for topic, word in TOPICS.items()])
    held = held.unpivot([], list(TOPICS), "question_type", "practice_sessions")
    return asked.join(held, "question_type", "left").orderBy("interview_rating", "question_type").select(F.col("question_type").alias("interview_topic"), "interview_questions", "interview_rating", F.coalesce("practice_sessions", F.lit(0)).cast("long").alias("practice_sessions"))


def insight(sessions: DataFrame, as_of) -> DataFrame:
    x = _last_week(sessions, as_of).agg(F.avg(yes(F.col("is_correct")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("total"))
    # fixed values: the texts
    says = (
        F.when(F.col("total") == 0, "No practice this week - Start with 3 Easy questions").when(F.col("total") < 5, "Good start! Aim for 5+ sessions per week")
        .when(F.col("accuracy") < 0.6, "Focus on quality over quantity - Review mistakes").when(F.col("accuracy") >= 0.8, "Great accuracy! Try harder questions").otherwise("Consistent practice - Keep going!")
    )
    week = F.concat(F.col("total").cast("string"), F.lit(" sessions, "), F.round(F.col("accuracy") * 100, 1).cast("string"), F.lit("% accuracy"))
    return x.select(says.alias("insight"), week.alias("this_week"))


def report(sessions: DataFrame, questions: DataFrame, as_of) -> dict[str, DataFrame]:
    """All sections by name."""
    return {
        "weeks": last_weeks(sessions), "mastery": mastery(sessions), "mistakes": mistakes(sessions), "levels": levels(sessions), "recent": recent(sessions, as_of),
        "recommended": recommended(sessions), "correlation": correlation(questions, sessions), "insight": insight(sessions, as_of),
    }
