"""The query surface: metrics, listings, statistics and searches. ``as_of`` is the day that counts as today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import count_where, items, pct, percent_text, preview, rounded_avg, snippet, truncated, yes
from tidewright.operators import views
from tidewright.sources.tables import ARCHIVED

LISTING = ["id", "company", "role", "status", "is_remote", "priority", "tech_stack", "salary_range", "recruiter_name", "recruiter_phone", "notes", "discovered_date", "last_interaction_date", "updated_at"]


def priority_rank(column: str = "priority") -> Column:
    """1, 2, 3 for High, Medium, Low; null (first) for others."""
    c = F.col(column)
    return F.when(c == "High", 1).when(c == "Medium", 2).when(c == "Low", 3)


def active() -> Column:
    return ~F.col("status").isin(*ARCHIVED)


def within_week(day: Column, as_of) -> Column:
    today = F.lit(as_of).cast("date")
    return day.between(today, F.date_add(today, 7))


def metrics(opportunities: DataFrame, interactions: DataFrame, as_of) -> DataFrame:
    """One row of four counts. Each table is read once; the two one-row sums meet in a union, not a cross join."""
    a = opportunities.where(active()).agg(F.count(F.lit(1)).alias("active_count"), count_where(F.col("is_remote")).alias("remote_count"), count_where(F.col("priority") == "High").alias("priority_count"))
    b = interactions.where((F.col("type") == "Interview") & within_week(F.col("date"), as_of)).agg(F.count(F.lit(1)).alias("interview_count"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("active_count", "interview_count", "remote_count", "priority_count")])


def week_agenda(interactions: DataFrame, opportunities: DataFrame, as_of) -> DataFrame:
    wanted = interactions.where((F.col("type") == "Interview") & within_week(F.col("date"), as_of))
    return views.agenda(wanted, opportunities).orderBy("date", F.col("time").asc_nulls_first(), "id")


def pipeline(opportunities: DataFrame, limit: int = 50) -> DataFrame:
    return opportunities.where(active()).orderBy(priority_rank().asc_nulls_first(), F.desc("updated_at"), "id").limit(limit).select(*LISTING)


def archived(opportunities: DataFrame, limit: int = 50) -> DataFrame:
    return opportunities.where(F.col("status").isin(*ARCHIVED)).orderBy(F.desc("updated_at"), "id").limit(limit).select(*LISTING)


def recent_questions(questions: DataFrame, opportunities: DataFrame, limit: int = 20) -> DataFrame:
    """The newest questions with their company: the limit comes before the join, which has one match at most."""
    newest = questions.orderBy(F.desc("created_at"), "id").limit(limit)
    return newest.join(opportunities.select(F.col("id").alias("opportunity_id"), "company"), "opportunity_id", "left").orderBy(F.desc("created_at"), "id")


def practice_stats(sessions: DataFrame) -> DataFrame:
    right = F.sum(yes(F.col("is_correct")))
    level = lambda name: count_where(F.col("difficulty") == name)
    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"), right.cast("long").alias("correct_count"), pct(right, F.count(F.lit(1))).alias("accuracy_percentage"), F.sum("time_spent_minutes").cast("long").alias("total_minutes"),
        F.count_distinct("platform").alias("platforms_used"), level("Easy").alias("easy_count"), level("Medium").alias("medium_count"), level("Hard").alias("hard_count"),
    )


def recent_practice(sessions: DataFrame, limit: int = 10) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return recent_practice(sessions, n).select("practice_date", "platform", "difficulty", "is_correct", "time_spent_minutes", "keywords_used")


def recent_weeks(sessions: DataFrame, limit: int = 8) -> DataFrame:
    return views.weekly_summary(sessions).limit(limit)


def work_stats(log: DataFrame) -> DataFrame:
    """The view with sums of an empty log as zeros; its days stay null."""
    x = views.work_stats(log)
    return x.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in (("total_minutes", "long"), ("avg_minutes_per_stone", "double"), ("total_hours", "double"))})


def recent_work(log: DataFrame, limit: int = 5) -> DataFrame:
    return log.orderBy(F.desc("date"), F.desc("created_at"), F.desc("id")).limit(limit)


def sources(job_sources: DataFrame) -> DataFrame:
    return job_sources.orderBy(F.desc("is_default"), "source_name")


def scraped_jobs(jobs: DataFrame, min_score: float = 70.0, limit: int = 50, classification: str | None = None, source: str | None = None) -> DataFrame:
    """Filtered top postings, best and newest first. Filters that are empty do not apply; null scores never pass."""
    x = jobs.where(F.col("match_score") >= F.lit(float(min_score)))
    if classification:
        x = x.where(F.col("classification") == classification)
    if source:
        x = x.where(F.col("source") == source)
    x = x.orderBy(F.desc("match_score"), F.desc("scraped_at"), "id").limit(limit)
    out = {"match_score": F.round("match_score", 1), "description": preview(F.col("description")), "imported_to_opportunities": F.col("imported_to_opportunities").cast("boolean")}
    for c, name, value in (("matched_skills", "skill", "weight"), ("matched_domains", "domain", "weight"), ("red_flags", "flag", "penalty")):
        if c in jobs.columns:
            out[c] = items(F.col(c), name, value) if dict(jobs.dtypes)[c] == "string" else F.coalesce(F.col(c), F.from_json(F.lit("[]"), f"array<struct<{name}:string,{value}:int>>"))
    return x.withColumns({k: v for k, v in out.items() if k in jobs.columns})


def scraped_jobs_envelope(jobs: DataFrame, **filters) -> dict:
    """The answer with its count (after the limit) and the filters that applied; its rows are bounded by the limit."""
    rows = [r.asDict(recursive=True) for r in scraped_jobs(jobs, **filters).collect()]
    given = {"min_score": 70.0, "limit": 50, "classification": None, "source": None} | filters
    return {"success": True, "jobs": rows, "count": len(rows), "filters_applied": given}


def scraped_stats(jobs: DataFrame) -> DataFrame:
    """One pass: the histogram of scores, their mean, the newest, how many are imported. A null score is in no bucket."""
    s = F.col("match_score")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), count_where(s >= 85).alias("excellent"), count_where((s >= 75) & (s < 85)).alias("high_fit"), count_where((s >= 65) & (s < 75)).alias("medium_fit"),
        count_where((s >= 40) & (s < 65)).alias("low_fit"), count_where(s < 40).alias("no_fit"), F.round(F.avg("match_score"), 1).alias("avg_score"), F.max("scraped_at").alias("last_scraped"),
        count_where(F.col("imported_to_opportunities")).alias("imported_count"),
    )


def source_breakdown(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("match_score"), 1).alias("avg_score")).orderBy(F.desc("count"), F.col("source").asc_nulls_first())


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def max_id(df: DataFrame) -> DataFrame:
    return df.agg(F.max("id").alias("max_id"))


def top_scores(jobs: DataFrame, n: int = 10, least: float | None = None) -> DataFrame:
    x = jobs if least is None else jobs.where(F.col("match_score") >= F.lit(float(least)))
    return x.orderBy(F.col("match_score").desc_nulls_last(), "id").limit(n).select("id", "job_title", "company", percent_text(truncated(F.col("match_score"))).alias("score"), "classification")


def class_rank() -> Column:
    out = F
    for i, name in enumerate(("EXCELLENT", "HIGH_FIT", "MEDIUM_FIT", "LOW_FIT", "NO_FIT")):
        out = out.when(F.col("classification") == name, i)
    return out


def class_summary(jobs: DataFrame) -> DataFrame:
    x = jobs.groupBy("classification").agg(F.count(F.lit(1)).alias("count"), percent_text(truncated(F.avg("match_score"))).alias("avg_score"))
    return x.orderBy(class_rank().asc_nulls_first(), "classification")


def class_ranges(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("classification").agg(F.min("match_score").alias("min_score"), F.max("match_score").alias("max_score"), F.count(F.lit(1)).alias("count"))


def class_counts(jobs: DataFrame) -> DataFrame:
    """By the best score of each class: ordering by a bare column would depend on an arbitrary row."""
    return jobs.groupBy("classification").agg(F.count(F.lit(1)).alias("count"), F.max("match_score").alias("best")).orderBy(F.col("best").desc_nulls_last(), "classification").drop("best")


def category_counts(opportunities: DataFrame, job_sources: DataFrame) -> DataFrame:
    """Labelled totals. The three of one table come from one pass."""
    sums = opportunities.agg(F.count(F.lit(1)).alias("Total"), count_where(active()).alias("Active"), count_where(F.col("status").isin(*ARCHIVED)).alias("Archived"))
    rows = sums.unpivot([], ["Total", "Active", "Archived"], "category", "count")
    return rows.unionByName(job_sources.agg(F.count(F.lit(1)).alias("count")).withColumn("category", F.lit("Sources")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def status_counts(opportunities: DataFrame) -> DataFrame:
    return opportunities.groupBy("status").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col("status").asc_nulls_first())


def latest_questions(questions: DataFrame, n: int = 3) -> DataFrame:
    return questions.orderBy(F.desc("created_at"), "id").limit(n).select("id", snippet(F.col("question_text"), 50).alias("question"), "question_type")


def with_skill(jobs: DataFrame, word: str, limit: int = 10) -> DataFrame:
    """Postings of which a matched skill holds the word. (A match on the JSON text would also hit its keys.)"""
    skills = F.col("matched_skills") if dict(jobs.dtypes)["matched_skills"] != "string" else items(F.col("matched_skills"), "skill")
    return jobs.where(F.exists(skills, lambda s: s["skill"].ilike(f"%{word}%"))).orderBy(F.col("match_score").desc_nulls_last(), "id").limit(limit).select("id", "job_title", "company", "match_score")


def at_location(jobs: DataFrame, word: str, least: float = 60) -> DataFrame:
    return jobs.where(F.col("location").ilike(f"%{word}%") & (F.col("match_score") >= least)).orderBy(F.desc("match_score"), "id").select("id", "job_title", "company", "location", "match_score")


def titled_or_tagged(jobs: DataFrame, word: str, least: float = 50) -> DataFrame:
    hit = F.col("job_title").ilike(f"%{word}%") | F.col("tags").ilike(f"%{word}%")
    return jobs.where(hit & (F.col("match_score") >= least)).orderBy(F.desc("match_score"), "id").select("id", "job_title", "tags", "match_score")


def scraped_on(jobs: DataFrame, as_of) -> DataFrame:
    """Postings of a day, as a range of timestamps that reaches the scan."""
    day = F.lit(as_of).cast("date")
    return jobs.where((F.col("scraped_at") >= day.cast("timestamp")) & (F.col("scraped_at") < F.date_add(day, 1).cast("timestamp")))


def high_fit_on(jobs: DataFrame, as_of) -> DataFrame:
    return scraped_on(jobs, as_of).where(F.col("classification").isin("EXCELLENT", "HIGH_FIT")).agg(F.count(F.lit(1)).alias("high_fit"))


def scored_listing(jobs: DataFrame, least: float = 60, limit: int = 50) -> DataFrame:
    x = jobs.where(F.col("match_score") >= least).orderBy(F.desc("match_score"), "id").limit(limit)
    return x.select("id", F.concat_ws(" - ", "job_title", "company").alias("posting"), percent_text(truncated(F.col("match_score"))).alias("score"))


def of_companies(opportunities: DataFrame, names: list[str]) -> DataFrame:
    return opportunities.where(F.col("company").isin(*names)).orderBy(F.desc("id")).select("id", "company", "role", "status", "priority")


def listing(opportunities: DataFrame) -> DataFrame:
    return opportunities.select("company", "role", "status")


def summary(jobs: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The histogram and the n best."""
    return scraped_stats(jobs), top_scores(jobs, n)


def dashboard(gaps: DataFrame, topics: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: gaps that are mostly weak, topics and their hours, postings of the two best bands. One-row sums meet in a union."""
    a = gaps.agg(count_where(F.col("weak_percentage") > 50).alias("weak_count"))
    b = topics.agg(F.count(F.lit(1)).alias("topic_count"), F.round(F.coalesce(F.sum("total_study_hours"), F.lit(0.0))).cast("long").alias("study_hours"))
    c = jobs.agg(count_where(F.col("match_score") >= 75).alias("strong_count"))
    both = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return both.agg(*[F.max(x).alias(x) for x in ("weak_count", "topic_count", "study_hours", "strong_count")])
