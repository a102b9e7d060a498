"""Ingest: relevance filter, record mapping, scoring, insert-or-ignore. One lazy plan up to the write that ids are given to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import dollars
from tidewright.functions.scoring import Rules, score
from tidewright.sources.postings import LANDED
from tidewright.sources.staging import numbered

# fixed values: words of which a relevant posting holds one, as substrings
KEYWORDS = (
    "qa", "test", "quality", "automation", "sdet", "etl", "data", "sql", "analytics", "validation",
    "quality assurance", "test engineer", "data engineer", "backend", "api testing", "data quality",
)
# fixed values: those of the scheduled fetch
SCHEDULED_KEYWORDS = (
    "qa", "quality assurance", "testing", "test engineer", "etl", "data testing", "database", "quality engineer",
    "sdet", "automation", "manual testing", "data quality",
)
SOURCE = "RemoteOK"  # fixed value, like the next
JOB_URL = "https://remoteok.com/remote-jobs/"
DESCRIPTION = 2000  # characters kept
REQUIRED = ("job_title", "company", "job_url")  # of a stored posting


def relevant(df: DataFrame, keywords=KEYWORDS, required: tuple[str, ...] = ()) -> DataFrame:
    """Postings that hold a keyword in position, description or tags; ``required`` columns must not be empty."""
    tags = F.array_join("tags", " ") if dict(df.dtypes)["tags"].startswith("array") else F.col("tags")
    text = F.lower(F.concat_ws(" ", F.coalesce("position", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce(tags, F.lit(""))))
    x = df.where(F.exists(F.array(text), lambda t: reduce(lambda a, b: a | b, [t.contains(k) for k in keywords])))  # one text, not one for each keyword
    for c in required:
        x = x.where(F.coalesce(c, F.lit("")) != "")
    return x


def map_postings(df: DataFrame, now, ordinal: str | None = None) -> DataFrame:
    """Source records to the columns of scraped_jobs that scoring does not add. ``ordinal``: place in the batch, for missing ids.

    ``_ordinal`` orders the rows: as they landed, where that is known, else by place. Missing ids are made from the place in the
    batch alone, so a later batch may make one again; its row is then ignored.
    """
    landed = LANDED in df.columns and not ordinal
    place = F.col(ordinal) if ordinal else F.col(f"{LANDED}.place") + 1 if landed else F.monotonically_increasing_id() + 1
    order = F.col(LANDED) if landed else place
    stamp, day = (now, now.cast("string")) if isinstance(now, Column) else (F.lit(now).cast("timestamp"), F.lit(str(now)))
    low, high = F.col("salary_min"), F.col("salary_max")
    filled = lambda c, other: F.coalesce(c, F.lit(other))
    nonempty = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    salary = F.when((low > 0) & (high > 0), F.concat(dollars(low), F.lit(" - "), dollars(high))).when(low > 0, F.concat(dollars(low), F.lit("+")))
    return df.select(
        F.coalesce("id", F.concat(F.lit("remoteok_"), place.cast("string"))).alias("external_id"), F.lit(SOURCE).alias("source"),
        filled("position", "Unknown Position").alias("job_title"), filled("company", "Unknown Company").alias("company"),
        F.coalesce("url", F.concat(F.lit(JOB_URL), F.coalesce("slug", F.lit("")))).alias("job_url"), F.coalesce(nonempty("location"), F.lit("Remote")).alias("location"),
        filled("description", "").alias("_whole"), F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("tags"), salary.alias("salary_range"),
        F.coalesce("date", day).alias("posted_date"), stamp.alias("scraped_at"), order.alias("_ordinal"),
    )


def score_postings(mapped: DataFrame, rules: Rules) -> DataFrame:
    """Scores see whole descriptions; the stored one is cut."""
    x = score(mapped, rules, title="job_title", description="_whole", experience="_none")
    return x.withColumn("description", F.substring("_whole", 1, DESCRIPTION)).withColumnRenamed("final_score", "match_score").drop("_whole", "breakdown", "should_auto_import")


def insert_or_ignore(batch: DataFrame, target: DataFrame, key: str = "external_id", order: str = "_ordinal", required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows of the batch to append: the first of each key, none whose key the target has, none with nulls where none may be."""
    x = batch.where(F.col(key).isNotNull())
    for c in required:
        x = x.where(F.col(c).isNotNull())
    first = x.groupBy(key).agg(F.min_by(F.struct("*"), F.col(order)).alias("_row"))  # partial minima: no hot key is sorted
    return first.select("_row.*").join(target.select(key), key, "left_anti").select(*x.columns)


def ingest(postings: DataFrame, target: DataFrame, rules: Rules, now, keywords=KEYWORDS, ordinal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new rows for scraped_jobs with their ids, one row with stored and high_fit counts of them).

    The new rows are written to the shared folder and numbered there, after the largest id of the target in the order of
    arrival (or of the column ``ordinal``); rows and counts both read what was written. sources.staging.unstage() deletes it.
    """
    scored = score_postings(map_postings(relevant(postings, keywords), now, ordinal), rules)
    new = insert_or_ignore(scored, target).withColumn("imported_to_opportunities", F.lit(False))
    return identified(new, target)


def identified(new: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that insert_or_ignore() would append, written and numbered; and their counts."""
    top = target.agg(F.max("id").alias("m")).first()["m"] or 0
    new = numbered(new, "_ordinal", name="id", after=top).drop("_ordinal")
    high = F.count_if(F.col("classification").isin("EXCELLENT", "HIGH_FIT"))
    return new, new.agg(F.count(F.lit(1)).alias("stored"), high.alias("high_fit"))


def map_scheduled(df: DataFrame, now) -> DataFrame:
    """The records of the scheduled fetch: unscored, with the salary as text; for the JSON sink."""
    x = relevant(df, SCHEDULED_KEYWORDS, ("position", "company"))
    return x.select(
        F.coalesce("id", "slug").alias("id"), F.col("position").alias("title"), "company", F.concat(F.lit(JOB_URL), F.coalesce("slug", "id")).alias("url"),
        F.coalesce("location", F.lit("Remote")).alias("location"), F.coalesce("date", F.to_date(F.lit(now).cast("timestamp")).cast("string")).alias("posted_date"),
        F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION).alias("description"), F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("tags"),
        F.when(F.col("salary_max") > 0, F.concat(F.lit("$"), F.col("salary_max").cast("string"))).otherwise("Not specified").alias("salary"), F.lit(SOURCE).alias("source"),
        F.lit(now).cast("timestamp").alias("scraped_at"), F.lit("new").alias("status"), F.lit(None).cast("double").alias("match_score"), F.lit(False).alias("applied"),
    )


def good_matches(scored: DataFrame, least: float = 75) -> DataFrame:
    return scored.where(F.col("final_score") >= least)


def best_match(scored: DataFrame) -> DataFrame:
    """The row with the highest score; of equals the first title."""
    return scored.orderBy(F.desc("final_score"), "title").limit(1)


def batch_summary(scored: DataFrame) -> DataFrame:
    """Rows, mean, best and counts by class of a scored batch, as one row."""
    classes = scored.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.sum("final_score").alias("s"), F.max("final_score").alias("m"))
    return classes.agg(
        F.sum("n").alias("total"), F.round(F.try_divide(F.sum("s"), F.sum("n")), 2).alias("mean"), F.max("m").alias("best"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("classification", "n")))).alias("classes"),
    )
