"""The data model: schemas, value domains, defaults, loading and validation."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "opportunities": "id long, company string, role string, job_url string, source string, is_remote boolean, domain_match string, tech_stack string, salary_range string, status string, discovered_date date, applied_date date, first_contact_date date, last_interaction_date date, offer_date date, expected_start_date date, recruiter_name string, recruiter_email string, recruiter_phone string, hiring_manager string, notes string, priority string, created_at timestamp, updated_at timestamp, scraped_job_id long",
    "interactions": "id long, opportunity_id long, type string, date date, time string, duration_minutes int, calendar_event_id string, meet_link string, location string, participants string, summary string, action_items string, sentiment string, requires_followup boolean, followup_date date, created_at timestamp",
    "documents": "id long, opportunity_id long, type string, file_path string, file_name string, file_size_kb int, uploaded_at timestamp, notes string",
    "sql_practice_sessions": "id long, practice_date date, platform string, database_used string, question_text string, my_query string, correct_query string, is_correct boolean, time_spent_minutes int, difficulty string, error_made string, lesson_learned string, keywords_used string, notes string, created_at timestamp, related_question_id long",
    "sacred_work_log": "id long, date date, stone_number int, stone_title string, time_spent_minutes int, what_built string, insights string, next_stone string, felt_sense string, created_at timestamp, updated_at timestamp",
    "scraped_jobs": "id long, external_id string, source string, job_title string, company string, job_url string, location string, description string, tags string, salary_range string, posted_date string, match_score double, classification string, matched_skills array<struct<skill:string,weight:int>>, matched_domains array<struct<domain:string,weight:int>>, red_flags array<struct<flag:string,penalty:int>>, recommendation string, scraped_at timestamp, imported_to_opportunities boolean",
    "parliament_decisions": "id long, decision_id string, timestamp string, query string, job_id long, agents_active array<string>, decision_text string, sparsity double, confidence double, dharmic_alignment double, integration_used int, applied int, callback int, interview int, offer int, outcome_notes string, outcome_date string",
    "interview_questions": "id long, opportunity_id long, question_text string, question_type string, difficulty string, my_response string, ideal_response string, my_rating int, tags string, created_at timestamp",
    "job_sources": "id long, source_name string, is_default boolean, created_at timestamp",
    "study_topics": "id long, name string, category string, priority int, mastery_level double, progress_percentage double, total_study_hours double, estimated_hours double, deadline date",
}

# fixed values: what a column may hold; null passes
ARCHIVED = ("Rejected", "Declined", "Ghosted", "Accepted")
DOMAINS = {
    ("opportunities", "status"): ("Lead", "Applied", "Screening", "Technical", "Manager", "Assignment", "Offer", "Negotiation", "Accepted", "Rejected", "Declined", "Ghosted"),
    ("opportunities", "priority"): ("High", "Medium", "Low"),
    ("opportunities", "domain_match"): ("Perfect", "Good", "Moderate", "Poor"),
    ("interactions", "type"): ("Call", "Email", "Interview", "Assessment", "Offer Discussion", "Follow-up", "Rejection"),
    ("interactions", "sentiment"): ("Positive", "Neutral", "Negative", "Unknown"),
    ("documents", "type"): ("Resume", "Cover Letter", "Assignment", "Assessment", "Offer Letter", "Contract", "Other"),
    ("sql_practice_sessions", "platform"): ("sql-practice.com", "programiz", "dbeaver", "other"),
    ("sql_practice_sessions", "database_used"): ("Hospital", "Northwind", "Custom", "None"),
    ("sql_practice_sessions", "difficulty"): ("Easy", "Medium", "Hard"),
    ("scraped_jobs", "classification"): ("EXCELLENT", "HIGH_FIT", "MEDIUM_FIT", "LOW_FIT", "NO_FIT"),
}
UNIQUE = {"interactions": "calendar_event_id", "sacred_work_log": "stone_number", "scraped_jobs": "external_id", "parliament_decisions": "decision_id", "job_sources": "source_name"}
DEFAULTS = {
    "opportunities": {"source": "Other", "is_remote": False, "domain_match": "Good", "status": "Lead", "priority": "Medium"},
    "interactions": {"sentiment": "Unknown", "requires_followup": False},
    "sql_practice_sessions": {"is_correct": False, "difficulty": "Medium"},
    "scraped_jobs": {"source": "RemoteOK", "imported_to_opportunities": False},
    "interview_questions": {"difficulty": "Medium", "my_rating": 3},
    "job_sources": {"is_default": False},
}
SEED_SOURCES = ("LinkedIn", "Naukri", "Direct", "Referral", "Other")  # fixed values


@dataclass
class Tables:
    opportunities: DataFrame = None
    interactions: DataFrame = None
    documents: DataFrame = None
    sql_practice_sessions: DataFrame = None
    sacred_work_log: DataFrame = None
    scraped_jobs: DataFrame = None
    parliament_decisions: DataFrame = None
    interview_questions: DataFrame = None
    job_sources: DataFrame = None
    study_topics: DataFrame = None

    def present(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def register(self, spark: SparkSession) -> None:
        for name, df in self.present().items():
            df.createOrReplaceTempView(name)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def migrate(df: DataFrame, table: str) -> DataFrame:
    """The rows under the table's present schema: columns that are missing come as null."""
    schema = empty(df.sparkSession, table).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def ensure(spark: SparkSession, tables: dict[str, DataFrame], names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables, with an empty one for each name (of the data model) that is missing."""
    return tables | {n: empty(spark, n) for n in names or SCHEMAS if n not in tables}


def catalog(spark: SparkSession, tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """(name, present, rows) of the tables of these names: 0 rows for a missing one."""
    found = None
    for n in names or SCHEMAS:
        one = (tables[n] if n in tables else empty(spark, n)).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), F.lit(n in tables).alias("present"), "rows")
        found = one if found is None else found.unionByName(one)
    return found


def load_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> Tables:
    """Parquet tables below root, with their schemas given: no inference, no scan."""
    return Tables(**{n: spark.read.schema(SCHEMAS[n]).parquet(f"{root}/{n}") for n in names or SCHEMAS})


def validate(name: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows within all value domains, rows outside with what is wrong)."""
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(c)) for (t, c), values in DOMAINS.items() if t == name and c in df.columns]
    x = df.withColumn("_wrong", F.array_join(F.array_compact(F.array(*wrong)), ", ") if wrong else F.lit(""))
    return x.where("_wrong = ''").drop("_wrong"), x.where("_wrong <> ''").withColumnRenamed("_wrong", "rejected_for")


def normalize_sessions(df: DataFrame) -> DataFrame:
    """Platform lower-cased and trimmed, difficulty and database with capitals, ready for validate()."""
    return df.withColumns({"platform": F.lower(F.trim("platform")), "difficulty": F.initcap(F.trim("difficulty")), "database_used": F.initcap(F.trim("database_used"))})
