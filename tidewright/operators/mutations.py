"""Mutations: each gives a new frame for its table; publish them together with sources.snapshots.

One writer is assumed. Errors carry the status that a caller of an HTTP service would see.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import contact
from tidewright.sources.tables import DEFAULTS, SCHEMAS, UNIQUE, migrate  # noqa: F401  a mutation, too

UPDATABLE = ("status", "is_remote", "notes", "priority")


class MutationError(ValueError):
    status = 500


class Invalid(MutationError):
    status = 400


class NotFound(MutationError):
    status = 404


class Conflict(MutationError):
    status = 409


@dataclass
class Result:
    tables: dict[str, DataFrame]
    payload: dict = field(default_factory=dict)


def _append(table: str, df: DataFrame, record: dict, now, columns: dict | None = None) -> tuple[DataFrame, int]:
    """The table and one record with defaults and the next id. ``columns``: such as are computed."""
    key = UNIQUE.get(table)
    value = record.get(key) if key else None
    if value is not None and not df.where(F.col(key) == F.lit(value)).limit(1).isEmpty():
        raise Conflict(f"{key} {value!r} exists")
    new_id = (df.agg(F.max("id").alias("m")).first()["m"] or 0) + 1
    spark = df.sparkSession
    schema = spark.createDataFrame([], SCHEMAS[table]).schema
    row = {**DEFAULTS.get(table, {}), **{k: v for k, v in record.items() if v is not None}, "id": new_id}
    for c in ("created_at", "updated_at"):
        if c in schema.names:
            row.setdefault(c, now)
    one = spark.createDataFrame([tuple(row.get(c) for c in schema.names)], schema).withColumns(columns or {})
    return df.unionByName(one.select(*df.columns), allowMissingColumns=True), new_id


def add_opportunity(opportunities: DataFrame, record: dict, now) -> Result:
    """Company and role are needed; the contact goes to email where it holds an @, else to phone."""
    record = dict(record)
    if not record.get("company") or not record.get("role"):
        raise Invalid("company and role are required")
    email, phone = contact(F.lit(record.pop("recruiter_contact", None)).cast("string"))
    record |= {"is_remote": bool(record.get("is_remote", False)), "discovered_date": record.get("discovered_date", now.date())}
    df, new_id = _append("opportunities", opportunities, record, now, {"recruiter_email": email, "recruiter_phone": phone})
    return Result({"opportunities": df}, {"success": True, "id": new_id})


def add_question(questions: DataFrame, record: dict, now) -> Result:
    df, new_id = _append("interview_questions", questions, record, now)
    return Result({"interview_questions": df}, {"success": True, "id": new_id})


def add_work(log: DataFrame, record: dict, now) -> Result:
    """Zero and empty text count as missing."""
    for c in ("stone_number", "stone_title", "time_spent_minutes", "what_built"):
        if not record.get(c):
            raise Invalid(f"{c} is required")
    try:
        record = record | {c: int(record[c]) for c in ("stone_number", "time_spent_minutes")}
    except (TypeError, ValueError) as e:
        raise Invalid(str(e)) from e
    df, new_id = _append("sacred_work_log", log, {"date": now.date()} | record, now)
    return Result({"sacred_work_log": df}, {"success": True, "id": new_id})


def add_source(job_sources: DataFrame, record: dict, now) -> Result:
    name = (record.get("source_name") or "").strip()
    if not name:
        raise Invalid("source_name is required")
    df, new_id = _append("job_sources", job_sources, {"source_name": name}, now)
    return Result({"job_sources": df}, {"success": True, "id": new_id, "source_name": name})


def add_session(sessions: DataFrame, record: dict, now) -> Result:
    df, new_id = _append("sql_practice_sessions", sessions, {"practice_date": now.date()} | record, now)
    return Result({"sql_practice_sessions": df}, {"id": new_id})


def update_opportunity(opportunities: DataFrame, key: int, changes: dict, now) -> Result:
    """Sets the columns that may change; others in ``changes`` are ignored but named in the answer."""
    wanted = {c: changes[c] for c in UPDATABLE if c in changes}
    if not wanted:
        raise Invalid("nothing to update")
    if opportunities.where(F.col("id") == key).limit(1).isEmpty():
        raise NotFound(f"no opportunity {key}")
    types = dict(opportunities.dtypes)
    new = {c: F.when(F.col("id") == key, F.lit(bool(v) if c == "is_remote" else v).cast(types[c])).otherwise(F.col(c)) for c, v in (wanted | {"updated_at": now}).items()}
    return Result({"opportunities": opportunities.withColumns(new)}, {"success": True, "id": key, "updated_fields": list(changes)})


def update_work(log: DataFrame, key: int, changes: dict, now) -> Result:
    """Sets columns of one entry; its time of update is set with them."""
    wanted = {c: v for c, v in changes.items() if c in log.columns and c not in ("id", "created_at", "updated_at")}
    if not wanted:
        raise Invalid("nothing to update")
    if log.where(F.col("id") == key).limit(1).isEmpty():
        raise NotFound(f"no work entry {key}")
    number = wanted.get("stone_number")
    if number is not None and not log.where((F.col("stone_number") == number) & (F.col("id") != key)).limit(1).isEmpty():
        raise Conflict(f"stone_number {number!r} exists")
    types = dict(log.dtypes)
    new = {c: F.when(F.col("id") == key, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in (wanted | {"updated_at": now}).items()}
    return Result({"sacred_work_log": log.withColumns(new)}, {"success": True, "id": key, "updated_fields": list(changes)})


def import_job(opportunities: DataFrame, jobs: DataFrame, key: int, now) -> Result:
    """A posting becomes a lead with its provenance, and is marked: both tables change or neither."""
    job = jobs.where(F.col("id") == key).first()
    if job is None:
        raise NotFound(f"no posting {key}")
    before = opportunities.where(F.col("scraped_job_id") == key).select("id").first()
    if before is not None:
        e = Conflict(f"posting {key} is imported")
        e.existing_id = before["id"]
        raise e
    record = {"company": job["company"], "role": job["job_title"], "job_url": job["job_url"], "source": job["source"], "is_remote": "remote" in (job["location"] or "").lower(), "tech_stack": job["tags"], "salary_range": job["salary_range"], "status": "Lead", "scraped_job_id": key, "discovered_date": now.date()}
    df, new_id = _append("opportunities", opportunities, record, now)
    marked = jobs.withColumn("imported_to_opportunities", F.when(F.col("id") == key, True).otherwise(F.col("imported_to_opportunities")))
    return Result({"opportunities": df, "scraped_jobs": marked}, {"success": True, "opportunity_id": new_id})


def add_interaction(interactions: DataFrame, opportunities: DataFrame, record: dict, now) -> Result:
    """The parent's last interaction date becomes this row's date, even if a later one is known."""
    df, new_id = _append("interactions", interactions, record, now)
    last = F.when(F.col("id") == record.get("opportunity_id"), F.lit(record.get("date")).cast("date")).otherwise(F.col("last_interaction_date"))
    return Result({"interactions": df, "opportunities": opportunities.withColumn("last_interaction_date", last)}, {"id": new_id})


def touch_parents(opportunities: DataFrame, added: DataFrame) -> DataFrame:
    """The same for a batch: the date of the last row (largest id) added for each parent."""
    last = added.groupBy(F.col("opportunity_id").alias("id")).agg(F.max_by("date", F.struct("id", "date")).alias("_d"))
    return opportunities.join(last, "id", "left").withColumn("last_interaction_date", F.coalesce("_d", "last_interaction_date")).drop("_d").select(*opportunities.columns)


def delete_where(df: DataFrame, condition) -> DataFrame:
    """Rows of which the condition is false or unknown stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_opportunities(opportunities: DataFrame, interactions: DataFrame, condition) -> Result:
    """Cascades to the interactions."""
    gone = opportunities.where(condition).select(F.col("id").alias("opportunity_id"))
    return Result({"opportunities": delete_where(opportunities, condition), "interactions": interactions.join(gone, "opportunity_id", "left_anti").select(*interactions.columns)})


