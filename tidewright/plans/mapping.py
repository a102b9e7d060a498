"""The domain tables over the driver's tables, as frames and as the SQL of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = ("Lead", "Applied", "Screening", "Technical", "Manager", "Assignment", "Offer", "Negotiation", "Accepted", "Rejected", "Declined", "Ghosted")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opportunities(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return o.join(c, "o_custkey").selectExpr(
        "o_orderkey as id", "c_name as company", "o_orderpriority as role", "c_mktsegment as source", "o_custkey % 3 = 0 as is_remote",
        f"case when o_orderkey % 97 <> 0 then element_at(array({', '.join(map(repr, STATUS))}), cast(o_orderkey % 12 as int) + 1) end as status",
        "case o_orderkey % 4 when 0 then 'High' when 1 then 'Medium' when 2 then 'Low' end as priority",
        "c_mktsegment as tech_stack", "cast(null as string) as salary_range", "cast(null as string) as recruiter_name", "cast(null as string) as recruiter_phone", "cast(null as string) as notes",
        "cast(o_orderdate as date) as discovered_date", "cast(null as date) as last_interaction_date", "o_orderdate as created_at", "o_orderdate as updated_at",
    )


OPPORTUNITIES = f"""opportunities AS (
  SELECT o_orderkey AS id, c_name AS company, o_orderpriority AS role, c_mktsegment AS source, o_custkey % 3 = 0 AS is_remote,
         CASE WHEN o_orderkey % 97 <> 0 THEN [{', '.join(map(repr, STATUS))}][o_orderkey % 12 + 1] END AS status,
         CASE o_orderkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS priority,
         c_mktsegment AS tech_stack, CAST(NULL AS VARCHAR) AS salary_range, CAST(NULL AS VARCHAR) AS recruiter_name, CAST(NULL AS VARCHAR) AS recruiter_phone, CAST(NULL AS VARCHAR) AS notes,
         CAST(o_orderdate AS DATE) AS discovered_date, CAST(NULL AS DATE) AS last_interaction_date, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def interactions(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "l_orderkey as opportunity_id", "case l_returnflag when 'A' then 'Interview' when 'N' then 'Call' else 'Email' end as type",
        "cast(l_shipdate as date) as date", "case when l_linenumber % 5 <> 0 then concat('0', cast(l_linenumber as string), ':30') end as time",
        "cast(null as string) as meet_link", "cast(null as string) as participants", "l_linestatus as summary",
    )


INTERACTIONS = """interactions AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS opportunity_id, CASE l_returnflag WHEN 'A' THEN 'Interview' WHEN 'N' THEN 'Call' ELSE 'Email' END AS type,
         CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 5 <> 0 THEN '0' || CAST(l_linenumber AS VARCHAR) || ':30' END AS time,
         CAST(NULL AS VARCHAR) AS meet_link, CAST(NULL AS VARCHAR) AS participants, l_linestatus AS summary
  FROM lineitem)"""

_KEYWORDS = "CASE event_id % 6 WHEN 0 THEN 'SELECT, JOIN' WHEN 1 THEN 'JOIN,GROUP BY,' WHEN 2 THEN 'WINDOW' WHEN 3 THEN '' WHEN 4 THEN ' SQL ,JOIN,JOIN' END"
_LEVEL = "CASE event_id % 4 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Hard' END"
_ERROR = "CASE event_id % 5 WHEN 0 THEN concat('error ', CAST(event_id % 7 AS {text})) WHEN 1 THEN '' END"
_SESSION = f"""event_id AS id, CAST(ts AS DATE) AS practice_date, event_type AS platform, props AS question_text, CASE WHEN event_id % 17 <> 0 THEN event_id % 3 <> 0 END AS is_correct,
  CASE WHEN event_id % 19 <> 0 THEN CAST(floor(value) AS INT) END AS time_spent_minutes, {_LEVEL} AS difficulty, {_ERROR} AS error_made, {_KEYWORDS} AS keywords_used, ts AS created_at"""


def sessions(spark, sf_dir) -> DataFrame:
    _read(spark, sf_dir, "events").createOrReplaceTempView("_events")
    return spark.sql(f"SELECT {_SESSION.format(text='STRING')} FROM _events")


SESSIONS = f"sessions AS (SELECT {_SESSION.format(text='VARCHAR')} FROM events)"

_WORK = """event_id AS id, CAST(ts AS DATE) AS date, CAST(event_id AS INT) AS stone_number, event_type AS stone_title, CAST(floor(value) AS INT) AS time_spent_minutes, props AS what_built,
  CAST(NULL AS {text}) AS insights, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'next' END AS next_stone, CAST(NULL AS {text}) AS felt_sense, ts AS created_at"""


def work_log(spark, sf_dir) -> DataFrame:
    _read(spark, sf_dir, "events").createOrReplaceTempView("_events")
    return spark.sql(f"SELECT {_WORK.format(text='STRING')} FROM _events")


WORK = f"work AS (SELECT {_WORK.format(text='VARCHAR')} FROM events)"


def questions(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn as id", "conv_id + 1 as opportunity_id", "text as question_text", "case role when 'user' then 'Technical SQL' when 'assistant' then 'Data Warehouse' end as question_type",
        "case turn % 3 when 0 then 'Easy' when 1 then 'Hard' end as difficulty", "cast((conv_id + turn) % 5 + 1 as int) as my_rating", "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int), 0) as created_at",
    )


QUESTIONS = """questions AS (
  SELECT conv_id * 1000 + turn AS id, conv_id + 1 AS opportunity_id, text AS question_text, CASE role WHEN 'user' THEN 'Technical SQL' WHEN 'assistant' THEN 'Data Warehouse' END AS question_type,
         CASE turn % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Hard' END AS difficulty, CAST((conv_id + turn) % 5 + 1 AS INT) AS my_rating, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 10 + turn) AS created_at
  FROM conversations)"""


def job_sources(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id", "n_name as source_name", "n_regionkey = 1 as is_default")


SOURCES = "job_sources AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS source_name, n_regionkey = 1 AS is_default FROM nation)"

_SCORE = "CASE WHEN doc_id % 50 <> 7 THEN CAST(doc_id * 37 % 1001 AS DOUBLE) / CAST(10 AS DOUBLE) END"
_BAND = f"CASE WHEN {_SCORE} >= 85 THEN 'EXCELLENT' WHEN {_SCORE} >= 75 THEN 'HIGH_FIT' WHEN {_SCORE} >= 65 THEN 'MEDIUM_FIT' WHEN {_SCORE} >= 40 THEN 'LOW_FIT' ELSE 'NO_FIT' END"
_JOB = f"""doc_id AS id, CAST(doc_id AS {{text}}) AS external_id, source, substr(text, 1, 30) AS job_title, lang AS company, concat('https://example.org/', CAST(doc_id AS {{text}})) AS job_url,
  CASE doc_id % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid - Lyon' WHEN 2 THEN 'Bangalore' END AS location, text AS description, source AS tags, {_SCORE} AS match_score, {_BAND} AS classification,
  CASE doc_id % 5 WHEN 0 THEN '[{{{{"skill": "SQL", "weight": 10}}}}]' WHEN 1 THEN '' WHEN 2 THEN '[]' END AS matched_skills, doc_id % 9 = 0 AS imported_to_opportunities"""


def jobs(spark, sf_dir) -> DataFrame:
    _read(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql(f"SELECT {_JOB.format(text='STRING')}, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0) AS scraped_at FROM _documents")


JOBS = f"jobs AS (SELECT {_JOB.format(text='VARCHAR')}, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS scraped_at FROM documents)"
