"""Every named query over the driver's tables and the SQL it is held against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewright.functions import columns, scoring
from tidewright.operators import checks, ingest, mutations as mu, queries as q, report, views
from tidewright.plans import mapping as m
from tidewright.plans.rules import RULES
from tidewright.sources import tables

DAY = "1996-06-15"  # today for opportunities and interactions
PRACTICE_DAY = "2024-01-15"  # today for practice sessions
SCRAPE_DAY = "2024-01-01"  # today for postings
NOW = datetime(2024, 5, 6, 7, 8, 9)  # of a mutation
STAMP = f"TIMESTAMP '{NOW}'"
ARCHIVED = "('Rejected', 'Declined', 'Ghosted', 'Accepted')"
ACTIVE = f"status NOT IN {ARCHIVED}"
LISTING = ", ".join(q.LISTING)
RANK = "CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 END"
PCT = "round(CAST(100 AS DOUBLE) * sum(CASE WHEN is_correct THEN 1 ELSE 0 END) / count(*), 1)"
RIGHT = "CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT)"

_made: dict = {}


def _views(name):
    """CTEs for keyword mastery and weekly summary."""
    return {
        "mastery": f"""mastery AS (
  SELECT keyword, count(*) AS practice_count, {RIGHT} AS correct_count, {PCT} AS accuracy_percentage,
    round(avg(CAST(time_spent_minutes AS DOUBLE)), 1) AS avg_time_minutes
  FROM (SELECT *, trim(unnest(string_split(keywords_used, ','))) AS keyword FROM sessions WHERE keywords_used IS NOT NULL) WHERE keyword <> '' GROUP BY keyword)""",
        "weekly": f"""weekly AS (
  SELECT strftime(practice_date, '%Y-W%W') AS week, count(*) AS total_sessions, count(DISTINCT platform) AS platforms_used,
    {RIGHT} AS correct_answers, {PCT} AS accuracy_percentage,
         CAST(sum(time_spent_minutes) AS BIGINT) AS total_minutes, count(CASE WHEN difficulty = 'Easy' THEN 1 END) AS easy_questions,
           count(CASE WHEN difficulty = 'Medium' THEN 1 END) AS medium_questions,
         count(CASE WHEN difficulty = 'Hard' THEN 1 END) AS hard_questions
  FROM sessions GROUP BY 1)""",
        "mistakes": """mistakes AS (
  SELECT error_made, count(*) AS occurrence_count, CASE WHEN string_agg(DISTINCT keywords_used,
    ',' ORDER BY keywords_used) <> '' THEN string_agg(DISTINCT keywords_used, ',' ORDER BY keywords_used) END AS related_keywords,
         round(avg(CAST(time_spent_minutes AS DOUBLE)), 1) AS avg_recovery_time
  FROM sessions WHERE error_made IS NOT NULL AND error_made <> '' GROUP BY error_made ORDER BY occurrence_count DESC, error_made LIMIT 10)""",
        "levels": f"""levels AS (
  SELECT difficulty, count(*) AS total_attempted, {RIGHT} AS correct, {PCT} AS accuracy_percentage,
    avg(CAST(time_spent_minutes AS DOUBLE)) AS avg_time_minutes, min(practice_date) AS first_attempt, max(practice_date) AS latest_attempt
  FROM sessions GROUP BY difficulty)""",
    }[name]


def _word(term: str) -> str:
    """Unicode word boundaries for an engine without them."""
    return f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){term.lower()}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"


def _sum(terms: dict, test=_word) -> str:
    return " + ".join(f"CASE WHEN {test(t)} THEN {w} ELSE 0 END" for t, w in terms.items())


def _domain(name: str) -> str:
    parts = [p.strip() for p in name.lower().replace(",", "/").split("/")]
    return "(" + " OR ".join(["FALSE", *[_word(p) for p in parts if len(p) > 2]]) + ")"


def _listed(terms: dict, test=_word) -> str:
    """Names of what matches, heaviest first, ties in order, as one text."""
    order = sorted(terms.items(), key=lambda x: -x[1])
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test(t)} THEN '{t}' END" for t, _ in order) + "], lambda x: x IS NOT NULL)"


SCORED = rf"""texts AS (
  SELECT id, job_title, description, tags, company, location, trim(regexp_replace(lower(concat_ws(' ', coalesce(job_title, ''), coalesce(description,
    ''), coalesce(tags, ''), coalesce(company, ''))), '\s+', ' ', 'g')) AS t
  FROM jobs
), parts AS (
  SELECT id, t, least(CAST(100 AS DOUBLE), CAST({_sum(RULES.skills)} AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(100 AS DOUBLE)) AS s,
         least(CAST(100 AS DOUBLE), CAST({_sum(RULES.domains, _domain)} AS DOUBLE) / CAST(50 AS DOUBLE) * CAST(100 AS DOUBLE)) AS d,
         CAST(greatest(-50, {_sum(RULES.flags)}) AS DOUBLE) AS f,
         CAST(CASE WHEN coalesce(location, '') = '' THEN 50 WHEN lower(location) LIKE '%remote%' THEN 100
    WHEN lower(location) LIKE '%hybrid%' THEN 50 WHEN lower(location) LIKE '%bangalore%' THEN 30 ELSE 0 END AS DOUBLE) AS l

  FROM texts
), scored AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE),
    s * CAST(0.4 AS DOUBLE) + CAST(100 AS DOUBLE) * CAST(0.2 AS DOUBLE) + d * CAST(0.2 AS DOUBLE) + l * CAST(0.1 AS DOUBLE) + f * CAST(0.1 AS DOUBLE))) AS total
  FROM parts
)"""


def _scored(jobs):
    x = jobs.select("id", "job_title", "description", "tags", "company", "location")
    return scoring.score(x, RULES, title="job_title", experience="none")


def _text(jobs):
    return jobs.select("id", columns.normalized(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("job_title", "description", "tags", "company")])).alias("t"), "location")


def _names(column: str, name: str):
    return F.array_join(F.transform(column, lambda x: x[name]), "|")


KEYWORD_TEST = " OR ".join(f"contains(p, '{k}')" for k in ingest.KEYWORDS)
STATS = """count(*) AS total_jobs, count(CASE WHEN match_score >= 85 THEN 1 END) AS excellent, count(CASE WHEN match_score >= 75 AND match_score < 85 THEN 1 END) AS high_fit,
  count(CASE WHEN match_score >= 65 AND match_score < 75 THEN 1 END) AS medium_fit, count(CASE WHEN match_score >= 40
    AND match_score < 65 THEN 1 END) AS low_fit, count(CASE WHEN match_score < 40 THEN 1 END) AS no_fit,
  round(avg(match_score), 1) AS avg_score, max(scraped_at) AS last_scraped, count(CASE WHEN imported_to_opportunities THEN 1 END) AS imported_count"""
PERCENT = "CAST(CAST(trunc(match_score) AS INTEGER) AS VARCHAR) || '%'"
WEEK_BEFORE = f"practice_date >= DATE '{PRACTICE_DAY}' - 7"
AGENDA = "i.id, i.type, i.date, i.time, i.meet_link, o.company, o.role, o.status, i.participants, i.summary FROM interactions i JOIN opportunities o ON i.opportunity_id = o.id"
WORK_STATS = """count(*) AS total_stones, CAST(sum(time_spent_minutes) AS BIGINT) AS total_minutes, round(avg(CAST(time_spent_minutes AS DOUBLE)),
    1) AS avg_minutes_per_stone, min(date) AS first_stone_date, max(date) AS latest_stone_date,
    round(sum(time_spent_minutes) / CAST(60 AS DOUBLE), 1) AS total_hours FROM work"""
GAPS = """SELECT coalesce(question_type, 'General') AS question_type, difficulty, count(*) AS question_count, avg(CAST(my_rating AS DOUBLE)) AS avg_performance,
    min(my_rating) AS min_rating, round(CAST(100 AS DOUBLE) * sum(CASE WHEN my_rating <= 2 THEN 1 ELSE 0 END) / count(*), 1) AS weak_percentage
  FROM questions
  GROUP BY 1, 2
  HAVING avg(CAST(my_rating AS DOUBLE)) < 4"""


def _add(name: str, frame, tables: str, sql: str, *ctes: str) -> None:
    """``tables``: letters of the mapped tables that ``frame`` takes, in order."""
    parts = {
        "o": (m.opportunities, m.OPPORTUNITIES), "i": (m.interactions, m.INTERACTIONS), "s": (m.sessions, m.SESSIONS), "w": (m.work_log, m.WORK),
        "q": (m.questions, m.QUESTIONS), "n": (m.job_sources, m.SOURCES), "j": (m.jobs, m.JOBS),
    }

    def run(spark, sf_dir):
        return frame(*[parts[t][0](spark, sf_dir) for t in tables])

    _made[name] = (run, "WITH " + ",\n".join([parts[t][1] for t in tables] + list(ctes)) + "\n" + sql)


_add(
    "q1_metrics",
    lambda o, i: q.metrics(o, i, DAY),
    "oi",
    f"""SELECT (SELECT count(*)
  FROM opportunities
  WHERE {ACTIVE}) AS active_count,
  (SELECT count(*)
  FROM interactions
  WHERE type = 'Interview' AND date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 7) AS interview_count,
  (SELECT count(*)
  FROM opportunities
  WHERE is_remote AND {ACTIVE}) AS remote_count, (SELECT count(*)
  FROM opportunities
  WHERE priority = 'High' AND {ACTIVE}) AS priority_count""",
)
_add(
    "q2_agenda",
    lambda i, o: q.week_agenda(i, o, DAY),
    "io",
    f"SELECT {AGENDA} WHERE i.type = 'Interview' AND i.date BETWEEN DATE '{DAY}' AND DATE '{DAY}' + 7",
)
_add("q3_pipeline", q.pipeline, "o", f"SELECT {LISTING} FROM opportunities WHERE {ACTIVE} ORDER BY {RANK} NULLS FIRST, updated_at DESC, id LIMIT 50")
_add("q4_archived", q.archived, "o", f"SELECT {LISTING} FROM opportunities WHERE status IN {ARCHIVED} ORDER BY updated_at DESC, id LIMIT 50")
_add("q5_learning_gaps", views.learning_gaps, "q", GAPS)
_add(
    "q6_study_priority",
    lambda w: views.study_priority(
            w.select("id", F.col("stone_title").alias("name"), (F.col("id") % 5).cast("int").alias("priority"), ((F.col("id") % 11) / F.lit(2.0)).alias("mastery_level")),
        ),
    "w",
    """SELECT id, stone_title AS name, CAST(id % 5 AS INTEGER) AS priority, (id % 11) / CAST(2 AS DOUBLE) AS mastery_level,
    CAST(id % 5 AS INTEGER) * (CAST(5 AS DOUBLE) - (id % 11) / CAST(2 AS DOUBLE)) AS priority_score
  FROM work""",
)
_add(
    "q7_recent_questions",
    q.recent_questions,
    "qo",
    """SELECT n.*, o.company
  FROM (SELECT *
  FROM questions
  ORDER BY created_at DESC, id LIMIT 20) n
  LEFT JOIN opportunities o ON n.opportunity_id = o.id""",
)
_add(
    "q8_practice_stats",
    q.practice_stats,
    "s",
    f"""SELECT count(*) AS total_sessions, {RIGHT} AS correct_count, {PCT} AS accuracy_percentage, CAST(sum(time_spent_minutes) AS BIGINT) AS total_minutes,
    count(DISTINCT platform) AS platforms_used, count(CASE WHEN difficulty = 'Easy' THEN 1 END) AS easy_count, count(CASE
    WHEN difficulty = 'Medium' THEN 1 END) AS medium_count, count(CASE WHEN difficulty = 'Hard' THEN 1 END) AS hard_count
  FROM sessions""",
)
_add("q9_keyword_mastery", views.keyword_mastery, "s", "SELECT * FROM mastery", _views("mastery"))
_add("q10_recent_practice", q.recent_practice, "s", "SELECT * FROM sessions ORDER BY created_at DESC, id DESC LIMIT 10")
_add("q11_weekly_summary", q.recent_weeks, "s", "SELECT * FROM weekly ORDER BY week DESC LIMIT 8", _views("weekly"))
_add("q12_common_mistakes", views.common_mistakes, "s", "SELECT * FROM mistakes", _views("mistakes"))
_add("q13_work_stats", q.work_stats, "w", f"SELECT {WORK_STATS}")
_add(
    "q13_work_stats_empty",
    lambda w: q.work_stats(w.where("id < 0")),
    "w",
    f"""SELECT total_stones, coalesce(total_minutes, 0) AS total_minutes, coalesce(avg_minutes_per_stone, CAST(0 AS DOUBLE)) AS avg_minutes_per_stone,
    first_stone_date, latest_stone_date, coalesce(total_hours, CAST(0 AS DOUBLE)) AS total_hours
  FROM (SELECT {WORK_STATS}
  WHERE id < 0)""",
)
_add(
    "q14_work_progress",
    views.work_progress,
    "w",
    """SELECT *, CASE WHEN next_stone IS NOT NULL AND next_stone <> '' THEN 'Complete' ELSE 'In Progress' END AS status
  FROM work""",
)
_add("q15_recent_work", q.recent_work, "w", "SELECT * FROM work ORDER BY date DESC, created_at DESC, id DESC LIMIT 5")
_add("q16_sources", q.sources, "n", "SELECT * FROM job_sources")
_LISTED = (
    ("q17_scraped_jobs", {}, "match_score >= 70"),
    ("q17_scraped_jobs_low", {"min_score": 60, "limit": 10}, "match_score >= 60"),
    ("q17_scraped_jobs_class", {"classification": "LOW_FIT", "min_score": 0, "limit": 5}, "match_score >= 0 AND classification = 'LOW_FIT'"),
    ("q17_scraped_jobs_band", {"classification": "HIGH_FIT", "limit": 20}, "match_score >= 70 AND classification = 'HIGH_FIT'"),
    ("q17_scraped_jobs_source", {"source": "src0", "min_score": 50, "limit": 3}, "match_score >= 50 AND source = 'src0'"),
)
for _name, _filters, _where in _LISTED:
    _add(_name, lambda j, _f=_filters: q.scraped_jobs(j, **_f).withColumn("matched_skills", _names("matched_skills", "skill")), "j",
         f"""SELECT id, external_id, source, job_title, company, job_url, location, tags, classification, imported_to_opportunities, scraped_at, round(match_score, 1) AS match_score,
  CASE WHEN length(description) > 200 THEN substr(description, 1, 200) || '...' ELSE description END AS description, CASE
    WHEN matched_skills LIKE '%SQL%' THEN 'SQL' ELSE '' END AS matched_skills
  FROM jobs WHERE {_where} ORDER BY jobs.match_score DESC, scraped_at DESC, id LIMIT {_filters.get('limit', 50)}""")
_add("q18_scraped_stats", q.scraped_stats, "j", f"SELECT {STATS} FROM jobs")
_add(
    "q19_source_breakdown",
    q.source_breakdown,
    "j",
    "SELECT source, count(*) AS count, round(avg(match_score), 1) AS avg_score FROM jobs GROUP BY source",
)
_add(
    "q20_import_lookup",
    lambda j: q.point(j, "id", 11).select("id", "company", "imported_to_opportunities"),
    "j",
    "SELECT id, company, imported_to_opportunities FROM jobs WHERE id = 11",
)
_add(
    "q21_recent_sessions",
    q.recent_sessions,
    "s",
    """SELECT practice_date, platform, difficulty, is_correct, time_spent_minutes, keywords_used
  FROM sessions
  ORDER BY created_at DESC, id DESC LIMIT 5""",
)
_add("q22_summary_buckets", lambda j: q.summary(j)[0], "j", f"SELECT {STATS} FROM jobs")
_add(
    "q22_summary_top",
    lambda j: q.summary(j)[1],
    "j",
    f"""SELECT id, job_title, company, {PERCENT} AS score, classification
  FROM jobs
  ORDER BY match_score DESC NULLS LAST, id LIMIT 5""",
)
_add(
    "q23_top_scores",
    q.top_scores,
    "j",
    f"""SELECT id, job_title, company, {PERCENT} AS score, classification
  FROM jobs
  ORDER BY match_score DESC NULLS LAST, id LIMIT 10""",
)
_add(
    "q24_class_summary",
    q.class_summary,
    "j",
    """SELECT classification, count(*) AS count, CAST(CAST(trunc(avg(match_score)) AS INTEGER) AS VARCHAR) || '%' AS avg_score
  FROM jobs
  GROUP BY classification""",
)
_add(
    "q25_category_counts",
    q.category_counts,
    "on",
    f"""SELECT 'Total' AS category, count(*) AS count
  FROM opportunities
  UNION ALL SELECT 'Active', count(*)
  FROM opportunities
  WHERE {ACTIVE}
  UNION ALL SELECT 'Archived', count(*)
  FROM opportunities
  WHERE status IN {ARCHIVED}
  UNION ALL SELECT 'Sources', count(*)
  FROM job_sources""",
)
_add(
    "q26_table_counts",
    lambda o, i, s: q.table_counts({"opportunities": o, "interactions": i, "sessions": s}),
    "ois",
    """SELECT 'opportunities' AS \"table\", count(*) AS rows
  FROM opportunities
  UNION ALL SELECT 'interactions', count(*)
  FROM interactions
  UNION ALL SELECT 'sessions', count(*)
  FROM sessions""",
)
_add("q27_status_counts", q.status_counts, "o", "SELECT status, count(*) AS count FROM opportunities GROUP BY status")
_add(
    "q28_latest_questions",
    q.latest_questions,
    "q",
    """SELECT id, substr(question_text, 1, 50) || '...' AS question, question_type
  FROM questions
  ORDER BY created_at DESC, id LIMIT 3""",
)
_add(
    "q29_with_skill",
    lambda j: q.with_skill(j, "SQL"),
    "j",
    """SELECT id, job_title, company, match_score
  FROM jobs
  WHERE matched_skills LIKE '%\"SQL\"%'
  ORDER BY match_score DESC NULLS LAST, id LIMIT 10""",
)
_add(
    "q30_at_location",
    lambda j: q.at_location(j, "remote"),
    "j",
    "SELECT id, job_title, company, location, match_score FROM jobs WHERE location ILIKE '%remote%' AND match_score >= 60",
)
_add(
    "q31_titled_or_tagged",
    lambda j: q.titled_or_tagged(j, "SRC1"),
    "j",
    """SELECT id, job_title, tags, match_score
  FROM jobs
  WHERE (job_title ILIKE '%SRC1%' OR tags ILIKE '%SRC1%') AND match_score >= 50""",
)
_add(
    "q32_scraped_on",
    lambda j: q.scraped_on(j, SCRAPE_DAY).select("id", "scraped_at"),
    "j",
    f"SELECT id, scraped_at FROM jobs WHERE CAST(scraped_at AS DATE) = DATE '{SCRAPE_DAY}'",
)
_add(
    "q33_scored_listing",
    q.scored_listing,
    "j",
    f"""SELECT id, job_title || ' - ' || company AS posting, {PERCENT} AS score
  FROM jobs
  WHERE match_score >= 60
  ORDER BY match_score DESC, id LIMIT 50""",
)
_add(
    "q34_class_ranges",
    q.class_ranges,
    "j",
    """SELECT classification, min(match_score) AS min_score, max(match_score) AS max_score, count(*) AS count
  FROM jobs
  GROUP BY classification""",
)
_add(
    "q35_of_companies",
    lambda o: q.of_companies(o, ["Customer#000000001", "Customer#000000007", "customer_1", "Customer#1"]),
    "o",
    """SELECT id, company, role, status, priority
  FROM opportunities
  WHERE company IN ('Customer#000000001', 'Customer#000000007', 'customer_1', 'Customer#1')""",
)
_add("q36_max_id", q.max_id, "o", "SELECT max(id) AS max_id FROM opportunities")
_add(
    "q37_score_threshold",
    lambda j: q.top_scores(j, 50, 75),
    "j",
    f"""SELECT id, job_title, company, {PERCENT} AS score, classification
  FROM jobs
  WHERE match_score >= 75
  ORDER BY match_score DESC, id LIMIT 50""",
)
_add("q38_class_counts", q.class_counts, "j", "SELECT classification, count(*) AS count FROM jobs GROUP BY classification")
_add(
    "q39_high_fit_on",
    lambda j: q.high_fit_on(j, SCRAPE_DAY),
    "j",
    f"""SELECT count(*) AS high_fit
  FROM jobs
  WHERE classification IN ('EXCELLENT', 'HIGH_FIT') AND CAST(scraped_at AS DATE) = DATE '{SCRAPE_DAY}'""",
)
_add("q40_listing", q.listing, "o", "SELECT company, role, status FROM opportunities")

_add(
    "v1_active_pipeline",
    views.active_pipeline,
    "oi",
    f"""SELECT {', '.join('o.' + c for c in views.PIPELINE)}, count(i.id) AS interaction_count, max(i.date) AS latest_interaction, o.updated_at
  FROM opportunities o
  LEFT JOIN interactions i ON o.id = i.opportunity_id
  WHERE {ACTIVE}
  GROUP BY {', '.join('o.' + c for c in views.PIPELINE)}, o.updated_at""",
)
_add("v2_todays_agenda", lambda i, o: views.todays_agenda(i, o, DAY), "io", f"SELECT {AGENDA} WHERE i.date = DATE '{DAY}'")
_add("v3_keyword_mastery", views.keyword_mastery, "s", "SELECT * FROM mastery", _views("mastery"))
_add("v4_weekly_summary", views.weekly_summary, "s", "SELECT * FROM weekly", _views("weekly"))
_add("v5_common_mistakes", views.common_mistakes, "s", "SELECT * FROM mistakes", _views("mistakes"))
_add("v6_progress_by_difficulty", views.progress_by_difficulty, "s", "SELECT * FROM levels", _views("levels"))
_add(
    "v7_work_progress",
    views.work_progress,
    "w",
    """SELECT *, CASE WHEN next_stone IS NOT NULL AND next_stone <> '' THEN 'Complete' ELSE 'In Progress' END AS status
  FROM work""",
)
_add("v8_work_stats", views.work_stats, "w", f"SELECT {WORK_STATS}")
_add("v9_learning_gaps", views.learning_gaps, "q", GAPS)
_add(
    "v10_study_priority",
    lambda w: views.study_priority(
            w.select("id", (F.col("id") % 5).cast("int").alias("priority"), ((F.col("id") % 11) / F.lit(2.0)).alias("mastery_level")),
        ),
    "w",
    """SELECT id, CAST(id % 5 AS INTEGER) AS priority, (id % 11) / CAST(2 AS DOUBLE) AS mastery_level,
    CAST(id % 5 AS INTEGER) * (CAST(5 AS DOUBLE) - (id % 11) / CAST(2 AS DOUBLE)) AS priority_score
  FROM work""",
)
_add("v11_archived_pipeline", views.archived_pipeline, "o", f"SELECT * FROM opportunities WHERE status IN {ARCHIVED}")

_add(
    "r1_last_weeks",
    report.last_weeks,
    "s",
    """SELECT week, total_sessions AS sessions, CAST(accuracy_percentage AS VARCHAR) || '%' AS accuracy, CAST(total_minutes AS VARCHAR) || 'min' AS time,
    easy_questions || 'E / ' || medium_questions || 'M / ' || hard_questions || 'H' AS difficulty
  FROM weekly
  ORDER BY week DESC LIMIT 4""",
    _views("weekly"),
)
_add(
    "r2_mastery",
    report.mastery,
    "s",
    """SELECT keyword, practice_count AS practices, CAST(accuracy_percentage AS VARCHAR) || '%' AS accuracy, CAST(round(avg_time_minutes,
    1) AS VARCHAR) || 'min' AS avg_time
  FROM mastery
  ORDER BY practice_count DESC, accuracy_percentage NULLS FIRST, keyword LIMIT 10""",
    _views("mastery"),
)
_add(
    "r3_mistakes",
    report.mistakes,
    "s",
    """SELECT error_made AS mistake, occurrence_count AS count, CAST(round(avg_recovery_time, 1) AS VARCHAR) || 'min' AS avg_recovery
  FROM mistakes
  ORDER BY occurrence_count DESC, error_made LIMIT 5""",
    _views("mistakes"),
)
_add(
    "r4_levels",
    report.levels,
    "s",
    """SELECT difficulty AS level, total_attempted AS attempted, correct, CAST(accuracy_percentage AS VARCHAR) || '%' AS accuracy,
    CAST(round(avg_time_minutes, 1) AS VARCHAR) || 'min' AS avg_time, latest_attempt AS latest_practice
  FROM levels""",
    _views("levels"),
)
_add(
    "r5_recent",
    lambda s: report.recent(s, PRACTICE_DAY),
    "s",
    f"""SELECT practice_date, platform, difficulty AS level, CASE WHEN is_correct THEN '✅' ELSE '❌' END AS result, substr(question_text, 1,
    60) || '...' AS question, CAST(time_spent_minutes AS VARCHAR) || 'min' AS time
  FROM sessions
  WHERE {WEEK_BEFORE}""",
)
_add(
    "r6_recommended",
    report.recommended,
    "s",
    """SELECT 'Practice: ' || keyword AS recommendation, 'Current Accuracy: ' || CAST(accuracy_percentage AS VARCHAR) || '%' AS reason
  FROM mastery
  WHERE accuracy_percentage < 70 AND practice_count >= 2
  ORDER BY practice_count DESC, keyword LIMIT 5""",
    _views("mastery"),
)
_add(
    "r7_correlation",
    report.correlation,
    "qs",
    """SELECT question_type AS interview_topic, count(DISTINCT id) AS interview_questions, avg(CAST(my_rating AS DOUBLE)) AS interview_rating,
  max((SELECT count(*)
  FROM sessions
  WHERE keywords_used ILIKE '%' || CASE question_type WHEN 'Technical SQL' THEN 'JOIN' WHEN 'Data Warehouse' THEN 'WINDOW'
    ELSE 'SQL' END || '%')) AS practice_sessions

  FROM questions
  WHERE question_type IN ('Technical SQL', 'Data Warehouse')
  GROUP BY question_type""",
)
_add(
    "r8_insight",
    lambda s: report.insight(s, PRACTICE_DAY),
    "s",
    f"""SELECT CASE WHEN total = 0 THEN 'No practice this week - Start with 3 Easy questions' WHEN total < 5 THEN 'Good start! Aim for 5+ sessions per week'
    WHEN accuracy < 0.6 THEN 'Focus on quality over quantity - Review mistakes'
  WHEN accuracy >= 0.8 THEN 'Great accuracy! Try harder questions' ELSE 'Consistent practice - Keep going!' END AS insight,
    total || ' sessions, ' || CAST(round(accuracy * 100, 1) AS VARCHAR) || '% accuracy' AS this_week

  FROM (SELECT avg(CASE WHEN is_correct THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy, count(*) AS total
  FROM sessions
  WHERE {WEEK_BEFORE})""",
)

_add(
    "c2_normalize",
    lambda j: _text(j).select("id", F.md5(F.col("t").cast("binary")).alias("digest")),
    "j",
    "SELECT id, md5(t) AS digest FROM texts",
    SCORED.split("), parts")[0] + ")",
)
_add(
    "c4_skills",
    lambda j: (
        _text(j)
        .select(
                "id", scoring.skills_score(F.col("t"), RULES)[0].alias("score"),
                _names(scoring.skills_score(F.col("t"), RULES)[1], "skill").alias("found"),
            )
    ),
    "j",
    f"SELECT id, s AS score, {_listed(RULES.skills)}, '|') AS found FROM scored",
    SCORED,
)
_add(
    "c5_flags",
    lambda j: _text(j).select("id", scoring.flags_penalty(F.col("t"), RULES)[0].alias("penalty")),
    "j",
    "SELECT id, f AS penalty FROM scored",
    SCORED,
)
_add(
    "c6_domains",
    lambda j: (
        _text(j)
        .select(
                "id", scoring.domain_score(F.col("t"), RULES)[0].alias("score"),
                _names(scoring.domain_score(F.col("t"), RULES)[1], "domain").alias("found"),
            )
    ),
    "j",
    f"SELECT id, d AS score, {_listed(RULES.domains, _domain)}, '|') AS found FROM scored",
    SCORED,
)
_add(
    "c7_location",
    lambda j: _text(j).select("id", scoring.location_score(F.col("location"), RULES).alias("score")),
    "j",
    "SELECT id, l AS score FROM scored",
    SCORED,
)
_add(
    "c8_experience",
    lambda j: j.select(
            "id",
            scoring.experience_score(F.concat((F.col("id") % 12).cast("string"), F.when(F.col("id") % 3 == 0, "+ years").when(F.col("id") % 3 == 1, " years").otherwise("-9 years")), 7).alias("score"),
        ),
    "j",
    """SELECT id, CAST(CASE id % 3 WHEN 0 THEN CASE WHEN 7 >= id % 12 THEN 100 WHEN 7 >= id % 12 - 1 THEN 80 ELSE 50 END WHEN 1 THEN CASE
    WHEN id % 12 = 7 THEN 100 WHEN abs(7 - id % 12) <= 1 THEN 90 WHEN abs(7 - id % 12) <= 2 THEN 70 ELSE 50 END
  ELSE CASE WHEN id % 12 <= 7 THEN 100 WHEN id % 12 - 7 <= 1 THEN 70 ELSE 40 END END AS DOUBLE) AS score
  FROM jobs""",
)
_add(
    "c9_score",
    lambda j: (
        _scored(j)
        .select(
                "id", "final_score", "classification", F.col("breakdown.skills_score").alias("skills_score"),
                F.col("breakdown.red_flag_penalty").alias("penalty"), "should_auto_import",
            )
    ),
    "j",
    """SELECT id, round(total, 2) AS final_score, CASE WHEN total >= 85 THEN 'EXCELLENT' WHEN total >= 75 THEN 'HIGH_FIT' WHEN total >= 65 THEN 'MEDIUM_FIT'
    WHEN total >= 40 THEN 'LOW_FIT' ELSE 'NO_FIT' END AS classification, round(s, 2) AS skills_score, round(f, 2) AS penalty,
    total >= 75 AS should_auto_import
  FROM scored""",
    SCORED,
)
_add(
    "c10_classes",
    lambda j: (
        _scored(j)
        .groupBy("classification")
        .agg(F.count(F.lit(1)).alias("count"), F.max("final_score").alias("best"))
    ),
    "j",
    """SELECT CASE WHEN total >= 85 THEN 'EXCELLENT' WHEN total >= 75 THEN 'HIGH_FIT' WHEN total >= 65 THEN 'MEDIUM_FIT' WHEN total >= 40 THEN 'LOW_FIT'
    ELSE 'NO_FIT' END AS classification, count(*) AS count, round(max(total), 2) AS best
  FROM scored
  GROUP BY 1""",
    SCORED,
)
_add(
    "c12_relevance",
    lambda j: (
        ingest.relevant(j.select("id", F.col("job_title").alias("position"), "description", "tags"))
        .select("id")
    ),
    "j",
    f"""SELECT id
  FROM (SELECT id, lower(concat_ws(' ', coalesce(job_title, ''), coalesce(description, ''), coalesce(tags, ''))) AS p
  FROM jobs)
  WHERE {KEYWORD_TEST}""",
)
_add(
    "c14_mapping",
    lambda j: (
        ingest.map_postings(
            j.select(
                F.when(F.col("id") % 3 > 0, F.col("external_id")).alias("id"), F.lit(None).cast("string").alias("slug"), F.col("job_url").alias("url"),
                F.col("job_title").alias("position"), "company", "description", "location", F.array("tags", "company").alias("tags"),
                (F.col("id") * 1000).alias("salary_min"), (F.col("id") * 2000).alias("salary_max"), F.col("id").alias("n"), F.lit("2024-01-01").alias("date"),
            ),
            "2024-01-01", "n",
        )
        .select("external_id", "location", "tags", "salary_range")
    ),
    "j",
    """SELECT CASE WHEN id % 3 > 0 THEN external_id ELSE 'remoteok_' || id END AS external_id, coalesce(location, 'Remote') AS location,
    tags || ', ' || company AS tags, CASE WHEN id > 0 THEN '$' || format('{:,}', id * 1000) || ' - $' || format('{:,}', id * 2000) END AS salary_range
  FROM jobs""",
)


def _rule_counts() -> str:
    """One row for each rule with the texts that hold it."""
    tests = {"skills": _word, "flags": _word, "domains": _domain}
    rows = [(kind, i, t, w, tests[kind](t)) for kind in tests for i, (t, w) in enumerate(getattr(RULES, kind).items())]
    return "\nUNION ALL ".join(f"SELECT '{kind}' AS kind, {i} AS ordinal, '{t}' AS term, {w} AS weight, count(*) AS jobs FROM texts WHERE {test}" for kind, i, t, w, test in rows)


def _rules_found(j):
    """The rules as a table, each with the number of jobs that it matches."""
    rules = RULES.frame(j.sparkSession)
    hits = scoring.matches(_text(j), rules, "id", "t").groupBy("kind", "ordinal", "term", "weight").agg(F.count(F.lit(1)).alias("jobs"))
    return rules.join(hits, ["kind", "ordinal", "term", "weight"], "left").na.fill(0, ["jobs"])


_add("c1_rules", _rules_found, "j", _rule_counts(), SCORED)
BANDED = """CASE WHEN total >= 85 THEN 'EXCELLENT' WHEN total >= 75 THEN 'HIGH_FIT' WHEN total >= 65 THEN 'MEDIUM_FIT'
    WHEN total >= 40 THEN 'LOW_FIT' ELSE 'NO_FIT' END"""
_HITS = ("CASE WHEN {test} THEN '{term}:{weight}' END", lambda terms, test: [_HITS[0].format(test=test(t), term=t, weight=w) for t, w in terms])


def _weighed(terms: dict, test=_word, most: int | None = None) -> str:
    """name:weight of what matches: the ``most`` heaviest first, ties in order; or all in order."""
    order = sorted(terms.items(), key=lambda x: -x[1]) if most else list(terms.items())
    return f"array_to_string(list_filter([{', '.join(_HITS[1](order, test))}], lambda x: x IS NOT NULL){f'[1:{most}]' if most else ''}, '|')"


def _pairs(column: str, name: str, value: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x[name], x[value].cast("string"))), "|")


_add(
    "c11_output",
    lambda j: (
        _scored(j)
        .select(
                "id", "recommendation", _pairs("matched_skills", "skill", "weight").alias("skills"),
                _pairs("matched_domains", "domain", "weight").alias("domains"),
                _pairs("red_flags", "flag", "penalty").alias("flags"),
                *[F.col(f"breakdown.{c}").alias(c) for c in ("experience_score", "domain_score", "location_score")],
            )
    ),
    "j",
    f"""SELECT id, replace(CASE {BANDED} {' '.join(f"WHEN '{name}' THEN '{text.replace('%%', '%')}'" for name, text in scoring.ADVICE.items())} END, '%.1f',
    printf('%.1f', total)) AS recommendation,
  {_weighed(RULES.skills, most=10)} AS skills, {_weighed(RULES.domains, _domain, most=5)} AS domains, {_weighed(RULES.flags)} AS flags,
    CAST(100 AS DOUBLE) AS experience_score, round(d, 2) AS domain_score, round(l, 2) AS location_score
  FROM scored""",
    SCORED,
)


def _posted(j):
    """Jobs as fetched records; every fifth asks for etl."""
    asked = F.concat("job_title", F.when(F.col("id") % 5 == 1, " etl").otherwise(""))
    return j.select(
        F.when(F.col("id") % 3 > 0, F.col("external_id")).alias("id"), F.concat(F.lit("p"), "external_id").alias("slug"),
        F.when(F.col("location") != "Remote", asked).alias("position"), "company", "description", "location",
        F.array("tags", "company").alias("tags"), (F.col("id") * 100).alias("salary_max"), F.lit(None).cast("string").alias("date"),
    )


_ASKED = "job_title || CASE WHEN id % 5 = 1 THEN ' etl' ELSE '' END"
_add(
    "c13_scheduled",
    lambda j: ingest.map_scheduled(_posted(j), SCRAPE_DAY).drop("scraped_at"),
    "j",
    f"""SELECT CASE WHEN id % 3 > 0 THEN external_id ELSE 'p' || external_id END AS id, {_ASKED} AS title, company,
    '{ingest.JOB_URL}p' || external_id AS url, coalesce(location, 'Remote') AS location, '{SCRAPE_DAY}' AS posted_date,
  substr(description, 1, {ingest.DESCRIPTION}) AS description, tags || ', ' || company AS tags, CASE WHEN id > 0 THEN '$' || id * 100
    ELSE 'Not specified' END AS salary, '{ingest.SOURCE}' AS source, 'new' AS status, CAST(NULL AS DOUBLE) AS match_score, FALSE AS applied
  FROM jobs
  WHERE location <> 'Remote' AND coalesce(job_title, '') <> '' AND coalesce(company, '') <> ''
    AND ({' OR '.join(f"contains(lower(concat_ws(' ', {_ASKED}, description, tags, company)), '{k}')" for k in ingest.SCHEDULED_KEYWORDS)})""",
)
_add(
    "c16_good",
    lambda j: ingest.good_matches(_scored(j), 40).select("id", "final_score"),
    "j",
    "SELECT id, round(total, 2) AS final_score FROM scored WHERE round(total, 2) >= 40",
    SCORED,
)
_add(
    "c16_best",
    lambda j: (
        ingest.best_match(_scored(j).withColumn("title", F.lpad(F.col("id").cast("string"), 12, "0")))
        .select("id", "final_score")
    ),
    "j",
    "SELECT id, round(total, 2) AS final_score FROM scored ORDER BY 2 DESC, id LIMIT 1",
    SCORED,
)
_add(
    "c16_summary",
    lambda j: (
        ingest.batch_summary(_scored(j))
        .select(
                "total", "mean", "best",
                F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "|").alias("classes"),
            )
    ),
    "j",
    f"""SELECT CAST(sum(n) AS BIGINT) AS total, round(sum(s) / sum(n), 2) AS mean, max(b) AS best, string_agg(c || ':' || n, '|'
  ORDER BY c) AS classes
  FROM (SELECT {BANDED} AS c, count(*) AS n, sum(round(total, 2)) AS s, max(round(total, 2)) AS b
  FROM scored
  GROUP BY 1)""",
    SCORED,
)

_OPPORTUNITY = ["id", "company", "role", "source", "is_remote", "status", "priority", "recruiter_email", "recruiter_phone", "discovered_date", "updated_at"]
_OPPORTUNITIES = """SELECT id, company, role, source, is_remote, status, priority, CAST(NULL AS VARCHAR) AS recruiter_email, recruiter_phone, discovered_date, updated_at
  FROM opportunities"""
_NEXT = "(SELECT max(id) FROM {}) + 1"
_add(
    "k1_add_opportunity",
    lambda o: (
        mu.add_opportunity(tables.migrate(o, "opportunities"), {"company": "Kelp & Moor", "role": "analyst", "recruiter_contact": "hr@kelp.example", "is_remote": True}, NOW).tables["opportunities"]
        .select(*_OPPORTUNITY)
    ),
    "o",
    f"""{_OPPORTUNITIES}
  UNION ALL SELECT {_NEXT.format('opportunities')}, 'Kelp & Moor', 'analyst', 'Other', TRUE, 'Lead', 'Medium', 'hr@kelp.example', '',
    DATE '{NOW.date()}', {STAMP}""",
)
_add(
    "k2_add_question",
    lambda n: (
        mu.add_question(tables.migrate(n, "interview_questions"), {"question_text": "why", "opportunity_id": 4}, NOW).tables["interview_questions"]
        .select("id", "opportunity_id", "question_text", "difficulty", "my_rating", "created_at")
    ),
    "q",
    f"""SELECT id, opportunity_id, question_text, difficulty, my_rating, created_at
  FROM questions
  UNION ALL SELECT {_NEXT.format('questions')}, 4, 'why', 'Medium', 3, {STAMP}""",
)
_add(
    "k3_add_work",
    lambda w: (
        mu.add_work(tables.migrate(w, "sacred_work_log"), {"stone_number": "2000000000", "stone_title": "last", "time_spent_minutes": 25, "what_built": "walls"}, NOW).tables["sacred_work_log"]
        .select("id", "date", "stone_number", "stone_title", "time_spent_minutes", "what_built", "created_at")
    ),
    "w",
    f"""SELECT id, date, stone_number, stone_title, time_spent_minutes, what_built, created_at
  FROM work
  UNION ALL SELECT {_NEXT.format('work')}, DATE '{NOW.date()}', 2000000000, 'last', 25, 'walls', {STAMP}""",
)
_add(
    "k4_add_source",
    lambda n: mu.add_source(n, {"source_name": "  Board "}, NOW).tables["job_sources"],
    "n",
    f"SELECT id, source_name, is_default FROM job_sources UNION ALL SELECT {_NEXT.format('job_sources')}, 'Board', FALSE",
)
_add(
    "k5_add_session",
    lambda s: (
        mu.add_session(tables.migrate(s, "sql_practice_sessions"), {"platform": "other", "question_text": "joins", "my_query": "SELECT 1"}, NOW).tables["sql_practice_sessions"]
        .select("id", "practice_date", "platform", "question_text", "is_correct", "difficulty")
    ),
    "s",
    f"""SELECT id, practice_date, platform, question_text, is_correct, difficulty
  FROM sessions
  UNION ALL SELECT {_NEXT.format('sessions')}, DATE '{NOW.date()}', 'other', 'joins', FALSE, 'Medium'""",
)
_add(
    "k6_insert_or_ignore",
    lambda o: (
        ingest.insert_or_ignore(
            o.select(F.col("company").alias("external_id"), F.col("role").alias("job_title"), "company", F.col("priority").alias("job_url"), F.col("id").alias("_ordinal")),
            o.where("status = 'Ghosted'").select(F.col("company").alias("external_id")),
        )
        .select("external_id", F.col("_ordinal").alias("first_id"))
    ),
    "o",
    """SELECT company AS external_id, min(id) AS first_id
  FROM opportunities
  WHERE priority IS NOT NULL AND company NOT IN (SELECT company
  FROM opportunities
  WHERE status = 'Ghosted')
  GROUP BY company""",
)
_add(
    "k7_update",
    lambda o: (
        mu.update_opportunity(o, 7, {"status": "Offer", "notes": "called", "company": "ignored"}, NOW).tables["opportunities"]
        .select("id", "company", "status", "notes", "priority", "updated_at")
    ),
    "o",
    f"""SELECT id, company, CASE WHEN id = 7 THEN 'Offer' ELSE status END AS status, CASE WHEN id = 7 THEN 'called' END AS notes, priority, CASE
    WHEN id = 7 THEN {STAMP} ELSE updated_at END AS updated_at
  FROM opportunities""",
)
_IMPORTED = lambda o, j: mu.import_job(tables.migrate(o, "opportunities"), tables.migrate(j.drop("matched_skills"), "scraped_jobs"), 11, NOW).tables
_add(
    "k8_import_lead",
    lambda o, j: (
        _IMPORTED(o, j)["opportunities"]
        .select(
                "id", "company", "role", "job_url", "source", "is_remote", "tech_stack", "status",
                F.coalesce("scraped_job_id", F.lit(-1)).alias("scraped_job_id"),
            )
    ),
    "oj",
    f"""SELECT id, company, role, CAST(NULL AS VARCHAR) AS job_url, source, is_remote, tech_stack, status, CAST(-1 AS BIGINT) AS scraped_job_id
  FROM opportunities

  UNION ALL SELECT {_NEXT.format('opportunities')}, company, job_title, job_url, source, coalesce(lower(location) LIKE '%remote%', FALSE), tags,
    'Lead', id
  FROM jobs
  WHERE id = 11""",
)
_add(
    "k8_import_mark",
    lambda o, j: _IMPORTED(o, j)["scraped_jobs"].select("id", "imported_to_opportunities"),
    "oj",
    "SELECT id, id = 11 OR imported_to_opportunities AS imported_to_opportunities FROM jobs",
)
_add(
    "k9_touch_parents",
    lambda o, i: (
        mu.touch_parents(o.withColumn("last_interaction_date", F.col("discovered_date")), i)
        .select("id", "last_interaction_date")
    ),
    "oi",
    """SELECT o.id, coalesce(n.date, o.discovered_date) AS last_interaction_date
  FROM opportunities o
  LEFT JOIN (SELECT opportunity_id, max(date) AS date
  FROM (SELECT *, id = max(id) OVER (PARTITION BY opportunity_id) AS newest
  FROM interactions)
  WHERE newest
  GROUP BY 1) n ON o.id = n.opportunity_id""",
)
_add(
    "k10_touch_work",
    lambda w: (
        mu.update_work(tables.migrate(w, "sacred_work_log"), 7, {"insights": "calm"}, NOW).tables["sacred_work_log"]
        .select("id", "insights", "updated_at")
    ),
    "w",
    f"SELECT id, CASE WHEN id = 7 THEN 'calm' END AS insights, CASE WHEN id = 7 THEN {STAMP} END AS updated_at FROM work",
)
_LEFT = lambda o, i: mu.delete_opportunities(o, i, F.col("status") == "Ghosted").tables
_add(
    "k11_delete",
    lambda o, i: _LEFT(o, i)["opportunities"].select("id", "status"),
    "oi",
    "SELECT id, status FROM opportunities WHERE status IS DISTINCT FROM 'Ghosted'",
)
_add(
    "k11_cascade",
    lambda o, i: _LEFT(o, i)["interactions"].select("id", "opportunity_id"),
    "oi",
    """SELECT id, opportunity_id
  FROM interactions
  WHERE opportunity_id NOT IN (SELECT id
  FROM opportunities
  WHERE status = 'Ghosted')""",
)
_add(
    "k12_migrate",
    lambda o: (
        mu.migrate(o.drop("notes"), "opportunities")
        .select("id", "company", "notes", "scraped_job_id", "offer_date")
    ),
    "o",
    """SELECT id, company, CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS BIGINT) AS scraped_job_id, CAST(NULL AS DATE) AS offer_date
  FROM opportunities""",
)
_add(
    "k13_ensure",
    lambda o: (
        tables.ensure(o.sparkSession, {"opportunities": o}, ["opportunities", "study_topics"])["study_topics"]
        .agg(F.count(F.lit(1)).alias("rows"), F.max("name").alias("name"))
    ),
    "o",
    "SELECT CAST(0 AS BIGINT) AS rows, CAST(NULL AS VARCHAR) AS name",
)
_add(
    "s8_catalog",
    lambda o, i: tables.catalog(o.sparkSession, {"opportunities": o, "interactions": i}, ["opportunities", "interactions", "documents"]),
    "oi",
    """SELECT 'opportunities' AS name, TRUE AS present, count(*) AS rows
  FROM opportunities
  UNION ALL SELECT 'interactions', TRUE, count(*)
  FROM interactions
  UNION ALL SELECT 'documents', FALSE, 0""",
)
_add(
    "f17_normalize",
    lambda s: tables.validate("sql_practice_sessions", tables.normalize_sessions(s.select(
        "id", F.when(F.col("is_correct"), " DBeaver ").otherwise(F.col("platform")).alias("platform"),
        F.concat(F.lit(" "), F.upper("difficulty")).alias("difficulty"), F.lit("custom").alias("database_used"),
    )))[0],
    "s",
    "SELECT id, 'dbeaver' AS platform, difficulty, 'Custom' AS database_used FROM sessions WHERE is_correct",
)
_add(
    "f17_rejected",
    lambda s: (
        tables.validate("sql_practice_sessions", s.select("id", "platform", F.lower("difficulty").alias("difficulty")))[1]
        .select("id", "rejected_for")
    ),
    "s",
    "SELECT id, CASE WHEN difficulty IS NULL THEN 'platform' ELSE 'platform, difficulty' END AS rejected_for FROM sessions",
)
_add(
    "f18_relative_day",
    lambda s: s.select("id", columns.relative_day(F.col("practice_date"), F.lit(PRACTICE_DAY).cast("date")).alias("label")),
    "s",
    f"""SELECT id, CASE WHEN gap = 0 THEN 'Today' WHEN gap = 1 THEN 'Yesterday' WHEN gap < 7 THEN gap || ' days ago'
    ELSE CAST(practice_date AS VARCHAR) END AS label
  FROM (SELECT *, DATE '{PRACTICE_DAY}' - practice_date AS gap
  FROM sessions)""",
)
_add(
    "f19_days_running",
    lambda w: w.agg(columns.days_running(F.min("date"), F.lit(PRACTICE_DAY).cast("date")).alias("days")),
    "w",
    f"SELECT CAST(DATE '{PRACTICE_DAY}' - min(date) + 1 AS INTEGER) AS days FROM work",
)
_add(
    "f20_dashboard",
    lambda n, w, j: q.dashboard(views.learning_gaps(n), w.select((F.col("time_spent_minutes") / F.lit(64.0)).alias("total_study_hours")), j),
    "qwj",
    f"""SELECT (SELECT count(*)
  FROM ({GAPS})
  WHERE weak_percentage > 50) AS weak_count, (SELECT count(*)
  FROM work) AS topic_count, (SELECT CAST(floor(sum(time_spent_minutes / CAST(64 AS DOUBLE)) + 0.5) AS BIGINT)
  FROM work) AS study_hours, (SELECT count(*)
  FROM jobs
  WHERE match_score >= 75) AS strong_count""",
)
_add(
    "f20_colour",
    lambda s: (
        views.keyword_mastery(s)
        .select("keyword", columns.band_colour(F.col("accuracy_percentage")).alias("colour"))
    ),
    "s",
    """SELECT keyword, CASE WHEN accuracy_percentage >= 80 THEN 'good' WHEN accuracy_percentage >= 60 THEN 'fair' ELSE 'weak' END AS colour
  FROM mastery""",
    _views("mastery"),
)
_NAMED = f"list_filter([{', '.join(f"CASE WHEN {_word(t)} THEN '{t}' END" for t, _ in sorted(RULES.skills.items(), key=lambda x: -x[1]))}], lambda x: x IS NOT NULL)"
_add(
    "f21_preview",
    lambda j: _scored(j).select("id", columns.skills_preview(F.col("matched_skills"), 2).alias("shown")),
    "j",
    f"""SELECT id, array_to_string(n[1:2], ', ') || CASE WHEN len(n) > 2 THEN ' (+' || len(n) - 2 || ' more)' ELSE '' END AS shown
  FROM (SELECT id, {_NAMED}[1:10] AS n FROM scored)""",
    SCORED,
)
_add(
    "k15_export",
    lambda j: j.where("match_score >= 70").select("id", "job_title", "company", "match_score", "classification"),
    "j",
    "SELECT id, job_title, company, match_score, classification FROM jobs WHERE match_score >= 70",
)

_add(
    "d1_totals",
    checks.totals,
    "o",
    f"""SELECT count(*) AS total, count(CASE WHEN {ACTIVE} THEN 1 END) AS active, count(CASE WHEN status IN {ARCHIVED} THEN 1 END) AS archived, count(CASE
    WHEN {ACTIVE} THEN 1 END) + count(CASE WHEN status IN {ARCHIVED} THEN 1 END) = count(*) AS consistent
  FROM opportunities""",
)
_add(
    "d2_orphans",
    lambda i, o: checks.orphans(i, o.where("status <> 'Ghosted'")).select("id"),
    "io",
    "SELECT id FROM interactions WHERE opportunity_id NOT IN (SELECT id FROM opportunities WHERE status <> 'Ghosted')",
)
_add(
    "d3_outside_domain",
    lambda j: (
        checks.outside_domain(
            j.withColumn("classification", F.when(F.col("location") == "Remote", "odd").otherwise(F.col("classification"))),
            "scraped_jobs", "classification",
        )
        .select("id")
    ),
    "j",
    "SELECT id FROM jobs WHERE location = 'Remote'",
)
_add(
    "d4_parity",
    checks.parity,
    "oi",
    f"""SELECT 'view' AS by, count(*) AS n
  FROM opportunities
  WHERE {ACTIVE}
  UNION ALL SELECT 'filter', count(*)
  FROM opportunities
  WHERE {ACTIVE}""",
)
_add(
    "d5_gaps_too_good",
    lambda n: checks.gaps_too_good(views.learning_gaps(n).withColumn("avg_performance", F.col("avg_performance") + F.col("min_rating"))),
    "q",
    f"""SELECT *
  FROM (SELECT * REPLACE (avg_performance + min_rating AS avg_performance)
  FROM ({GAPS}))
  WHERE avg_performance >= 4""",
)
_add(
    "d6_time_travel",
    lambda o: checks.time_travel(o, "1998-01-01").select("id"),
    "o",
    "SELECT id FROM opportunities WHERE updated_at < created_at OR created_at > TIMESTAMP '1998-01-01'",
)
_add(
    "d7_score_bounds",
    lambda j: checks.score_bounds(j.withColumn("match_score", F.col("match_score") - 1)).select("id"),
    "j",
    "SELECT id FROM jobs WHERE match_score - 1 < 0 OR match_score - 1 > 100",
)
_add(
    "d8_mastery_recomputed",
    lambda s: checks.mastery_recomputed(
            views.keyword_mastery(s).withColumn("accuracy_percentage", F.when(F.col("keyword") == "JOIN", 1.5).otherwise(F.col("accuracy_percentage"))),
        ),
    "s",
    "SELECT * REPLACE (CAST(1.5 AS DOUBLE) AS accuracy_percentage) FROM mastery WHERE keyword = 'JOIN'",
    _views("mastery"),
)

QUERIES = {name: run for name, (run, _) in _made.items()}
SQL = {name: sql for name, (_, sql) in _made.items()}
