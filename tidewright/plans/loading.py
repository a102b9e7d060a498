"""Queries that write and read again: ingest, streams, rejected records, snapshots, folders of keys, records in bulk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import scoring
from tidewright.operators import audit, bulk, ingest, mutations as mu
from tidewright.plans import mapping as m
from tidewright.plans.registry import ACTIVE, ARCHIVED, BANDED, GAPS, KEYWORD_TEST, NOW, SCORED, SCRAPE_DAY, STAMP
from tidewright.plans.rules import RULES
from tidewright.sources import footers, tables
from tidewright.sources.partitioned import PartitionedTable
from tidewright.sources.postings import read_landed
from tidewright.sources.snapshots import SnapshotStore, write_csv, write_json
from tidewright.sources.staging import folder
from tidewright.streaming.ingest import start_ingest, start_rejects
from tidewright.streaming.touch import start_touch

QUERIES, SQL = {}, {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


# ---------------------------------------------------------------- ingest

STORED = ["external_id", "job_title", "company", "location", "salary_range", "match_score", "classification", "description_length"]


def _postings(spark, sf_dir) -> DataFrame:
    """Jobs as landed postings: two of them share an id."""
    j = m.jobs(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    return j.select(
        F.floor(F.col("id") / 2).cast("string").alias("id"), nothing.alias("slug"), F.col("job_url").alias("url"), F.col("job_title").alias("position"),
        "company", "description", "location", F.array("tags", "company").alias("tags"), (F.col("id") * 100).alias("salary_min"),
        (F.col("id") * 200).alias("salary_max"), nothing.alias("date"), F.col("id").alias("place"),
    )


def _had(spark, sf_dir) -> DataFrame:
    """What the store has: every fifth job."""
    had = m.jobs(spark, sf_dir).where("id % 5 = 0").select("id", "external_id")
    return tables.migrate(had, "scraped_jobs")


def _shown(new: DataFrame) -> DataFrame:
    return new.withColumn("description_length", F.length("description"))


def _ingest(spark, sf_dir) -> DataFrame:
    new, _ = ingest.ingest(_postings(spark, sf_dir), _had(spark, sf_dir), RULES, SCRAPE_DAY, ordinal="place")
    return _shown(new).select("id", *STORED)


def _ingest_counts(spark, sf_dir) -> DataFrame:
    return ingest.ingest(_postings(spark, sf_dir), _had(spark, sf_dir), RULES, SCRAPE_DAY, ordinal="place")[1]


def _landed(spark, sf_dir) -> str:
    """The postings as JSON lines; those that share an id lie in one file, in order."""
    p = _postings(spark, sf_dir)
    path = folder(spark, "landed")
    lines = p.repartitionByRange("id").sortWithinPartitions("id", "place")
    lines.select(F.to_json(F.struct(*[c for c in p.columns if c != "place"]))).write.text(path)
    return path


def _stream(spark, sf_dir) -> DataFrame:
    """The same through the stream, run twice; ids are checked to be gapless."""
    store = SnapshotStore(spark, folder(spark, "store"))
    store.publish({"scraped_jobs": _had(spark, sf_dir)})
    before = store.read()["scraped_jobs"].agg(F.max("id").alias("top")).first()["top"]
    landed, checkpoint = _landed(spark, sf_dir), folder(spark, "checkpoint")
    for _ in range(2):
        start_ingest(spark, landed, store, RULES, checkpoint, None, lines=True).awaitTermination()
    new = store.read()["scraped_jobs"].where(F.col("id") > before)
    top = new.agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).select((F.col("top") - F.col("n") == before).alias("gapless"))
    return _shown(new).select(*STORED).crossJoin(F.broadcast(top))  # one row


_FIRSTS = f"""posted AS (
  SELECT id AS place, CAST(id // 2 AS VARCHAR) AS external_id, job_title, company, description, coalesce(location, 'Remote') AS location,
         tags || ', ' || company AS tags, '$' || format('{{:,}}', id * 100) || ' - $' || format('{{:,}}', id * 200) AS salary,
         lower(concat_ws(' ', job_title, description, tags || ' ' || company)) AS p
  FROM jobs
), firsts AS (
  SELECT place AS id, external_id, job_title, company, description, location, tags, CASE WHEN place > 0 THEN salary END AS salary_range
  FROM posted
  WHERE ({KEYWORD_TEST}) AND external_id NOT IN (SELECT external_id FROM jobs WHERE id % 5 = 0) AND company IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY place) = 1
)"""
_STORED = f"""external_id, job_title, company, location, salary_range, round(total, 2) AS match_score, {BANDED} AS classification,
  CAST(least(length(description), 2000) AS INTEGER) AS description_length"""
_INGESTED = f"WITH {m.JOBS},\n{_FIRSTS},\n{SCORED.replace('FROM jobs', 'FROM firsts')}\n"

_add("s5_ingest", _ingest, f"""{_INGESTED}
SELECT (SELECT max(id) FROM jobs WHERE id % 5 = 0) + row_number() OVER (ORDER BY id) AS id, {_STORED}
FROM firsts JOIN scored USING (id)
""")
_add("k6_ingest_counts", _ingest_counts, f"""{_INGESTED}
SELECT count(*) AS stored, count(CASE WHEN {BANDED} IN ('EXCELLENT', 'HIGH_FIT') THEN 1 END) AS high_fit FROM scored
""")
_add("s5_stream_ingest", _stream, f"""{_INGESTED}
SELECT {_STORED}, TRUE AS gapless FROM firsts JOIN scored USING (id)
""")


# ---------------------------------------------------------------- records that can't be used


def _faulty(spark, sf_dir) -> str:
    """Jobs as JSON lines: every seventh is cut, every eleventh is empty, one is the metadata record."""
    j = m.jobs(spark, sf_dir)
    whole = F.to_json(F.struct(F.col("external_id").alias("id"), F.col("job_title").alias("position"), "company", F.col("id").alias("salary_min")))
    line = F.when(F.col("id") == 1, '{"legal": "terms"}').when(F.col("id") % 7 == 0, F.concat(F.lit('{"id": "'), "external_id"))
    line = line.when(F.col("id") % 11 == 0, F.to_json(F.struct("company"))).otherwise(whole)
    path = folder(spark, "faulty")
    j.select(line).write.text(path)
    return path


def _rejected(spark, sf_dir) -> DataFrame:
    return read_landed(spark, _faulty(spark, sf_dir), lines=True)[1].select("reason", "record")


def _dead_letters(spark, sf_dir) -> DataFrame:
    landed, to = _faulty(spark, sf_dir), folder(spark, "dead")
    start_rejects(spark, landed, to, folder(spark, "checkpoint"), None, lines=True).awaitTermination()
    return spark.read.schema("reason string, record string, path string").json(to).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def _usable(spark, sf_dir) -> DataFrame:
    return read_landed(spark, _faulty(spark, sf_dir), lines=True)[0].select("id", "position", "company", "salary_min")


_add("s2_rejected", _rejected, f"""WITH {m.JOBS}
SELECT CASE WHEN id % 7 = 0 THEN 'malformed' ELSE 'empty' END AS reason,
       CASE WHEN id % 7 = 0 THEN '{{"id": "' || external_id ELSE '{{"company":"' || company || '"}}' END AS record
FROM jobs WHERE id <> 1 AND (id % 7 = 0 OR id % 11 = 0)
""")
_add("s2_dead_letters", _dead_letters, f"""WITH {m.JOBS}
SELECT CASE WHEN id % 7 = 0 THEN 'malformed' ELSE 'empty' END AS reason, count(*) AS records
FROM jobs WHERE id <> 1 AND (id % 7 = 0 OR id % 11 = 0) GROUP BY 1
""")
_add("s2_postings", _usable, f"""WITH {m.JOBS}
SELECT external_id AS id, job_title AS position, company, id AS salary_min FROM jobs WHERE id <> 1 AND id % 7 <> 0 AND id % 11 <> 0
""")


# ---------------------------------------------------------------- rules


def _rules_file(spark, sf_dir) -> DataFrame:
    """Rules made of the nations and regions, through a JSON file."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("term"), "n_nationkey")
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("term"), "r_regionkey")

    def items(df, key, weight, where="true"):
        entries = F.transform(F.sort_array(F.collect_list(F.when(F.expr(where), F.struct(key, "term", weight.alias("w"))))), lambda e: F.struct(e["term"], e["w"]))
        return df.agg(F.struct(F.map_from_entries(entries).alias("items")).alias("group"))

    key, none = F.col("n_nationkey"), F.struct(F.map_from_arrays(F.array(), F.array()).cast("map<string,bigint>").alias("items"))
    skills = [items(n, "n_nationkey", key + 1, f"n_nationkey div 10 = {k}").withColumnRenamed("group", g) for k, g in enumerate(("critical", "high_value", "nice_to_have"))]
    flags = items(n, "n_nationkey", -key - 1, "n_nationkey % 5 = 0").withColumnRenamed("group", "deal_breakers")
    domains = items(r, "r_regionkey", F.col("r_regionkey") + 1).withColumnRenamed("group", "domains")
    one = reduce(lambda a, b: a.crossJoin(b), [*skills, flags, domains])  # of one row each
    weights = {"skills_match": 0.4, "experience_match": 0.2, "domain_match": 0.2, "location_match": 0.1, "red_flags": 0.1}
    text = one.select(F.to_json(F.struct(
        F.struct("critical", "high_value", "nice_to_have").alias("skills"),
        F.struct("deal_breakers", *[none.alias(c) for c in ("consultancy_signals", "manual_testing_only", "outdated_tech")]).alias("red_flags"),
        "domains", F.struct(F.lit(7).alias("years_experience")).alias("profile"),
        F.struct(*[F.lit(v).alias(k) for k, v in weights.items()]).alias("scoring_weights"), F.lit(75).alias("auto_import_threshold"),
    )))
    path = folder(spark, "rules")
    text.coalesce(1).write.text(path)
    return scoring.Rules.from_file(spark, path).frame(spark)


_RULES = """
SELECT 'skills' AS kind, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ordinal, n_name AS term, CAST(n_nationkey + 1 AS INTEGER) AS weight FROM nation
UNION ALL
SELECT 'flags', CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER), n_name, CAST(-n_nationkey - 1 AS INTEGER) FROM nation WHERE n_nationkey % 5 = 0
UNION ALL
SELECT 'domains', CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER), r_name, CAST(r_regionkey + 1 AS INTEGER) FROM region
"""
_add("s3_rules_file", _rules_file, _RULES)


def _many_rules(spark, sf_dir) -> DataFrame:
    """Every word of five to nine letters of the questions is a rule: jobs scored by the index of them all."""
    word = F.explode(F.regexp_extract_all(F.lower("question_text"), F.lit("[a-z0-9_]+"), 0))
    terms = m.questions(spark, sf_dir).select(word.alias("term")).where("term rlike '^[a-z]{5,9}$'").distinct()
    weight = (F.length("term") % 4 + 1).cast("int")
    rules = terms.select(F.lit("skills").alias("kind"), F.lit(0).alias("ordinal"), "term", weight.alias("weight"))
    rules = rules.unionByName(terms.where("term like 'b%'").select(F.lit("flags").alias("kind"), F.lit(0).alias("ordinal"), "term", (-weight).alias("weight")))
    jobs = m.jobs(spark, sf_dir).select("id", "job_title", "description", "tags", "company", "location")
    x = scoring.score_by_index(jobs, rules, RULES, title="job_title", experience="none")
    found = F.array_join(F.array_sort(F.transform("red_flags", lambda f: f["flag"])), "|")
    return x.select("id", "final_score", F.col("breakdown.skills_score").alias("skills_score"), F.col("breakdown.red_flag_penalty").alias("penalty"), found.alias("flags"))


_add("c9_rules_by_index", _many_rules, rf"""WITH {m.JOBS},
{m.QUESTIONS},
terms AS (
  SELECT DISTINCT w AS term, length(w) % 4 + 1 AS weight
  FROM (SELECT unnest(regexp_extract_all(lower(question_text), '[a-z0-9_]+')) AS w FROM questions) WHERE regexp_full_match(w, '[a-z]{{5,9}}')
), texts AS (
  SELECT id, location, lower(concat_ws(' ', coalesce(job_title, ''), coalesce(description, ''), coalesce(tags, ''), coalesce(company, ''))) AS t FROM jobs
), words AS (
  SELECT DISTINCT id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS term FROM texts
), hits AS (
  SELECT id, least(100, sum(weight)) AS s, greatest(-50, coalesce(-sum(weight) FILTER (term LIKE 'b%'), 0)) AS f,
         string_agg(term, '|' ORDER BY term) FILTER (term LIKE 'b%') AS flags
  FROM words JOIN terms USING (term) GROUP BY id
), parts AS (
  SELECT id, CAST(coalesce(s, 0) AS DOUBLE) / CAST(100 AS DOUBLE) * CAST(100 AS DOUBLE) AS s, CAST(coalesce(f, 0) AS DOUBLE) AS f, coalesce(flags, '') AS flags,
         CAST(CASE WHEN coalesce(location, '') = '' THEN 50 WHEN lower(location) LIKE '%remote%' THEN 100 WHEN lower(location) LIKE '%hybrid%' THEN 50
                   WHEN lower(location) LIKE '%bangalore%' THEN 30 ELSE 0 END AS DOUBLE) AS l
  FROM texts LEFT JOIN hits USING (id)
)
SELECT id, round(greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), s * CAST(0.4 AS DOUBLE) + CAST(100 AS DOUBLE) * CAST(0.2 AS DOUBLE)
         + CAST(0 AS DOUBLE) * CAST(0.2 AS DOUBLE) + l * CAST(0.1 AS DOUBLE) + f * CAST(0.1 AS DOUBLE))), 2) AS final_score,
       round(s, 2) AS skills_score, round(f, 2) AS penalty, flags
FROM parts
""")


# ---------------------------------------------------------------- folders of keys, footers


def _partitioned(spark, sf_dir, **more) -> PartitionedTable:
    rows = m.opportunities(spark, sf_dir).select("id", "company", "status", "notes", "priority", "updated_at")
    return PartitionedTable(spark, folder(spark, "opportunities"), width=5_000, **more).create(rows)


def _update_in_place(spark, sf_dir) -> DataFrame:
    t = _partitioned(spark, sf_dir)
    t.change([7], lambda df: mu.update_opportunity(df, 7, {"status": "Offer", "notes": "called"}, NOW).tables["opportunities"])
    return t.read()


def _delete_in_place(spark, sf_dir) -> DataFrame:
    t = _partitioned(spark, sf_dir)
    gone = t.read().where("status = 'Ghosted'").select("id")
    t.change(gone, lambda df: mu.delete_where(df, F.col("status") == "Ghosted"))
    return t.read().select("id", "status")


def _lookup(spark, sf_dir) -> DataFrame:
    j = m.jobs(spark, sf_dir).select("id", "external_id", "company", "match_score", F.col("job_url"))
    t = PartitionedTable(spark, folder(spark, "jobs"), width=1_000, looked_up=("external_id",)).create(j)
    return t.lookup([11, 12, 995]).unionByName(t.lookup(external_id="42"))


_add("k7_update_in_place", _update_in_place, f"""WITH {m.OPPORTUNITIES}
SELECT id, company, CASE WHEN id = 7 THEN 'Offer' ELSE status END AS status, CASE WHEN id = 7 THEN 'called' END AS notes, priority,
       CASE WHEN id = 7 THEN {STAMP} ELSE updated_at END AS updated_at
FROM opportunities
""")
_add("k11_delete_in_place", _delete_in_place, f"WITH {m.OPPORTUNITIES}\nSELECT id, status FROM opportunities WHERE status IS DISTINCT FROM 'Ghosted'")
_add("q20_lookup", _lookup, f"""WITH {m.JOBS}
SELECT id, external_id, company, match_score, job_url FROM jobs WHERE id IN (11, 12, 995, 42)
""")
_add("q36_extremes", lambda spark, sf_dir: footers.extremes(spark, f"{sf_dir}/orders.parquet", "o_orderkey", "o_custkey"), """
SELECT count(*) AS rows, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, count(o_orderkey) AS n_o_orderkey,
       min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey, count(o_custkey) AS n_o_custkey
FROM orders
""")
_COUNTED = ("orders", "lineitem", "events", "documents", "customer")
_add(
    "q26_counts_from_footers",
    lambda spark, sf_dir: footers.table_counts(spark, {t: f"{sf_dir}/{t}.parquet" for t in _COUNTED}),
    "\nUNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _COUNTED),
)


# ---------------------------------------------------------------- many records, the stream of interactions


def _records(spark, sf_dir) -> DataFrame:
    """Work entries as texts, with faults: numbers that are none, empty titles, repeated numbers, numbers that the log has."""
    w = m.work_log(spark, sf_dir)
    return w.select(
        F.col("id").alias("n"), F.when(F.col("id") % 7 == 0, F.lit("x")).otherwise(F.floor(F.col("id") / 2).cast("string")).alias("stone_number"),
        F.when(F.col("id") % 11 != 0, F.col("stone_title")).alias("stone_title"), F.lit("25").alias("time_spent_minutes"), "what_built",
    )


def _bulk(spark, sf_dir):
    log = m.work_log(spark, sf_dir).where("id % 10 = 0").select("id", F.floor(F.col("id") / 2).cast("int").alias("stone_number"))
    return bulk.add_many("sacred_work_log", tables.migrate(log, "sacred_work_log"), _records(spark, sf_dir), NOW, "n")


_FAULTS = """records AS (
  SELECT id AS n, id // 2 AS k, id % 7 = 0 AS no_number, id % 11 = 0 OR stone_title = '' AS no_title, stone_title, what_built FROM work
), sound AS (
  SELECT *, k IN (SELECT id // 2 FROM work WHERE id % 10 = 0) AS taken, min(n) OVER (PARTITION BY k) AS first_n
  FROM records WHERE NOT no_number AND NOT no_title AND k <> 0
)"""
_add("k3_bulk_added", lambda spark, sf_dir: _bulk(spark, sf_dir)[0].select("id", "date", "stone_number", "stone_title", "time_spent_minutes", "created_at"), f"""
WITH {m.WORK},
{_FAULTS}
SELECT (SELECT max(id) FROM work WHERE id % 10 = 0) + row_number() OVER (ORDER BY n) AS id, DATE '{NOW.date()}' AS date, CAST(k AS INTEGER) AS stone_number,
       stone_title, CAST(25 AS INTEGER) AS time_spent_minutes, {STAMP} AS created_at
FROM sound WHERE NOT taken AND n = first_n
""")
_add("k3_bulk_rejected", lambda spark, sf_dir: _bulk(spark, sf_dir)[1].select("n", "reasons"), f"""
WITH {m.WORK},
{_FAULTS}
SELECT n, concat_ws('; ', CASE WHEN no_number THEN 'stone_number is no int; stone_number is required' WHEN k = 0 THEN 'stone_number is required' END,
                    CASE WHEN no_title THEN 'stone_title is required' END) AS reasons
FROM records WHERE no_number OR no_title OR k = 0
UNION ALL
SELECT n, CASE WHEN taken THEN 'stone_number exists' ELSE 'stone_number is repeated' END FROM sound WHERE taken OR n > first_n
""")


def _touch_stream(spark, sf_dir) -> DataFrame:
    t = PartitionedTable(spark, folder(spark, "parents"), width=20_000)
    parents = m.opportunities(spark, sf_dir).select("id", F.col("discovered_date").alias("last_interaction_date"))
    t.create(parents)
    landed = folder(spark, "interactions")
    i = tables.migrate(m.interactions(spark, sf_dir), "interactions")
    for k in range(2):
        i.where(F.pmod(F.hash("id"), F.lit(2)) == k).write.mode("append").parquet(landed)
        start_touch(spark, landed, t, f"{landed}-checkpoint", None).awaitTermination()
    return t.read()


_add("k9_touch_stream", _touch_stream, f"""WITH {m.OPPORTUNITIES},
{m.INTERACTIONS},
newest AS (
  SELECT opportunity_id, arg_max(date, (id, date)) AS date FROM interactions GROUP BY opportunity_id
)
SELECT o.id, coalesce(n.date, o.discovered_date) AS last_interaction_date FROM opportunities o LEFT JOIN newest n ON o.id = n.opportunity_id
""")


# ---------------------------------------------------------------- snapshots and sinks


def _store(spark, sf_dir) -> SnapshotStore:
    """Two versions: the sources, then the work log beside them and more sources."""
    store = SnapshotStore(spark, folder(spark, "store"))
    sources = m.job_sources(spark, sf_dir)
    store.publish({"job_sources": sources.where("id < 10")})
    store.publish({"sacred_work_log": m.work_log(spark, sf_dir)})
    store.append({"job_sources": sources.where("id >= 10")})
    return store


def _published(spark, sf_dir) -> DataFrame:
    read = _store(spark, sf_dir).read()
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids")) for n, df in read.items()])


def _backup(spark, sf_dir) -> DataFrame:
    to = folder(spark, "backup")
    _store(spark, sf_dir).backup(to)
    return tables.load_tables(spark, to, ["job_sources"]).job_sources.select("id", "source_name", "is_default")


def _json_sink(spark, sf_dir) -> DataFrame:
    path = folder(spark, "json")
    write_json(m.jobs(spark, sf_dir).select("id", "external_id", "match_score", "location"), path, "2024-01-01")
    return spark.read.schema("id long, external_id string, match_score double, location string, ingested date").json(path)


def _csv_sink(spark, sf_dir) -> DataFrame:
    path = folder(spark, "csv")
    write_csv(m.jobs(spark, sf_dir).where("match_score >= 70").select("id", "company", "match_score", "classification"), path)
    return spark.read.schema("id long, company string, match_score double, classification string").option("header", True).csv(path)


def _loaded(spark, sf_dir) -> DataFrame:
    root = folder(spark, "tables")
    tables.migrate(m.opportunities(spark, sf_dir), "opportunities").write.parquet(f"{root}/opportunities")
    loaded = tables.load_tables(spark, root, ["opportunities"]).opportunities
    return loaded.select("id", "company", "status", "is_remote", "discovered_date", "scraped_job_id")


def _ensured(spark, sf_dir) -> DataFrame:
    """The tables that are there keep their rows; those that are missing come empty, with their columns."""
    there = {"opportunities": m.opportunities(spark, sf_dir), "interactions": m.interactions(spark, sf_dir)}
    every = tables.ensure(spark, there, ["opportunities", "interactions", "study_topics"])
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("id"), F.lit(-1)).alias("top")) for n, df in every.items()])


_add("k17_published", _published, f"""WITH {m.SOURCES},
{m.WORK}
SELECT 'job_sources' AS name, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM job_sources
UNION ALL SELECT 'sacred_work_log', count(*), CAST(sum(id) AS BIGINT) FROM work
""")
_add("k14_backup", _backup, f"WITH {m.SOURCES}\nSELECT id, source_name, is_default FROM job_sources")
_add("k16_json_sink", _json_sink, f"WITH {m.JOBS}\nSELECT id, external_id, match_score, location, DATE '2024-01-01' AS ingested FROM jobs")
_add("k15_csv_sink", _csv_sink, f"WITH {m.JOBS}\nSELECT id, company, match_score, classification FROM jobs WHERE match_score >= 70")
_add("s1_loaded", _loaded, f"""WITH {m.OPPORTUNITIES}
SELECT id, company, status, is_remote, discovered_date, CAST(NULL AS BIGINT) AS scraped_job_id FROM opportunities
""")
_add("k13_ensured", _ensured, f"""WITH {m.OPPORTUNITIES},
{m.INTERACTIONS}
SELECT 'opportunities' AS name, count(*) AS rows, max(id) AS top FROM opportunities
UNION ALL SELECT 'interactions', count(*), max(id) FROM interactions
UNION ALL SELECT 'study_topics', 0, -1
""")


def _audited(spark, sf_dir) -> DataFrame:
    """The eight checks of tables with faults, from the publish that wrote them."""
    o = m.opportunities(spark, sf_dir).withColumn("status", F.when(F.col("id") % 50 == 0, "Odd").otherwise(F.col("status")))
    i = m.interactions(spark, sf_dir).withColumn("opportunity_id", F.when(F.col("id") % 40 == 1, 1 << 40).otherwise(F.col("opportunity_id")))
    j = m.jobs(spark, sf_dir).withColumn("match_score", F.col("match_score") - 1)
    found = audit.publish_audited(
        SnapshotStore(spark, folder(spark, "store")),
        {"opportunities": o, "interactions": i, "scraped_jobs": j, "interview_questions": m.questions(spark, sf_dir), "sql_practice_sessions": m.sessions(spark, sf_dir)},
        "1998-01-01",
    )
    return spark.createDataFrame(list(found.items()), "check string, found long")


_ODD = "(SELECT * REPLACE (CASE WHEN id % 50 = 0 THEN 'Odd' ELSE status END AS status) FROM opportunities)"
_add("d_audit", _audited, f"""WITH {m.OPPORTUNITIES},
{m.INTERACTIONS},
{m.JOBS},
{m.QUESTIONS}
SELECT 'd1_totals' AS check, count(*) - count(CASE WHEN {ACTIVE} THEN 1 END) - count(CASE WHEN status IN {ARCHIVED} THEN 1 END) AS found FROM {_ODD}
UNION ALL SELECT 'd2_orphans', count(*) FROM interactions WHERE id % 40 = 1 OR opportunity_id NOT IN (SELECT id FROM opportunities)
UNION ALL SELECT 'd3_outside_domain', count(*) FROM {_ODD} WHERE status = 'Odd'
UNION ALL SELECT 'd4_parity', 0
UNION ALL SELECT 'd5_gaps_too_good', count(*) FROM ({GAPS}) WHERE avg_performance >= 4
UNION ALL SELECT 'd6_time_travel', count(*) FROM opportunities WHERE updated_at < created_at OR created_at > TIMESTAMP '1998-01-01'
UNION ALL SELECT 'd7_score_bounds', count(*) FROM jobs WHERE match_score - 1 < 0 OR match_score - 1 > 100
UNION ALL SELECT 'd8_mastery_recomputed', 0
""")
