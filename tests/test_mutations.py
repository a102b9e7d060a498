"""Writers, snapshots, ingest as a batch and as a stream."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewright.operators import checks, ingest, mutations as mu, queries, views
from tidewright.plans.registry import RULES
from tidewright.sources.postings import read_postings
from tidewright.sources.snapshots import SnapshotStore, to_json, write_csv, write_json
from tidewright.sources.tables import catalog, empty, ensure, normalize_sessions, validate
from tidewright.streaming.ingest import start_ingest

NOW = datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture
def opportunities(spark):
    return mu.add_opportunity(empty(spark, "opportunities"), {"company": "A", "role": "dev", "recruiter_contact": "a@b.c"}, NOW).tables["opportunities"]


def test_add_opportunity(spark, opportunities):
    df = mu.add_opportunity(opportunities, {"company": "B", "role": "qa", "recruiter_contact": "123", "is_remote": True, "status": "Applied"}, NOW).tables["opportunities"]
    a, b = df.orderBy("id").collect()
    assert (a["id"], a["status"], a["priority"], a["source"], a["recruiter_email"], a["recruiter_phone"], a["is_remote"]) == (1, "Lead", "Medium", "Other", "a@b.c", "", False)
    assert (b["id"], b["status"], b["recruiter_phone"], b["is_remote"]) == (2, "Applied", "123", True)
    with pytest.raises(mu.Invalid):
        mu.add_opportunity(opportunities, {"company": "B"}, NOW)


def test_update(opportunities):
    r = mu.update_opportunity(opportunities, 1, {"status": "Rejected", "company": "no"}, NOW)
    row = r.tables["opportunities"].first()
    assert (row["status"], row["company"], r.payload["updated_fields"]) == ("Rejected", "A", ["status", "company"])
    assert queries.archived(r.tables["opportunities"]).count() == 1 and queries.pipeline(r.tables["opportunities"]).count() == 0
    for changes, key, error in (({}, 1, mu.Invalid), ({"company": "x"}, 1, mu.Invalid), ({"status": "Lead"}, 99999, mu.NotFound)):
        with pytest.raises(error):
            mu.update_opportunity(opportunities, key, changes, NOW)


def test_sources_work_questions_sessions(spark):
    s = mu.add_source(empty(spark, "job_sources"), {"source_name": " Board "}, NOW).tables["job_sources"]
    with pytest.raises(mu.Conflict):
        mu.add_source(s, {"source_name": "Board"}, NOW)
    for bad in ({}, {"source_name": "  "}):
        with pytest.raises(mu.Invalid):
            mu.add_source(s, bad, NOW)
    record = {"stone_number": "3", "stone_title": "t", "time_spent_minutes": 30, "what_built": "w"}
    w = mu.add_work(empty(spark, "sacred_work_log"), record, NOW).tables["sacred_work_log"]
    for change, error in (({"time_spent_minutes": 0}, mu.Invalid), ({"stone_number": "x"}, mu.Invalid), ({}, mu.Conflict)):
        with pytest.raises(error):
            mu.add_work(w, record | change, NOW)
    assert views.work_progress(w).first()["status"] == "In Progress" and views.work_stats(w).first()["total_hours"] == 0.5
    assert mu.add_question(empty(spark, "interview_questions"), {"question_text": "q"}, NOW).tables["interview_questions"].first()["my_rating"] == 3
    assert mu.add_session(empty(spark, "sql_practice_sessions"), {"platform": "other"}, NOW).tables["sql_practice_sessions"].first()["practice_date"] == date(2024, 5, 6)


def test_interactions_and_delete(spark, opportunities):
    r = mu.add_interaction(empty(spark, "interactions"), opportunities, {"opportunity_id": 1, "type": "Call", "date": date(2024, 5, 9)}, NOW)
    r = mu.add_interaction(r.tables["interactions"], r.tables["opportunities"], {"opportunity_id": 1, "type": "Interview", "date": date(2024, 5, 7)}, NOW)
    i, o = r.tables["interactions"], r.tables["opportunities"]
    assert o.first()["last_interaction_date"] == date(2024, 5, 7) and mu.touch_parents(opportunities, i).first()["last_interaction_date"] == date(2024, 5, 7)
    assert queries.week_agenda(i, o, "2024-05-06").count() == 1 and views.active_pipeline(o, i).first()["interaction_count"] == 2
    assert queries.metrics(o, i, "2024-05-06").first().asDict() == {"active_count": 1, "interview_count": 1, "remote_count": 0, "priority_count": 0}
    gone = mu.delete_opportunities(o, i, F.col("company").ilike("a%"))
    assert gone.tables["interactions"].count() == gone.tables["opportunities"].count() == 0 and checks.orphans(i, o).count() == 0
    assert mu.migrate(o.drop("scraped_job_id"), "opportunities").columns == o.columns


def postings(tmp_path, name, rows):
    (tmp_path / "landed").mkdir(exist_ok=True)
    (tmp_path / "landed" / name).write_text(json.dumps(rows))
    return str(tmp_path / "landed")


ROWS = [{"legal": "terms"}, {"id": 1, "slug": "s", "position": "QA software", "company": "C", "description": "the license", "tags": ["sql", "x"], "location": ["Oslo", "Rome"], "salary_min": 1000, "salary_max": 25000}, {"id": "1", "position": "data", "company": "D", "description": "later"}, {"id": 2, "position": "cook", "company": "E", "description": "kitchen"}, {"id": 3, "position": "latest", "company": "F", "description": "x" * 2001, "salary_min": 5}]


def test_ingest_and_import(spark, tmp_path, opportunities):
    path = postings(tmp_path, "a.json", ROWS)
    new, counts = ingest.ingest(read_postings(spark, path), empty(spark, "scraped_jobs"), RULES, NOW)
    rows = {r["external_id"]: r for r in new.collect()}
    assert set(rows) == {"1", "3"} and counts.first()["stored"] == 2 and len(rows["3"]["description"]) == 2000
    assert (rows["1"]["location"], rows["1"]["salary_range"], rows["3"]["salary_range"], rows["1"]["tags"], rows["3"]["location"]) == ("Oslo, Rome", "$1,000 - $25,000", "$5+", "sql, x", "Remote")
    assert sorted(r["id"] for r in rows.values()) == [1, 2]
    jobs = mu.migrate(new, "scraped_jobs")
    jobs = empty(spark, "scraped_jobs").unionByName(jobs)
    again, counts = ingest.ingest(read_postings(spark, path), jobs, RULES, NOW)
    assert counts.first()["stored"] == 0 and read_postings(spark, str(tmp_path / "none")).count() == 0
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.publish({"opportunities": opportunities, "scraped_jobs": jobs})
    t = store.read()
    r = mu.import_job(t["opportunities"], t["scraped_jobs"], 1, NOW)
    assert store.publish(r.tables) == 2
    t = store.read()
    assert t["scraped_jobs"].where("imported_to_opportunities").count() == 1 and t["opportunities"].where("scraped_job_id = 1").first()["status"] == "Lead"
    with pytest.raises(mu.Conflict):
        mu.import_job(t["opportunities"], t["scraped_jobs"], 1, NOW)
    with pytest.raises(mu.NotFound):
        mu.import_job(t["opportunities"], t["scraped_jobs"], 77, NOW)
    assert queries.scraped_jobs_envelope(t["scraped_jobs"], min_score=0.0)["count"] == 2
    assert queries.scraped_jobs(jobs.withColumn("classification", F.lit("LOW_FIT")).withColumn("match_score", F.lit(50.0)), classification="LOW_FIT").count() == 0  # hidden by the least score
    write_csv(jobs.select("id", "match_score"), str(tmp_path / "csv"))
    write_json(jobs, str(tmp_path / "json"), "2024")
    store.backup(str(tmp_path / "backup"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "backup/scraped_jobs")).count() == 2


def test_stream(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.publish({"scraped_jobs": empty(spark, "scraped_jobs")})
    for name in ("a.json", "b.json"):
        path = postings(tmp_path, name, ROWS)
        start_ingest(spark, path, store, RULES, str(tmp_path / "checkpoint"), None).awaitTermination(120)
        rows = store.read()["scraped_jobs"].collect()
        assert sorted((r["id"], r["external_id"]) for r in rows) == [(1, "1"), (2, "3")]
    path = postings(tmp_path, "c.json", [{"id": 9, "position": "QA", "company": "G", "description": "new"}])
    start_ingest(spark, path, store, RULES, str(tmp_path / "checkpoint"), None).awaitTermination(120)
    jobs = store.read()["scraped_jobs"]
    assert sorted((r["id"], r["external_id"]) for r in jobs.collect()) == [(1, "1"), (2, "3"), (3, "9")]
    assert len(store._current()[1]["scraped_jobs"]) > 1  # each batch wrote its own rows
    store.compact()
    assert len(store._current()[1]["scraped_jobs"]) == 1 and store.read()["scraped_jobs"].count() == 3
    r = mu.import_job(empty(spark, "opportunities"), store.read()["scraped_jobs"], 3, NOW)
    assert r.tables["opportunities"].first()["company"] == "G"


def test_json_rows(spark):
    rows = [r["value"] for r in to_json(spark.createDataFrame([(1, None)], "a int, b string")).collect()]
    assert rows == ['{"a":1,"b":null}']


def test_work_updates_touch_the_time(spark):
    log = mu.add_work(empty(spark, "sacred_work_log"), {"stone_number": 1, "stone_title": "t", "time_spent_minutes": 5, "what_built": "w"}, NOW).tables["sacred_work_log"]
    log = mu.add_work(log, {"stone_number": 2, "stone_title": "u", "time_spent_minutes": 5, "what_built": "w"}, NOW).tables["sacred_work_log"]
    later = datetime(2024, 6, 1)
    a, b = mu.update_work(log, 1, {"insights": "x"}, later).tables["sacred_work_log"].orderBy("id").collect()
    assert (a["insights"], a["updated_at"], b["updated_at"]) == ("x", later, NOW)
    for changes, key, error in (({}, 1, mu.Invalid), ({"insights": "x"}, 9, mu.NotFound), ({"stone_number": 2}, 1, mu.Conflict)):
        with pytest.raises(error):
            mu.update_work(log, key, changes, later)


def test_ensure_and_catalog(spark):
    tables = ensure(spark, {"job_sources": mu.add_source(empty(spark, "job_sources"), {"source_name": "x"}, NOW).tables["job_sources"]}, ["job_sources", "documents"])
    assert {n: df.count() for n, df in tables.items()} == {"job_sources": 1, "documents": 0}
    assert {tuple(r) for r in catalog(spark, {"job_sources": tables["job_sources"]}, ["job_sources", "documents"]).collect()} == {("job_sources", True, 1), ("documents", False, 0)}


def test_validate(spark):
    df = normalize_sessions(spark.createDataFrame([(1, " DBeaver ", "easy", "custom"), (2, "other", "odd", None), (3, None, None, None)], "id int, platform string, difficulty string, database_used string"))
    good, bad = validate("sql_practice_sessions", df)
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and bad.first()["rejected_for"] == "difficulty"


def test_scheduled_and_summary(spark, tmp_path):
    from tidewright.functions.scoring import score

    rows = ingest.map_scheduled(read_postings(spark, postings(tmp_path, "a.json", ROWS)), NOW).collect()
    assert [(r["id"], r["salary"], r["status"], r["url"]) for r in rows] == [("1", "$25000", "new", ingest.JOB_URL + "s")]
    df = score(spark.createDataFrame([("the license", "software"), ("zzz", "")], "title string, description string"), RULES)
    s = ingest.batch_summary(df).first()
    assert s["total"] == 2 and s["best"] == ingest.best_match(df).first()["final_score"] and ingest.good_matches(df).count() == 0 and sum(s["classes"].values()) == 2
