"""Ingest at sizes at which partitions split, and the stream against one batch."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ingest
from tidewright.plans.rules import RULES
from tidewright.sources.postings import read_landed, read_postings
from tidewright.sources.snapshots import SnapshotStore
from tidewright.sources.staging import numbered, unstage
from tidewright.sources.tables import empty, migrate
from tidewright.streaming.ingest import start_ingest, start_rejects

NOW = datetime(2024, 5, 6, 7, 8, 9)


def wide(spark, n, first=0):
    """Postings with descriptions of 2,000 characters."""
    rows = spark.range(first, first + n).select(F.col("id").cast("string").alias("id"), F.lit("QA").alias("position"), F.lit("C").alias("company"), F.rpad(F.sha2(F.col("id").cast("string"), 256), 2000, "x").alias("description"))
    nothing = {c: F.lit(None).cast("string") for c in ("slug", "url", "location", "date")} | {c: F.lit(None).cast("long") for c in ("salary_min", "salary_max")}
    return rows.withColumns(nothing).withColumn("tags", F.array().cast("array<string>"))


@pytest.fixture
def defaults(spark):
    """Spark's own settings instead of those of the tests."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_all_wide_rows_are_stored(spark, tmp_path, defaults, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 60_000 if adaptive == "true" else 5_000
        new, counts = ingest.ingest(wide(spark, n), empty(spark, "scraped_jobs"), RULES, NOW)
        store = SnapshotStore(spark, str(tmp_path / "store"))
        store.publish({"scraped_jobs": migrate(new, "scraped_jobs")})
        jobs = store.read()["scraped_jobs"]
        assert jobs.count() == n == counts.first()["stored"]
        assert jobs.agg(F.min("id"), F.max("id"), F.count_distinct("id"), F.count_distinct("external_id")).first() == (1, n, n, n)
        more, counts = ingest.ingest(wide(spark, 300, n - 100), jobs, RULES, NOW)
        assert sorted(r["id"] for r in more.select("id").collect()) == list(range(n + 1, n + 201)) and counts.first()["stored"] == 200
        unstage(new)
        assert jobs.count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbers_follow_the_order(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), F.lit("x").alias("number"))
    out = numbered(df.repartition(7), F.desc("k"), after=10)
    assert out.where("number != 5010 - k").count() == 0 and out.count() == 5_000 and out.columns == ["k", "number"]
    equal = numbered(spark.range(3_000).select(F.lit(1).alias("k")), "k")
    assert equal.agg(F.min("number"), F.max("number"), F.count_distinct("number")).first() == (1, 3_000, 3_000)
    assert numbered(df.where("k < 0"), "k").count() == 0


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_stream_equals_batch(spark, tmp_path):
    """Ten files with repeats inside and across, one known id; then a restart, and a file more."""
    landed = tmp_path / "landed"
    store = SnapshotStore(spark, str(tmp_path / "store"))
    known, _ = ingest.ingest(wide(spark, 1, 5), empty(spark, "scraped_jobs"), RULES, NOW)
    store.publish({"scraped_jobs": migrate(known, "scraped_jobs")})
    for k in range(10):
        rows = [{"id": str((k * 7 + j) % 40), "position": "QA", "company": f"C{k}", "description": f"{k} {j}"} for j in range(12)]
        land(landed, f"{k}.json", [*rows, rows[0] | {"description": "again"}, {"position": None, "company": "none"}])
    first, _ = ingest.ingest(read_landed(spark, str(landed), lines=True)[0], store.read()["scraped_jobs"], RULES, NOW)
    want = {(r["external_id"], r["company"], r["description"]) for r in first.collect()}

    def run():
        start_ingest(spark, str(landed), store, RULES, str(tmp_path / "checkpoint"), None, lines=True, files=1).awaitTermination(300)
        return store.read()["scraped_jobs"].where("id > 1").collect()

    got = run()
    assert len(want) == 39 and {(r["external_id"], r["company"], r["description"]) for r in got} == want
    assert sorted(r["id"] for r in got) == list(range(2, 41))
    assert len(run()) == 39
    land(landed, "more.json", [{"id": "3", "position": "QA", "company": "X"}, {"id": "99", "position": "QA", "company": "X"}])
    assert {r["external_id"] for r in run()} - {w[0] for w in want} == {"99"}


def test_stream_keeps_keys_in_native_state(spark, tmp_path, monkeypatch):
    """One micro-batch of several files: the first of each key, by Spark's own state, however many rows are held at once."""
    from tidewright.streaming import ingest as stream

    monkeypatch.setattr(stream, "HELD", 4)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    known, _ = ingest.ingest(wide(spark, 1, 5), empty(spark, "scraped_jobs"), RULES, NOW)
    store.publish({"scraped_jobs": migrate(known, "scraped_jobs")})
    for k in range(6):
        land(tmp_path / "landed", f"{k}.json", [{"id": str(j % 30), "position": "QA", "company": f"C{k} {j}"} for j in range(k, k + 40)])
    query = start_ingest(spark, str(tmp_path / "landed"), store, RULES, str(tmp_path / "checkpoint"), None, lines=True)
    query.awaitTermination(120)
    got = {(r["external_id"], r["company"]) for r in store.read()["scraped_jobs"].where("id > 1").collect()}
    first, _ = ingest.ingest(read_landed(spark, str(tmp_path / "landed"), lines=True)[0], known, RULES, NOW)
    assert got == {(r["external_id"], r["company"]) for r in first.collect()} and len(got) == 29
    assert [o["operatorName"] for o in query.recentProgress[0]["stateOperators"]] == ["dedupe"]


def test_a_batch_is_published_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    df = empty(spark, "job_sources").unionByName(spark.range(1).select("id"), allowMissingColumns=True)
    assert [store.append({"job_sources": df}, mark=("s", n)) for n in (0, 0, 1, 0)] == [1, 1, 2, 2]
    assert store.read()["job_sources"].count() == 2 and store.marks() == {"s": 1}
    store.publish({"job_sources": df})
    assert store.marks() == {"s": 1}


def test_bad_records(spark, tmp_path):
    landed = tmp_path / "landed"
    land(landed, "a.json", [{"legal": "terms"}, {"id": "1", "position": "QA", "company": "C"}, '{"id": "2", "posi', {"company": "no one"}, {"id": "3", "position": "QA", "salary_min": "much"}, "[1, 2"])
    good, rejected = read_landed(spark, str(landed), lines=True)
    assert [r["id"] for r in good.collect()] == ["1"] and "_landed" not in read_postings(spark, str(landed), lines=True).columns
    reasons = sorted((r["reason"], r["record"][:9]) for r in rejected.collect())
    assert reasons == [("empty", '{"company'), ("malformed", "[1, 2"), ("malformed", '{"id": "2'), ("malformed", '{"id": "3')]
    for _ in range(2):
        start_rejects(spark, str(landed), str(tmp_path / "dead"), str(tmp_path / "c"), None, lines=True).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "dead")).count() == 4
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "b.json").write_text('[{"id": "1"}, {"id": ')
    good, rejected = read_landed(spark, str(tmp_path / "whole"))
    assert rejected.where("reason = 'malformed'").count() == 1
    assert [df.count() for df in read_landed(spark, str(tmp_path / "nowhere"))] == [0, 0]
