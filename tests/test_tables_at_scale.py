"""Changes to one folder, lookups that skip, footers, rules in a table, records in bulk, dates from a stream."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewright.functions import scoring
from tidewright.operators import bulk, mutations as mu
from tidewright.plans.rules import RULES
from tidewright.sources import footers
from tidewright.sources.partitioned import PartitionedTable
from tidewright.sources.tables import empty, migrate
from tidewright.streaming.touch import start_touch

NOW = datetime(2024, 5, 6, 7, 8, 9)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def parents(spark, n):
    rows = spark.range(1, n + 1).select("id", F.concat(F.lit("c"), "id").alias("company"), F.lit("Lead").alias("status"), F.lit("r").alias("role"))
    return migrate(rows, "opportunities")


def test_one_row_rewrites_one_folder(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"), width=100).create(parents(spark, 1_000))
    before = files(t.path)
    assert t.change([7], lambda df: mu.update_opportunity(df, 7, {"status": "Offer"}, NOW).tables["opportunities"]) == 1
    assert len(before & files(t.path)) == len(before) - len([f for f in before if "_part=0/" in f])
    assert [(r["id"], r["status"]) for r in t.read().where("status <> 'Lead'").collect()] == [(7, "Offer")] and t.read().count() == 1_000
    t.change([200, 299], lambda df: mu.delete_where(df, F.col("id").between(200, 299)))
    assert t.read().count() == 900 and not [f for f in files(t.path) if "_part=2/" in f]
    t.change(spark.createDataFrame([(901,), (5,)], "k long"), lambda df: mu.delete_where(df, F.col("id") == 901))
    assert t.read().count() == 899 and t.change([], lambda df: df) == 0
    with pytest.raises(mu.NotFound):
        t.change([7], lambda df: mu.update_opportunity(df, 8_000, {"status": "Offer"}, NOW).tables["opportunities"])
    with pytest.raises(ValueError):
        t.change([7], lambda df: df.withColumn("id", F.col("id") + 500))
    assert t.read().count() == 899


def scanned(df):
    """Rows that the scan handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    df.sparkSession.sparkContext._jvm.Thread.sleep(0)
    leaves = plan.collectLeaves()
    return [leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size())][0]


def test_lookups_skip_row_groups(spark, tmp_path):
    jobs = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("external_id"), F.rpad(F.lit(""), 100, "x").alias("fill"))
    t = PartitionedTable(spark, str(tmp_path / "t"), width=1_000_000, looked_up=("external_id",), options={"parquet.block.size": 65536, "parquet.page.size": 8192, "parquet.block.row.count.limit": 500}).create(jobs)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (t.lookup([4321]), t.lookup(external_id=jobs.where("id = 4321").first()["external_id"])):
            assert [r["id"] for r in found.collect()] == [4321]
            assert scanned(found) <= 2_000
        assert t.lookup(external_id="none").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_counts_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5, 1_005).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even")).repartition(3).write.parquet(path)
    found = footers.extremes(spark, path, "id", "even")
    assert found.first() == (1_000, 5, 1_004, 1_000, 6, 1_004, 500)
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)" in found._jdf.queryExecution().executedPlan().toString()
    both = footers.table_counts(spark, {"a": path, "b": path})
    assert {tuple(r) for r in both.collect()} == {("a", 1_000), ("b", 1_000)}
    assert both._jdf.queryExecution().executedPlan().toString().count("PushedAggregation: [COUNT(*)]") >= 2


TEXTS = [
    (1, "The MIT License", "public license, of software: c++ and .net; naïve café"), (2, None, None), (3, "version_2 of", "license"), (4, "a", "apache work open source"),
    (5, "x", "c++x y.net stupid stupid moron"), (6, "é" * 3, "étude étud 中文 open"), (7, "mit  LICENSE", "\\E rights\treserved \\q"), (8, "", "general public license general public"),
]


def both_ways(spark, rules, texts):
    df = spark.createDataFrame(texts, "id long, title string, description string").withColumn("location", F.lit("remote"))
    want = scoring.score(df, rules).select("id", *scoring._MADE)
    got = scoring.score_by_index(df, rules.frame(spark), rules).select("id", *scoring._MADE)
    assert got.schema.simpleString() == want.schema.simpleString()
    return sorted(want.collect()), sorted(got.collect()), got


def test_rules_by_index(spark):
    odd = {"c++": 9, ".net": 8, "étude": 7, "naïve café": 6, "中文": 5, "\\E rights reserved \\Q": 4, "of": 2, "++": 1, "license": 3, "MIT License": 3}
    rules = scoring.Rules(RULES.skills | odd, RULES.flags | {"y": -1}, RULES.domains | {"Etudes/étude, ab": 3, "zz": 9}, 7)
    want, got, _ = both_ways(spark, rules, TEXTS)
    assert got == want and any(r["matched_skills"] for r in got)


def test_many_rules(spark):
    """5,000 rules against the predicates themselves, and a plan that does not grow with them."""
    terms = {f"w{i} v{i % 7}" if i % 5 == 0 else f"w{i}": i % 9 + 1 for i in range(5_000)}
    texts = [(i, " ".join(f"w{(i * 37 + j) % 6_000}" for j in range(40)), " ".join(f"w{(i * 5) * 5 % 5_000} v{k}" for k in range(7))) for i in range(60)]
    few = scoring.Rules(dict(list(terms.items())[:10]), {"w3": -2}, {"W1/w2, w3": 4}, 7)
    many = scoring.Rules(terms, {"w3": -2}, {"W1/w2, w3": 4}, 7)
    _, got, plan = both_ways(spark, few, texts)
    size = len(plan._jdf.queryExecution().analyzed().toString())
    df = spark.createDataFrame(texts, "id long, title string, description string").withColumn("location", F.lit("remote"))
    found = scoring.score_by_index(df, many.frame(spark), many)
    assert abs(len(found._jdf.queryExecution().analyzed().toString()) - size) < 1_000  # ids of columns differ in length
    for r in found.collect():
        text = " " + " ".join(f"{t} {d}" for i, t, d in texts if i == r["id"]) + " "
        hits = sorted(((-w, k, t) for k, (t, w) in enumerate(terms.items()) if f" {t} " in text))
        assert [(m["skill"], m["weight"]) for m in r["matched_skills"]] == [(t, -w) for w, _, t in hits[:10]]
        assert r["breakdown"]["skills_score"] == round(min(100.0, sum(-w for w, _, _ in hits)), 2)


def test_bulk(spark):
    log = mu.add_work(empty(spark, "sacred_work_log"), {"stone_number": 4, "stone_title": "t", "time_spent_minutes": 5, "what_built": "w"}, NOW).tables["sacred_work_log"]
    rows = [(1, "9", "a", "30", "x", "zz"), (2, "9", "b", "30", "x", None), (3, "4", "c", "30", "x", None), (4, "ten", "d", "0", "x", None), (5, "11", " ", "many", None, None), (6, "9", "", "30", "x", None), (7, "12", "e", "1", "x", None)]
    records = spark.createDataFrame(rows, "n int, stone_number string, stone_title string, time_spent_minutes string, what_built string, other string")
    good, bad = bulk.add_many("sacred_work_log", log, records, NOW, "n")
    assert [(r["id"], r["stone_number"], r["stone_title"], r["date"], r["created_at"]) for r in good.orderBy("id").collect()] == [(2, 9, "a", date(2024, 5, 6), NOW), (3, 12, "e", date(2024, 5, 6), NOW)]
    assert {r["n"]: r["reasons"] for r in bad.collect()} == {
        2: "stone_number is repeated", 3: "stone_number exists", 4: "stone_number is no int; stone_number is required; time_spent_minutes is required",
        5: "time_spent_minutes is no int; stone_title is required; time_spent_minutes is required; what_built is required", 6: "stone_title is required",
    }
    names = spark.createDataFrame([(1, " Board "), (2, "Board"), (3, "  "), (4, None)], "n int, source_name string")
    good, bad = bulk.add_many("job_sources", empty(spark, "job_sources"), names, NOW, "n")
    assert [(r["id"], r["source_name"], r["is_default"]) for r in good.collect()] == [(1, "Board", False)] and bad.count() == 3
    sessions = spark.createDataFrame([(1, "other", "Easy", "true"), (2, "else", "Easy", "maybe")], "n int, platform string, difficulty string, is_correct string")
    good, bad = bulk.add_many("sql_practice_sessions", empty(spark, "sql_practice_sessions"), sessions, NOW, "n")
    assert [(r["id"], r["is_correct"], r["practice_date"]) for r in good.collect()] == [(1, True, date(2024, 5, 6))]
    assert bad.first()["reasons"] == "is_correct is no boolean; platform is outside its domain"


@pytest.mark.parametrize("split", [1, 3])
def test_dates_from_a_stream(spark, tmp_path, split):
    rows = [(i * 7919 % 1009, (i * 31) % 400 + 1, date(2024, 1 + i % 12, 1 + i % 28)) for i in range(900)]
    rows = [(k, o, d) for k, (i, o, d) in enumerate(rows)]
    seen = migrate(spark.createDataFrame(rows, "id long, opportunity_id long, date date"), "interactions")
    want = {r["id"]: r["last_interaction_date"] for r in mu.touch_parents(parents(spark, 500), seen).collect()}
    t = PartitionedTable(spark, str(tmp_path / "t"), width=50).create(parents(spark, 500))
    for k in range(split):
        seen.where(F.pmod(F.hash("id"), F.lit(split)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        start_touch(spark, str(tmp_path / "landed"), t, str(tmp_path / "c"), None, files=1).awaitTermination(300)
    assert {r["id"]: r["last_interaction_date"] for r in t.read().collect()} == want
