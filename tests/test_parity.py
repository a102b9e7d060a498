"""Every query over the driver's tables against its SQL, and the plans that must hold."""

import duckdb
import pandas as pd
import pytest

from tidewright.functions.columns import band_colour, days_running, items, relative_day, skills_preview, week_label
from tidewright.operators import queries, views
from tidewright.plans import catalog, mapping
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    cell = lambda x: "null" if pd.isna(x) else repr(float(x)) if isinstance(x, float) else str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(cell, row)) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(catalog.SQL[name]).df())


def test_week_labels(spark):
    days = spark.createDataFrame([("2023-01-01",), ("2024-01-01",), ("2025-12-31",)], "d string").select(week_label(F.col("d").cast("date")).alias("w"))
    assert [r["w"] for r in days.collect()] == ["2023-W00", "2024-W01", "2025-W52"]


def test_small_columns(spark):
    row = spark.sql("SELECT date'2024-01-05' d, 85.0 a, '[{\"skill\":\"x\",\"weight\":2},{\"skill\":\"y\",\"weight\":1}]' j, '' e").select(
        relative_day(F.col("d"), F.lit("2024-01-06").cast("date")).alias("r"), days_running(F.col("d"), F.lit("2024-01-06").cast("date")).alias("n"), band_colour(F.col("a")).alias("c"), skills_preview(items(F.col("j"), "skill"), 1).alias("s"), F.size(items(F.col("e"), "skill")).alias("z")
    ).first()
    assert tuple(row) == ("Yesterday", 2, "good", "x (+1 more)", 0)


def test_keywords_by_recursion(spark):
    """The list split as a recursive query gives the same counts."""
    s = mapping.sessions(spark, SF)
    s.createOrReplaceTempView("sessions")
    got = spark.sql("""WITH RECURSIVE r(id, word, rest) AS (
        SELECT id, CAST('' AS STRING), concat(keywords_used, ',') FROM sessions WHERE keywords_used IS NOT NULL
        UNION ALL SELECT id, substring_index(rest, ',', 1), substr(rest, instr(rest, ',') + 1) FROM r WHERE rest <> '')
      SELECT trim(word) AS keyword, count(*) AS n FROM r WHERE trim(word) <> '' GROUP BY 1""")
    assert {tuple(x) for x in got.collect()} == {(x["keyword"], x["practice_count"]) for x in views.keyword_mastery(s).collect()}


def test_filters_reach_the_scan(spark):
    jobs = spark.read.parquet(f"{SF}/orders.parquet").withColumnRenamed("o_totalprice", "match_score").withColumnRenamed("o_orderkey", "id").withColumn("scraped_at", F.col("o_orderdate"))
    plan = queries.scraped_jobs(jobs.select("id", "match_score", "scraped_at", F.lit(None).cast("string").alias("description"), F.lit(True).alias("imported_to_opportunities")), 100000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "o_custkey" not in plan
