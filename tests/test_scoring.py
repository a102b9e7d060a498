"""The scoring kernel: worked examples, boundaries, float order."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions.scoring import Rules, RulesError, classify, domain_score, experience_score, has_term, location_score, score, skills_score
from tidewright.plans.registry import RULES

EXAMPLE = Rules(
    skills={"Rust": 12, "Linux": 8, "Message Queues": 10, "Postgres": 10, "Docker": 5, "Profiling": 15},
    flags={"PHP": -20, "Night Shifts": -25, "Unpaid": -30},
    domains={"Storage/Databases": 20, "Power Grids": 15, "AI/GIS": 10}, years=6, locations=("Lyon",),
)
POSTINGS = [  # skills 50, domains 40, location 100, experience 100; 8, 0, 50, 70, flags -45; 0, 0, 30, 50, flags -75; 60, 90, 100, 100
    ("Systems programmer", "You write a storage engine in Rust on Linux, with profiling of every release. Postgres helps.", "Remote in Europe", "Kelp & Moor", "docker, rust", "4-9 years"),
    ("PHP maintainer", "Keep an old shop running. Night shifts twice a month.", "Hybrid, Lyon", "Old Shop", "php, linux", "8 years"),
    ("Intern", "Unpaid night shifts, some PHP.", "Lyon", "", "", "10+ years"),
    ("Grid software lead", "Rust, Linux, message queues, Postgres, Docker and profiling for power grids: databases, maps and GIS.", "anywhere", "Volt", None, ""),
]


def test_examples(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(POSTINGS)], "id int, title string, description string, location string, company string, tags string, experience_required string")
    rows = score(df, EXAMPLE).orderBy("id").collect()
    assert [(r["final_score"], r["classification"]) for r in rows] == [(58.0, "LOW_FIT"), (17.7, "NO_FIT"), (8.0, "NO_FIT"), (72.0, "MEDIUM_FIT")]
    assert [len(r["matched_skills"]) for r in rows] == [5, 1, 0, 6] and [len(r["red_flags"]) for r in rows] == [0, 2, 3, 0]
    assert rows[0]["matched_skills"][0]["skill"] == "Profiling" and [d["domain"] for d in rows[3]["matched_domains"]] == ["Storage/Databases", "Power Grids", "AI/GIS"] and not rows[0]["should_auto_import"]
    assert rows[0]["recommendation"].endswith("(58.0%)") and rows[2]["breakdown"]["red_flag_penalty"] == -50


@pytest.mark.parametrize("asked,want", [("", 100), (None, 100), ("senior", 100), ("5+ years", 100), ("8 plus", 80), ("9 or more", 50), ("7 years", 100), ("6 years", 90), ("9 years", 70), ("1 year", 50), ("5-8 years", 100), ("3-5 years", 80), ("1-2", 60), ("8-9", 70), ("10-12", 40)])
def test_experience(spark, asked, want):
    assert spark.range(1).select(experience_score(F.lit(asked).cast("string"), 7).alias("s")).first()["s"] == want


@pytest.mark.parametrize("place,want", [("", 50), (None, 50), ("Hybrid - X", 50), ("no remote", 100), ("WFH", 100), ("Lyon, FR", 30), ("Oslo", 0)])
def test_location(spark, place, want):
    assert spark.range(1).select(location_score(F.lit(place).cast("string"), EXAMPLE).alias("s")).first()["s"] == want


def test_terms_are_whole_words(spark):
    df = spark.createDataFrame([("sqlite sql.",), ("mysql",), ("éti c++ x",), ("a ti b",)], "t string")
    assert [r[0] for r in df.select(has_term(F.col("t"), "SQL")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(has_term(F.col("t"), "ti")).collect()] == [False, False, False, True]


def test_caps_and_bands(spark):
    many = Rules({f"t{i}": 30 for i in range(5)}, {}, {"aa/bbb": 60}, 1)
    row = spark.createDataFrame([("t0 t1 t2 t3 t4 bbb",)], "t string").select(skills_score(F.col("t"), many)[0].alias("s"), domain_score(F.col("t"), many)[0].alias("d")).first()
    assert (row["s"], row["d"]) == (100, 100)
    got = [r[0] for r in spark.createDataFrame([(85.0,), (84.99,), (75.0,), (65.0,), (40.0,), (39.99999999999999,)], "x double").select(classify(F.col("x"))).collect()]
    assert got == ["EXCELLENT", "HIGH_FIT", "HIGH_FIT", "MEDIUM_FIT", "LOW_FIT", "NO_FIT"]


def test_rules_file(spark, tmp_path):
    with pytest.raises(RulesError, match="no rules at"):
        Rules.from_file(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(RulesError, match="not JSON"):
        Rules.from_file(spark, str(tmp_path / "bad.json"))


def test_rules():
    with pytest.raises(RulesError):
        Rules.from_json("{")
    with pytest.raises(RulesError):
        Rules.from_dict({})
    part = lambda **x: {k: {"items": v} for k, v in x.items()}
    d = {"profile": {"years_experience": 3}, "skills": part(critical={"a": 1}, high_value={"a": 2}, nice_to_have={}), "red_flags": part(deal_breakers={}, consultancy_signals={"x": -1}, manual_testing_only={}, outdated_tech={}), "domains": {"items": {}}, "scoring_weights": RULES.weights, "auto_import_threshold": 75}
    assert Rules.from_dict(d).skills == {"a": 2}


def test_required_columns(spark):
    with pytest.raises(ValueError):
        score(spark.createDataFrame([("x",)], "title string"), EXAMPLE)
