"""The data-quality checks while tables are written: metrics of the rows that pass, no pass of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.functions.columns import pct
from tidewright.operators import queries, views
from tidewright.sources.snapshots import SnapshotStore
from tidewright.sources.tables import ARCHIVED, DOMAINS


def _outside(table: str, df: DataFrame):
    """How many rows have a value outside its domain, in any column."""
    wrong = F.lit(False)
    for (t, c), values in DOMAINS.items():
        if t == table and c in df.columns:
            wrong = wrong | F.coalesce(~F.col(c).isin(*values), F.lit(False))
    return F.count_if(wrong).alias("outside_domain")


def publish_audited(store: SnapshotStore, tables: dict[str, DataFrame], as_of) -> dict[str, int]:
    """Publishes opportunities, interactions, scraped_jobs, interview_questions and sql_practice_sessions with the three views that
    checks are about, and gives what the eight checks found. Each is 0 where all is well.

    Every metric is observed on the rows that go into a file; orphans are told by a join of the interactions with the parents' ids.
    """
    o, i, j, q, s = (tables[n] for n in ("opportunities", "interactions", "scraped_jobs", "interview_questions", "sql_practice_sessions"))
    seen = {n: Observation(n) for n in ("opportunities", "interactions", "scraped_jobs", "active_pipeline", "learning_gaps", "keyword_mastery")}
    active = queries.active()
    born = F.coalesce(F.col("created_at") > F.lit(as_of).cast("timestamp"), F.lit(False))
    back = F.coalesce(F.col("updated_at") < F.col("created_at"), F.lit(False))
    parents = o.select(F.col("id").alias("opportunity_id"), F.lit(True).alias("_parent"))
    traced = i.join(parents, "opportunity_id", "left")
    mastery = views.keyword_mastery(s)
    again = pct(F.col("correct_count").cast("double"), F.col("practice_count"))
    out = {
        "opportunities": o.observe(
            seen["opportunities"], F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"),
            F.count_if(F.col("status").isin(*ARCHIVED)).alias("archived"), _outside("opportunities", o), F.count_if(born | back).alias("time_travel"),
        ),
        "interactions": traced.observe(
            seen["interactions"], F.count_if(F.col("_parent").isNull()).alias("orphans"), _outside("interactions", i)
        ).select(*i.columns),
        "scraped_jobs": j.observe(
            seen["scraped_jobs"], F.count_if((F.col("match_score") < 0) | (F.col("match_score") > 100)).alias("bounds"), _outside("scraped_jobs", j)
        ),
        "interview_questions": q, "sql_practice_sessions": s,
        "active_pipeline": views.active_pipeline(o, i).observe(seen["active_pipeline"], F.count(F.lit(1)).alias("rows")),
        "learning_gaps": views.learning_gaps(q).observe(seen["learning_gaps"], F.count_if(F.col("avg_performance") >= 4).alias("too_good")),
        "keyword_mastery": mastery.observe(seen["keyword_mastery"], F.count_if(again != F.col("accuracy_percentage")).alias("differ")),
    }
    store.publish(out)
    m = {name: one.get for name, one in seen.items()}
    return {
        "d1_totals": m["opportunities"]["total"] - m["opportunities"]["active"] - m["opportunities"]["archived"],
        "d2_orphans": m["interactions"]["orphans"],
        "d3_outside_domain": sum(m[t]["outside_domain"] for t in ("opportunities", "interactions", "scraped_jobs")),
        "d4_parity": m["active_pipeline"]["rows"] - m["opportunities"]["active"],
        "d5_gaps_too_good": m["learning_gaps"]["too_good"],
        "d6_time_travel": m["opportunities"]["time_travel"],
        "d7_score_bounds": m["scraped_jobs"]["bounds"],
        "d8_mastery_recomputed": m["keyword_mastery"]["differ"],
    }
