"""Writers for many records at once: typed, checked and numbered as sets; what can't be stored comes back with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.sources.staging import numbered
from tidewright.sources.tables import DEFAULTS, DOMAINS, SCHEMAS, UNIQUE, empty, migrate

# fixed values: what a record must have, besides what its table's defaults give
NEEDED = {
    "opportunities": ("company", "role"), "sacred_work_log": ("stone_number", "stone_title", "time_spent_minutes", "what_built"),
    "job_sources": ("source_name",),
}
MADE = ("id", "created_at", "updated_at")  # never taken from a record


def _typed(records: DataFrame, table: str) -> tuple[DataFrame, list[Column]]:
    """(records with the table's types, where values that have no such type are null; reasons for these)."""
    wrong, typed = [], {}
    for field in empty(records.sparkSession, table).schema:
        if field.name not in records.columns or field.name in MADE:
            continue
        raw = F.trim(F.col(field.name).cast("string")) if field.dataType.simpleString() == "string" or field.name in UNIQUE.values() else F.col(field.name)
        value = raw.try_cast(field.dataType)
        filled = F.coalesce(F.col(field.name).cast("string"), F.lit("")) != ""
        typed[field.name] = value
        wrong.append(F.when(filled & value.isNull(), F.lit(f"{field.name} is no {field.dataType.simpleString()}")))
    return typed, wrong


def add_many(table: str, existing: DataFrame, records: DataFrame, now, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows for the table with ids and defaults, the records that were rejected with ``reasons``), by the rules of the single writers.

    A record is rejected for needed columns that are missing, empty or zero, for values without the column's type or outside its domain,
    and for a unique value that the table has or that a sound record before it in ``order`` (unique) has. Columns that the table
    does not have are ignored. All checks are expressions; the unique value costs one aggregate and two joins on it.
    """
    typed, wrong = _typed(records, table)
    raw = F.struct(*records.columns)
    x = records.select(F.col(order).alias("_order"), raw.alias("_raw"), F.array(*wrong).alias("_wrong"), *[v.alias(c) for c, v in typed.items()])
    needed = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit(f"{c} is required")) for c in NEEDED.get(table, ())]
    outside = [F.when(~F.col(c).isin(*values), F.lit(f"{c} is outside its domain")) for (t, c), values in DOMAINS.items() if t == table and c in typed]
    x = x.withColumn("_reasons", F.array_compact(F.concat(F.col("_wrong"), F.array(*needed, *outside))))
    key = UNIQUE.get(table)
    if key in typed:
        first = x.where((F.size("_reasons") == 0) & F.col(key).isNotNull()).groupBy(key).agg(F.min("_order").alias("_first"))
        taken = existing.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_taken", F.lit(True))
        x = x.join(first, key, "left").join(taken, key, "left")
        sound = F.size("_reasons") == 0
        twice = F.when(sound & F.col("_taken"), F.lit(f"{key} exists")).when(sound & (F.col("_order") > F.col("_first")), F.lit(f"{key} is repeated"))
        x = x.withColumn("_reasons", F.array_compact(F.concat("_reasons", F.array(twice))))
    top = existing.agg(F.max("id").alias("m")).first()["m"] or 0
    good = numbered(x.where(F.size("_reasons") == 0).select("_order", *typed), "_order", name="id", after=top).drop("_order")
    stamp = F.lit(now).cast("timestamp")
    made = {c: stamp for c in MADE[1:] if f"{c} timestamp" in SCHEMAS[table]}
    given = {c: F.coalesce(c, F.lit(v)) if c in typed else F.lit(v) for c, v in DEFAULTS.get(table, {}).items()}
    days = {"sacred_work_log": "date", "sql_practice_sessions": "practice_date", "opportunities": "discovered_date"}
    if table in days:
        given[days[table]] = F.coalesce(days[table], F.to_date(stamp)) if days[table] in typed else F.to_date(stamp)
    rejected = x.where(F.size("_reasons") > 0).select("_raw.*", F.array_join("_reasons", "; ").alias("reasons"))
    return migrate(good.withColumns(given | made), table), rejected
