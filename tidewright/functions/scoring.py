"""Posting relevance as native columns: weighted terms, flags, domains, location and experience.

Every term is a literal predicate: a substring test, and only where that holds a regex with Unicode
word boundaries. No Python runs on the executors and nothing is shuffled: a score is a projection.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import normalized

# fixed values: upper bounds of the sums, and the bands of the score
SKILL_FULL, DOMAIN_FULL, FLAG_FLOOR = 100, 50, -50
BANDS = ((85, "EXCELLENT"), (75, "HIGH_FIT"), (65, "MEDIUM_FIT"), (40, "LOW_FIT"))
LOWEST = "NO_FIT"
# fixed values: texts of the recommendations
ADVICE = {
    "EXCELLENT": "🎯 APPLY IMMEDIATELY - Outstanding match (%.1f%%)",
    "HIGH_FIT": "✅ STRONG CANDIDATE - Apply today (%.1f%%)",
    "MEDIUM_FIT": "⚠️ REVIEW CAREFULLY - Consider applying (%.1f%%)",
    "LOW_FIT": "❌ WEAK MATCH - Likely not worth time (%.1f%%)",
    "NO_FIT": "🚫 SKIP - Poor fit (%.1f%%)",
}
REMOTE_WORDS = ("remote", "anywhere", "work from home", "wfh")  # fixed values


class RulesError(ValueError):
    """The rules are missing or malformed."""


@dataclass(frozen=True)
class Rules:
    """Terms with weights in file order; a term that comes again overwrites its weight."""

    skills: dict[str, int]
    flags: dict[str, int]
    domains: dict[str, int]
    years: int
    weights: dict[str, float] = field(default_factory=lambda: {"skills_match": 0.4, "experience_match": 0.2, "domain_match": 0.2, "location_match": 0.1, "red_flags": 0.1})
    locations: tuple[str, ...] = ()
    auto_import: float = 75

    @staticmethod
    def from_dict(d: dict) -> Rules:
        try:
            groups = lambda part, names: {t: w for g in names for t, w in part[g]["items"].items()}
            return Rules(
                groups(d["skills"], ("critical", "high_value", "nice_to_have")),
                groups(d["red_flags"], ("deal_breakers", "consultancy_signals", "manual_testing_only", "outdated_tech")),
                dict(d["domains"]["items"]), int(d["profile"]["years_experience"]),
                {k: float(d["scoring_weights"][k]) for k in ("skills_match", "experience_match", "domain_match", "location_match", "red_flags")},
                tuple(d.get("filters", {}).get("location_keywords", {}).get("acceptable", ())), d["auto_import_threshold"],
            )
        except (KeyError, TypeError, AttributeError) as e:
            raise RulesError(f"malformed rules: {e!r}") from e

    @staticmethod
    def from_json(text: str) -> Rules:
        try:
            return Rules.from_dict(json.loads(text))
        except json.JSONDecodeError as e:
            raise RulesError(f"not JSON: {e}") from e

    @staticmethod
    def from_file(spark, path: str) -> Rules:
        """From a JSON file on any file system of Spark."""
        from pyspark.errors import AnalysisException

        try:
            found = spark.read.text(path, wholetext=True).first()
        except AnalysisException as e:
            raise RulesError(f"no rules at {path}") from e
        return Rules.from_json(found["value"] if found else "")

    def frame(self, spark) -> DataFrame:
        """(kind, ordinal, term, weight)."""
        rows = [(kind, i, t, w) for kind in ("skills", "flags", "domains") for i, (t, w) in enumerate(getattr(self, kind).items())]
        return spark.createDataFrame(rows, "kind string, ordinal int, term string, weight int")


def has_term(text: Column, term: str) -> Column:
    """Whether the normalised text holds the term as whole words."""
    term = term.lower()
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return text.contains(term) & text.rlike(rf"(?U)\b{quoted}\b")


def has_domain(text: Column, domain: str) -> Column:
    """Whether any part of the name, split at / and comma, of more than two letters occurs."""
    parts = [p.strip() for p in domain.lower().replace(",", "/").split("/")]
    return reduce(lambda a, b: a | b, [has_term(text, p) for p in parts if len(p) > 2], F.lit(False))


def _matches(hits: list[tuple[str, int, Column]], name: str, weight: str, by_weight: bool) -> tuple[Column, Column]:
    """(sum of weights, array of {name, weight}): heaviest first, ties in file order, or all in file order."""
    if not hits:
        return F.lit(0), F.from_json(F.lit("[]"), f"array<struct<{name}:string,{weight}:int>>")
    total = reduce(lambda a, b: a + b, [F.when(hit, w).otherwise(0) for _, w, hit in hits])
    rows = [F.when(hit, F.struct(F.lit(-w if by_weight else 0).alias("k"), F.lit(i).alias("i"), F.lit(t).alias(name), F.lit(w).alias(weight))) for i, (t, w, hit) in enumerate(hits)]
    found = F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda m: F.struct(m[name].alias(name), m[weight].alias(weight)))
    return total, found


def skills_score(text: Column, rules: Rules) -> tuple[Column, Column]:
    total, found = _matches([(t, w, has_term(text, t)) for t, w in rules.skills.items()], "skill", "weight", True)
    return F.least(F.lit(100.0), total.cast("double") / F.lit(float(SKILL_FULL)) * F.lit(100.0)), found


def flags_penalty(text: Column, rules: Rules) -> tuple[Column, Column]:
    total, found = _matches([(t, w, has_term(text, t)) for t, w in rules.flags.items()], "flag", "penalty", False)
    return F.greatest(F.lit(FLAG_FLOOR), total).cast("double"), found


def domain_score(text: Column, rules: Rules) -> tuple[Column, Column]:
    total, found = _matches([(t, w, has_domain(text, t)) for t, w in rules.domains.items()], "domain", "weight", True)
    return F.least(F.lit(100.0), total.cast("double") / F.lit(float(DOMAIN_FULL)) * F.lit(100.0)), found


def location_score(location: Column, rules: Rules) -> Column:
    """Substrings decide, so even 'no remote' is remote."""
    place = normalized(location)
    anyof = lambda words: reduce(lambda a, b: a | b, [place.contains(w.lower()) for w in words], F.lit(False))
    return F.when(F.coalesce(location, F.lit("")) == "", 50.0).when(anyof(REMOTE_WORDS), 100.0).when(place.contains("hybrid"), 50.0).when(anyof(rules.locations), 30.0).otherwise(0.0)


def experience_score(asked: Column, years: int) -> Column:
    """No number asks nothing; one number is a minimum (with + / plus / more) or exact; two are a range."""
    text = normalized(asked)
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda s: s.try_cast("bigint"))
    a, b, me = F.get(n, 0), F.get(n, 1), F.lit(years)
    least = F.when(me >= a, 100.0).when(me >= a - 1, 80.0).otherwise(50.0)
    exact = F.when(me == a, 100.0).when(F.abs(me - a) <= 1, 90.0).when(F.abs(me - a) <= 2, 70.0).otherwise(50.0)
    span = F.when((me >= a) & (me <= b), 100.0).when((me > b) & (me - b <= 2), 80.0).when(me > b, 60.0).when(a - me <= 1, 70.0).otherwise(40.0)
    open_ended = text.contains("+") | text.contains("plus") | text.contains("more")
    return F.when(F.size(n) == 0, 100.0).when(F.size(n) > 1, span).when(open_ended, least).otherwise(exact)


def classify(score: Column) -> Column:
    out = F
    for least, name in BANDS:
        out = out.when(score >= least, name)
    return out.otherwise(LOWEST)


def recommendation(score: Column, classification: Column) -> Column:
    out = F
    for name, text in ADVICE.items():
        out = out.when(classification == name, F.format_string(text, score))
    return out


def _normal(df: DataFrame, title: str, description: str, *others: str) -> Column:
    """The text that terms are looked for in. Missing optional columns are empty."""
    for name in (title, description):
        if name not in df.columns:
            raise ValueError(f"column {name} is required")
    return normalized(F.concat_ws(" ", *[_or_empty(df, c) for c in (title, description, *others)]))


def _or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _finished(x: DataFrame, rules: Rules) -> DataFrame:
    """The score's columns from its five parts and the three lists of matches."""
    w = {k: F.lit(float(v)) for k, v in rules.weights.items()}
    total = (
        F.col("_s") * w["skills_match"] + F.col("_e") * w["experience_match"] + F.col("_d") * w["domain_match"]
        + F.col("_l") * w["location_match"] + F.col("_f") * w["red_flags"]
    )
    x = x.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    x = x.withColumn("classification", classify(F.col("_t")))
    parts = {"skills_score": "_s", "experience_score": "_e", "domain_score": "_d", "location_score": "_l", "red_flag_penalty": "_f"}
    return x.withColumns({
        "final_score": F.round("_t", 2), "recommendation": recommendation(F.col("_t"), F.col("classification")),
        "breakdown": F.struct(*[F.round(c, 2).alias(name) for name, c in parts.items()]),
        "matched_skills": F.slice("_sm", 1, 10), "matched_domains": F.slice("_dm", 1, 5), "red_flags": F.col("_fm"),
        "should_auto_import": F.col("_t") >= rules.auto_import,
    }).drop("_text", "_s", "_sm", "_f", "_fm", "_d", "_dm", "_l", "_e", "_t")


def score(
    df: DataFrame, rules: Rules, title="title", description="description", tags="tags", company="company", location="location",
    experience="experience_required",
) -> DataFrame:
    """``df`` with final_score, classification, recommendation, breakdown, matched_skills, matched_domains,
    red_flags and should_auto_import. A missing optional column counts as empty; title and description must exist."""
    x = df.withColumn("_text", _normal(df, title, description, tags, company))
    text = F.col("_text")
    (s, sm), (f, fm), (d, dm) = skills_score(text, rules), flags_penalty(text, rules), domain_score(text, rules)
    place, asked = location_score(_or_empty(df, location), rules), experience_score(_or_empty(df, experience), rules.years)
    return _finished(x.withColumns({"_s": s, "_sm": sm, "_f": f, "_fm": fm, "_d": d, "_dm": dm, "_l": place, "_e": asked}), rules)


# ---------------------------------------------------------------- large sets of rules, as a table


def rule_words(rules: DataFrame) -> DataFrame:
    """(kind, ordinal, term, weight) with each part that is looked for, and the part's first word.

    A part that occurs between word boundaries has its first word as a whole word of the text. Parts without any word
    have the empty one, which every text is given.
    """
    names = F.transform(F.split(F.lower("term"), "[/,]"), F.trim)
    parts = F.when(F.col("kind") == "domains", F.filter(names, lambda p: F.length(p) > 2)).otherwise(F.array(F.lower("term")))
    x = rules.withColumn("part", F.explode(parts))
    return x.withColumn("word", F.regexp_extract("part", r"(?U)(\w+)", 1))


def matches(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, ordinal, term, weight) of each rule that a text matches, found by the rules' first words.

    Words of texts meet the rules in a join on the word: an inverted index, however many rules there are. A part of one word needs
    no more; of the others, candidates go back to their texts, where the literal predicate of has_term() decides.
    """
    index = rule_words(rules)
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\w+)"), 1)))
    found = texts.select(key, F.explode(words).alias("word")).join(index, "word")
    whole = F.col("part") == F.col("word")
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace("part", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    checked = found.where(~whole).join(texts.select(key, F.col(text).alias("_in")), key)
    checked = checked.where(F.contains("_in", F.col("part")) & F.regexp_like("_in", quoted))
    columns = [key, "kind", "ordinal", "term", "weight"]
    return found.where(whole & (F.col("word") != "")).select(*columns).unionByName(checked.select(*columns)).distinct()


def score_by_index(
    df: DataFrame, rules: DataFrame, profile: Rules, key: str = "id", title="title", description="description", tags="tags", company="company",
    location="location", experience="experience_required",
) -> DataFrame:
    """As score(), with the terms in a table (kind, ordinal, term, weight) instead of in the plan; all else is the ``profile``'s.

    ``key`` names one row each. The plan does not grow with the rules; texts are shuffled by key once where matches are many.
    """
    x = df.withColumn("_text", _normal(df, title, description, tags, company))
    hits = matches(x.select(key, "_text"), rules, key, "_text")

    def listed(kind: str, name: str, weight: str, by_weight: bool) -> Column:
        row = F.struct((-F.col("weight") if by_weight else F.lit(0)).alias("k"), F.col("ordinal").alias("i"), F.col("term").alias(name), F.col("weight").alias(weight))
        ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row)))
        return F.transform(ordered, lambda m: F.struct(m[name].alias(name), m[weight].alias(weight)))

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("weight"))), F.lit(0)).alias(f"_{kind}")

    sums = hits.groupBy(key).agg(
        total("skills"), total("flags"), total("domains"), listed("skills", "skill", "weight", True).alias("_sm"),
        listed("flags", "flag", "penalty", False).alias("_fm"), listed("domains", "domain", "weight", True).alias("_dm"),
    )
    x = x.join(sums, key, "left")
    of = lambda kind: F.coalesce(f"_{kind}", F.lit(0)).cast("double")
    none = {"_sm": "skill:string,weight:int", "_fm": "flag:string,penalty:int", "_dm": "domain:string,weight:int"}
    x = x.withColumns({
        "_s": F.least(F.lit(100.0), of("skills") / F.lit(float(SKILL_FULL)) * F.lit(100.0)),
        "_f": F.greatest(F.lit(float(FLAG_FLOOR)), of("flags")),
        "_d": F.least(F.lit(100.0), of("domains") / F.lit(float(DOMAIN_FULL)) * F.lit(100.0)),
        "_l": location_score(_or_empty(df, location), profile), "_e": experience_score(_or_empty(df, experience), profile.years),
        **{c: F.coalesce(c, F.from_json(F.lit("[]"), f"array<struct<{fields}>>")) for c, fields in none.items()},
    })
    return _finished(x, profile).drop("_skills", "_flags", "_domains").select(*[c for c in df.columns if c != key and c not in _MADE], key, *_MADE)


_MADE = ("classification", "final_score", "recommendation", "breakdown", "matched_skills", "matched_domains", "red_flags", "should_auto_import")
