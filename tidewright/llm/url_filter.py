"""URL filtering by association rules.

The verdicts of a curated list of (host, path) rules label the urls that they fit. FP-growth mines the
combinations of url tokens that go with either label, over all labelled urls; rules pruned by support and confidence then
judge the urls that no curated rule fits. They are matched by an inverted index: each mined rule stands
under its rarest token, and a distinct token set meets only the rules under its own tokens.

All parts of a url are tokens: scheme, every label of the host, every segment of the path, the extension, every key of the
query, every key with its value, and the fragment. Tokens that the same labelled urls hold are one item, named by the first of
them: a rule with one of them is a rule with any other, and a longer one with two of them says no more. The support is ``MIN_SUPPORT``
of the labelled urls (``MIN_ROWS`` of them at least) on every table, and rules have up to ``LONGEST`` items.

FP-growth finds every combination of a transaction's items, two to the power of their number. So a url of more than ``ABREAST`` items is
given to it as several transactions of at most so many, chosen such that every ``LONGEST`` of its items lie in one of them. What
it finds is then a superset of the combinations that reach the support; each is counted again, exactly, over the distinct item
sets, by the same inverted index that matches rules. One long url so changes nothing for others. A rule goes if part of it says the
same with no less confidence, as it would never win.

Only tokens of some rule matter to a match, and they are at most (tokens of a url) / support many; a url's other tokens are
left out before its token set is looked up.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and get
the default verdict; repeated rows are judged alike; no labelled url gives no mined rule; an empty
table gives an empty table; columns of other names stay, ``host path rule mined confidence verdict`` are written over.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MIN_SUPPORT = 0.002  # of the labelled urls
MIN_ROWS = 5  # labelled urls that a rule must hold in, however few there are
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
LONGEST = 4  # items of a rule
ABREAST = 12  # items of a transaction
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest curated rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's tokens, distinct and sorted."""
    named = lambda slot, values: F.transform(F.filter(values, lambda v: F.length(v) > 0), lambda v: F.concat(F.lit(slot + "="), v))
    one = lambda pattern, text=url: F.array(F.regexp_extract(text, pattern, 1))
    args = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    parts = [
        named("scheme", one(r"^([A-Za-z][A-Za-z0-9+.-]*)://")), named("label", F.split(host, r"\.")), named("seg", F.split(path, "/")),
        named("ext", one(r"\.([A-Za-z0-9]+)$", path)), named("key", F.transform(args, lambda a: F.substring_index(a, "=", 1))),
        named("arg", F.filter(args, lambda a: F.contains(a, F.lit("=")))), named("fragment", one(r"#(.+)$")),
    ]
    return F.coalesce(F.sort_array(F.array_distinct(F.concat(*parts))), F.array().cast("array<string>"))


def frequent(labelled: DataFrame, least: int) -> dict[str, str]:
    """Each token of at least ``least`` labelled urls, with the first token, by name, that the same urls hold.

    Sets of urls are told apart by their number and 128 bits over the distinct token sets. To the driver come tokens of at least
    the support: as many as a url has tokens, over the support, at most.
    """
    sets = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))
    each = sets.select(F.explode("tokens").alias("t"), "n", "a", "b").groupBy("t").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    first, found = {}, {}
    for r in each.where(F.col("n") >= least).orderBy("t").collect():
        found[r["t"]] = first.setdefault((r["n"], r["a"], r["b"]), r["t"])
    return found


def as_items(column, known: dict[str, str]):
    """The distinct items, sorted, of those tokens of a list that are known."""
    if not known:
        return F.array().cast("array<string>")
    other = {t: i for t, i in known.items() if t != i}
    found = F.filter(column, lambda t: t.isin(*known))
    if other:
        names = F.create_map(*[F.lit(x) for pair in other.items() for x in pair])
        found = F.transform(found, lambda t: F.when(t.isin(*other), F.element_at(names, t)).otherwise(t))
    return F.array_sort(F.array_distinct(found))


def named(items, own, known: dict[str, str]):
    """Each item by the last, by name, of the tokens ``own`` that stand for it."""
    tokens_of: dict[str, list[str]] = {}
    for t, i in known.items():
        tokens_of.setdefault(i, []).append(t)
    several = {i: ts for i, ts in tokens_of.items() if len(ts) > 1}
    if not several:
        return F.col(items)
    names = F.create_map(*[x for i, ts in several.items() for x in (F.lit(i), F.array(*[F.lit(t) for t in ts]))])
    return F.transform(items, lambda i: F.when(i.isin(*several), F.array_max(F.array_intersect(F.col(own), F.element_at(names, i)))).otherwise(i))


def _covers(longest: int, abreast: int):
    """Of a list the unions of ``longest`` of its blocks, which hold every combination of so many items."""

    @F.pandas_udf("array<array<string>>")
    def covers(lists: pd.Series) -> pd.Series:
        def one(items):
            size = max(1, abreast // longest)
            blocks = [list(items[i : i + size]) for i in range(0, len(items), size)]
            return [sum(chosen, []) for chosen in combinations(blocks, min(longest, len(blocks)))]

        return lists.map(one)

    return covers


def _indexed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rules`` with the rarest item of each as ``token``; ``counts``: (token, n)."""
    spread = rules.withColumn("token", F.explode("antecedent")).join(counts, "token")
    return spread.groupBy(*rules.columns).agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def _held(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Each set with every indexed rule whose items it holds all."""
    met = sets.withColumn("token", F.explode("tokens")).join(index, "token")
    return met.where(F.size(F.array_except("antecedent", "tokens")) == 0).drop("token")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, longest: int = LONGEST, abreast: int = ABREAST) -> DataFrame:
    """(tokens, verdict) to (antecedent, verdict, confidence, support): all rules of up to ``longest`` items whose consequent is a label."""
    n = labelled.count()
    least = max(1, math.ceil(min_support * n - 1e-9))
    short = labelled.where(F.size("tokens") <= abreast).select("tokens", "verdict")
    cut = labelled.where(F.size("tokens") > abreast).select(F.explode(_covers(longest, abreast)("tokens")).alias("tokens"), "verdict")
    items = short.unionByName(cut).select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / max(1, items.count()))).fit(items)
    antecedent = F.array_sort(F.filter("items", lambda i: ~i.startswith("verdict=")))
    found = model.freqItemsets.where(F.size("items") > F.size(antecedent)).select(antecedent.alias("antecedent")).distinct()
    found = found.where(F.size("antecedent").between(1, longest))
    sets = labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n"))
    counts = sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    held = _held(sets, _indexed(found, counts)).groupBy("antecedent", "verdict").agg(F.sum("n").alias("v"))
    total = held.groupBy("antecedent").agg(F.sum("v").alias("all"))
    rules = held.where(F.col("v") >= least).join(total, "antecedent").withColumn("confidence", F.col("v") / F.col("all"))
    return rules.where(F.col("confidence") >= min_confidence).select("antecedent", "verdict", "confidence", (F.col("v") / F.lit(n)).alias("support"))


def pruned(rules: DataFrame) -> DataFrame:
    """Without rules of which a proper part says the same with no less confidence."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("antecedent")).cast("int") - 2)
    longer = rules.where("size(antecedent) > 1").withColumn("_mask", F.explode(masks))
    longer = longer.withColumn("_part", F.expr("filter(antecedent, (t, i) -> (shiftright(_mask, i) & 1) = 1)"))
    by = rules.select(F.col("antecedent").alias("_part"), "verdict", F.col("confidence").alias("_known"))
    gone = longer.join(by, ["_part", "verdict"]).where("_known >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(gone, ["antecedent", "verdict"], "left_anti").select(*rules.columns)


def judge(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct item sets with the strongest mined rule that they hold: by confidence, support, fewer items, name."""
    counts = rules.select(F.explode("antecedent").alias("token"), "support").groupBy("token").agg(F.max("support").alias("n"))
    met = _held(sets, _indexed(rules, counts))
    rank = F.struct(F.col("confidence"), F.col("support"), -F.size("antecedent"), F.col("verdict"), F.array_join("antecedent", " "))
    best = F.struct(F.col("antecedent").alias("mined"), F.col("verdict").alias("mined_verdict"), "confidence")
    return met.groupBy("tokens").agg(F.max_by(best, rank).alias("_m")).select("tokens", "_m.*")


def filter_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """``pages`` with host, path, rule, mined, confidence and verdict. Urls that a curated rule fits do not enter the last join."""
    scratch = Scratch(pages.sparkSession)
    mine_cols = ["host", "path", "rule", "mined", "confidence", "verdict"]
    kept = [c for c in pages.columns if c not in mine_cols]
    host, path = host_and_path(F.col("url"))
    x = pages.select(F.struct(*kept).alias("row"), "url", host.alias("host"), path.alias("path"))
    rule, says = curated(F.col("host"), F.col("path"), rules)
    x = x.withColumns({"rule": rule, "says": says, "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))})
    labelled = x.where("says is not null").select("tokens", F.col("says").alias("verdict"))
    n = labelled.count()
    support = max(min_support, MIN_ROWS / max(1, n))
    known = frequent(labelled, math.ceil(support * n - 1e-9)) if n else {}
    mined = {"mined": F.lit(None).cast("array<string>"), "mined_verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}
    fit, rest = x.where("says is not null").withColumns(mined), x.where("says is null")
    if known:
        labelled = scratch.save(labelled.withColumn("tokens", as_items("tokens", known)), "labelled")  # read several times
        found = scratch.save(mine(labelled, support, min_confidence, longest), "mined")
        found = scratch.save(pruned(found), "rules")
        used = {r["t"] for r in found.select(F.explode("antecedent").alias("t")).distinct().collect()}  # some of the known
        known = {t: i for t, i in known.items() if i in used}
        rest = rest.withColumns({"own": F.filter("tokens", lambda t: t.isin(*known)) if known else F.array(), "tokens": as_items("tokens", known)})
        judged = scratch.save(judge(rest.where("size(tokens) > 0").select("tokens").distinct(), found), "judged")
        rest = rest.join(judged, "tokens", "left").withColumn("mined", named("mined", "own", known)).drop("own")
    else:
        rest = rest.withColumns(mined)
    fit, rest = (df.withColumn("mined", F.array_join("mined", " & ")) for df in (fit, rest))
    x = fit.unionByName(rest).withColumn("verdict", F.coalesce("says", "mined_verdict", F.lit(default)))
    return x.select("row.*", *mine_cols)


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")
