"""Chat formatting by cumulative-snapshot collapse.

A logger that writes a conversation again after every turn leaves snapshots, each a prefix of the
next. Rolling hashes of turn prefixes find them: a conversation whose full hash is the hash of a
proper prefix of another goes (anti-join); of equal conversations the smallest conv_id stays. What
stays is rendered.

Turns are in the order of (turn; role; md5 of the text), nulls first. The prefix hash is the exclusive or of
two 64-bit hashes of (position, role, text), so a prefix of any length costs one step, and one
conversation can be dealt over many tasks: all turns are cut by range in their order, and numbered and folded by these blocks, whether or
not turns have numbers. A conversation is rendered in parts of ``part_turns`` turns, a row each and numbered
from 0, whatever its length: no row grows without bound.

Defined results: a null conv_id is an id of its own, apart from any text; a null role renders as ``unknown``, a null
text as empty (a null equals no text but null); repeated rows are turns of their own; an empty table gives an empty
table; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import Scratch, table

BLOCK = 4096  # turns of a part


def _turns(conversations: DataFrame) -> DataFrame:
    """Every turn with a number of its own (_u), the conversation's name (_c) and hashes of what it holds."""
    role, text = F.col("role"), F.col("text")
    content = [role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit(""))]
    return conversations.select(
        "conv_id", F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("_c"), "turn", "role", "text",
        F.md5(text.cast("binary")).alias("_o"), F.xxhash64(F.lit(1), *content).alias("_x"), F.xxhash64(F.lit(2), *content).alias("_y"), F.monotonically_increasing_id().alias("_u"),
    )


def prefixes(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """Every turn as (conv_id, _c, _u, pos from 1, n of the conversation, h1, h2 of the prefix that ends with it). Texts are not shuffled."""
    order = [F.col("turn").asc_nulls_first(), "role", "_o"]
    x = turns.drop("text").repartitionByRange("_c", *order, "_u").withColumn("_block", F.spark_partition_id())
    x = scratch.save(x, "ordered")
    blocks = x.groupBy("_c", "_block").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_c").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy("_c"))).drop("_n")
    x = x.withColumn("_row", F.row_number().over(Window.partitionBy("_c", "_block").orderBy(*order))).join(blocks, ["_c", "_block"])
    x = x.withColumn("pos", F.col("_before") + F.col("_row"))
    upto = Window.partitionBy("_c", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for h, own_hash in (("h1", "_x"), ("h2", "_y")):
        x = x.withColumn(h, F.bit_xor(F.xxhash64("pos", own_hash)).over(upto))
    x = scratch.save(x.select("conv_id", "_c", "_u", "_block", "pos", "n", "h1", "h2"), "numbered")
    folded = x.groupBy("_c", "_block").agg(*[F.max_by(h, "pos").alias("_" + h) for h in ("h1", "h2")])
    for h in ("h1", "h2"):
        folded = folded.withColumn("_" + h, F.coalesce(F.bit_xor("_" + h).over(own), F.lit(0)))
    x = x.join(folded, ["_c", "_block"])
    for h in ("h1", "h2"):
        x = x.withColumn(h, F.col(h).bitwiseXOR(F.col("_" + h)))
    return scratch.save(x.drop("_block", "_h1", "_h2"), "prefixes")


def maximal(found: DataFrame) -> DataFrame:
    """(_c, conv_id, n, copies) of the conversations that stay."""
    whole = found.where("pos = n").groupBy("n", "h1", "h2").agg(F.min_by(F.struct("_c", "conv_id"), F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("_k"), F.count(F.lit(1)).alias("copies"))
    proper = found.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("_k.*", "n", "copies")


def format_chats(conversations: DataFrame, part_turns: int = BLOCK) -> DataFrame:
    """One row for each maximal conversation (and part): conv_id, part, n_turns, n_copies, text."""
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.save(_turns(conversations), "turns")
    found = prefixes(scratch, turns)
    stays = scratch.save(maximal(found), "maximal")
    places = found.select("_c", "_u", "pos").join(stays, "_c")
    rows = turns.select("_u", "role", "text").join(places, "_u")
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = rows.withColumn("part", F.floor((F.col("pos") - 1) / part_turns).cast("int"))
    out = rows.groupBy("_c", "conv_id", "part", "n", "copies").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))), lambda t: t["said"]), "").alias("text"))
    return out.select("conv_id", "part", F.col("n").alias("n_turns"), F.col("copies").alias("n_copies"), "text")


def query(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = rf"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said,
         md5(concat_ws('|', role IS NULL, md5(coalesce(role, '')), text IS NULL, md5(coalesce(text, '')))) AS x
  FROM conversations
), f AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(x, '' ORDER BY pos)) AS h FROM t GROUP BY conv_id
), p AS (
  SELECT t.conv_id, a.pos, md5(string_agg(t.x, '' ORDER BY t.pos)) AS h
  FROM t JOIN t AS a ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.pos <= a.pos GROUP BY t.conv_id, a.pos
), proper AS (
  SELECT DISTINCT p.pos, p.h FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id WHERE p.pos < f.n
), best AS (
  SELECT min(conv_id) AS conv_id, CAST(count(*) AS BIGINT) AS n_copies, n, h FROM f GROUP BY n, h
)
SELECT t.conv_id, CAST((t.pos - 1) // {BLOCK} AS INTEGER) AS part, best.n AS n_turns, best.n_copies, string_agg(t.said, '' ORDER BY t.pos) AS text
FROM best JOIN t ON best.conv_id IS NOT DISTINCT FROM t.conv_id
WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.pos = best.n AND proper.h = best.h) GROUP BY 1, 2, 3, 4
"""
