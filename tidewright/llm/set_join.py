"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set holds the hashes of its distinct k-word shingles. Sets are put into size bands; two
sets that are similar enough lie in the same band or in neighbouring ones, and at most ``slack``
elements lie in one of them only. For a pair of neighbouring bands the universe of hashes is cut into
segments, and a plan gives each segment one credit (its subset is indexed) or two (its one-deletion
neighbourhood too). Where the credits exceed the slack, similar sets agree on some segment: fully, or
but for one element where it has two credits. A cost model picks the plan of each band; spare
segments let every set leave out its costliest ones: those whose signatures most sets share, because
the subset is empty or lies within a passage that many documents quote.

Equal sets are one class from the start. Classes that share a signature meet the most central one of the group
(star edges); what these leave apart meets across components, so no pair of different components
that shares a signature goes unchecked. Before two sets are brought together their parity sketches
are: every element flips one of 1024 bits, so the bits in which two sketches differ are no more than
the elements in which the sets do, and within a family of loose copies most pairs end there, inside the join. For large sets
a wider sketch, of two bits an element, says the same before the sets themselves are sent.
Verification counts the common hashes of both sets exactly. The result is components, not links: pairs
inside a component other than star edges are not compared.

Hot signatures and large components are never dealt to one task: what a group has in common is summed up in every task
first and written, and joined back, so that Spark can split a group over tasks. Copies of a text meet before the shuffle.

Names: a set is known by 64 bits, a text by 128. Two of 2.5e10 different sets (100 TB) share a name with an expected 17 pairs,
of which only such of equal size band meet in anything but a needless comparison.

Defined results: null texts and texts without words have the empty set, linked with nothing; shorter
texts than k words are one shingle; repeated rows are of one class; a null doc_id takes part (and links others) with
the id null, which counts as the largest; texts of a repeated doc_id are texts of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import Scratch, U, documents_words, mix, shingles_of, table

PERCENT = 85  # 100 * intersection >= PERCENT * union
WORDS = 4
UNLIKE = 300  # unlike sets of a band that quote the same, in the cost model
SKETCH = 16  # numbers of 64 bits
_BITS = [f"p{i}" for i in range(SKETCH)]
QUOTED = 30  # shingles that many sets may quote alike, in the cost model


def similar(common, a, b, percent: int):
    """Whether sets of a and b elements with so many in common are similar, in whole numbers."""
    return 100 * common >= percent * (a + b - common)


_MADE: dict = {}  # edges and plans by their arguments; plain, so that it goes to workers by value


def band_edges(percent: int) -> np.ndarray:
    """The smallest size of each band: no set below an edge is similar to one at or above the next."""
    if percent in _MADE:
        return _MADE[percent]
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 100 // percent + 1)
    _MADE[percent] = np.array(edges)
    return _MADE[percent]


def band_of(n: int, percent: int) -> int:
    return int(np.searchsorted(band_edges(percent), n, side="right")) - 1


def slack_of(size: int, percent: int) -> int:
    """The most that two similar sets of ``size`` elements together can differ by."""
    return size - 2 * -(-percent * size // (100 + percent))


def plan(band: int, percent: int) -> tuple[int, int, int]:
    """(segments, of them with two credits, credits that a set may leave out) for sets of bands ``band`` and ``band + 1``.

    Cost of a plan: a unit for each signature, and for the segments that a set can't leave out the
    chance that it agrees with an unlike set that quotes the same ``QUOTED`` shingles, times ``UNLIKE`` such sets.
    """
    if (band, percent) in _MADE:
        return _MADE[band, percent]
    edges = band_edges(percent)
    most = int(edges[band + 1]) + int(edges[band + 2]) - 2  # of one band, or of both; two of the upper one meet by its own plan
    slack = max(slack_of(s, percent) for s in range(max(2, most - 4 * percent), most + 1))
    size = int(edges[band])
    own = 1 - min(0.7, QUOTED / size)  # share of a set that is not quoted
    best = None
    for twos in sorted({0, (slack + 1) // 4, (slack + 1) // 2}):
        for skips in sorted({0, 1, 2, 3, 4, 6, *[int(slack * f) for f in (0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)]}):
            segments = slack + 1 + 2 * skips - twos
            mean = own * size / segments
            shared = (segments - twos) * exp(-mean) + twos * exp(-mean) * (1 + mean)  # segments that hold nothing of its own
            over = max(0.0, shared - skips) + 0.4 * shared**0.5 * exp(-((max(0.0, skips - shared)) ** 2) / (2 * shared + 1e-9))
            cost = segments + twos * size / segments + UNLIKE * over * exp(-mean)
            if twos <= segments and (best is None or cost < best[0]):
                best = (cost, segments, twos, skips)
    _MADE[band, percent] = best[1:]
    return best[1:]


def signatures(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set (distinct hashes), for its band with the next one and with the one before; and of each its place.

    Two similar sets differ by the plan's slack at most, and the credits of the segments that neither
    leaves out exceed it; so on one of those they differ by less than its credits. A place is the lower
    band, the segment and its credits in one number.
    """
    band = band_of(len(shingles), percent)
    h, place = mix(shingles ^ U(0x2545F4914F6CDD1D)), mix(shingles + U(977))
    out, places = [], []
    for low in range(max(0, band - 1), band + 1):
        segments, twos, _ = plan(low, percent)
        where = (place % U(segments)).astype(np.int64)
        total = np.zeros(segments, np.uint64)
        np.add.at(total, where, h)
        label = mix(np.arange(segments, dtype=np.uint64) + U(low << 32) + U(1))
        own = (low << 40) + (np.arange(segments) << 2) + np.where(np.arange(segments) < twos, 2, 1)
        out.append(mix(total + label))
        places.append(own)
        if twos:  # a full subset and a neighbourhood have one form: either meets the other
            near = where < twos
            out.append(mix(total[where] - h + label[where])[near])
            places.append(own[where[near]])
    return np.concatenate(out), np.concatenate(places)


def _sets(batch, k: int):
    for i, words in documents_words(batch):
        yield i, np.unique(shingles_of(words, k))


def _key(shingles: np.ndarray) -> int:
    """One hash of a set."""
    return int(mix(np.array([np.sum(mix(shingles ^ U(0x1234567)), dtype=np.uint64) + U(len(shingles))], np.uint64)).view(np.int64)[0])


def _classes(k: int):
    """Size and name of each set; the text goes on with the first row of its set in this task alone."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            n, key, new = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for i, own in _sets(batch, k):
                n[i], key[i] = len(own), _key(own) if len(own) else 0
                new[i] = len(own) and int(key[i]) not in seen
                seen.add(int(key[i]))
            text = pa.array(np.arange(batch.num_rows), mask=~new)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "x", "y")], pa.array(n), pa.array(key), batch.column("text").take(text)], names=["doc_id", "x", "y", "n", "key", "text"])

    return run


def _signed(k: int, percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key, sigs, places = [], [], []
            names = batch.column("key").to_numpy()
            for i, own in _sets(batch, k):
                sig, place = signatures(own, percent)
                for column, value in zip((key, sigs, places), (names[i], sig, place)):
                    column.append(value)
                if len(sigs) >= 512:
                    yield _signed_batch(pa, key, sigs, places)
                    key, sigs, places = [], [], []
            if sigs:
                yield _signed_batch(pa, key, sigs, places)

    return run


def _signed_batch(pa, key, sigs, places):
    columns = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(key, np.int64), [len(s) for s in sigs])), pa.array(np.concatenate(places).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["sig", "key", "place"])


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits that are one where an odd number of elements fall, as whole numbers of 64 bits."""
    odd = np.bincount((mix(shingles ^ U(0xA5A5A5A5)) % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _apart(n, m, one: str, two: str, percent: int):
    """Whether sketches leave it open that sets of n and m elements are similar: they differ by (100 - percent) / (100 + percent) of n + m at most."""
    bits = reduce(lambda a, b: a + b, [F.bit_count(F.col(one + c).bitwiseXOR(F.col(two + c))) for c in _BITS])
    return bits * (100 + percent) <= (n + m) * (100 - percent)


def wide_parity(shingles: np.ndarray) -> bytes | None:
    """The same over at least two bits an element, for sets that the short sketch can't tell apart; a power of two, so that it folds."""
    bits = 1 << (2 * len(shingles) - 1).bit_length()
    if bits <= 64 * SKETCH:
        return None
    odd = np.bincount((mix(shingles ^ U(0xA5A5A5A5)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart_bits(one: bytes, two: bytes) -> int:
    """Bits in which two wide sketches differ, the longer one folded to the shorter."""
    a, b = (np.frombuffer(x, np.uint8) for x in sorted((one, two), key=len))
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _plausible(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) but for those of large sets whose wide sketches rule them out. A sketch has a 32nd of its set's bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("wa", "na", "wb", "nb")]
            keep = [wa is None or wb is None or apart_bits(wa, wb) * (100 + percent) <= (na + nb) * (100 - percent) for wa, na, wb, nb in zip(*sides)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one, two = (sets.select(F.col("key").alias(c), F.col("wide").alias(f"w{c}"), F.size("set").cast("long").alias(f"n{c}")).where(f"w{c} is not null") for c in "ab")
    return edges.join(one, "a", "left").join(two, "b", "left").select("a", "wa", "na", "b", "wb", "nb").mapInArrow(run, "a long, b long")


def _arrays(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [own for _, own in _sets(batch, k)]
            cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            sketch = np.array([parity(s) for s in sets], np.int64).reshape(-1, SKETCH)
            columns = [batch.column("key"), pa.ListArray.from_arrays(pa.array(cut), pa.array(values)), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([wide_parity(s) for s in sets], pa.binary())], names=["key", "set", *_BITS, "wide"])

    return run


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the undirected edges (a, b). Large star and small star in turn."""
    e = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large["a"] == low["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        turn += 1
        e = scratch.save(small, f"{name}-{turn}")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        scratch.drop(f"{name}-{turn - 1}")
        if now == state:
            break
        state = now
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _affordable(signed: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The signatures but for those of the segments that each set leaves out: the ones that most sets share, within its allowance.

    With each set's size, and its fame: how many sets it meets over all its segments. The text that the others of a family derive from has the most.
    """
    low = F.shiftright("place", 40)
    skips = F.try_element_at(F.array(*[F.lit(plan(b, percent)[2]) for b in range(len(band_edges(percent)) - 2)]), low.cast("int") + 1)
    segments = signed.groupBy("key", "place").agg(F.sum("met").alias("met")).withColumn("low", low).withColumn("credits", F.col("place").bitwiseAND(3))
    own = Window.partitionBy("key", "low").orderBy(F.desc("met"), "place").rowsBetween(Window.unboundedPreceding, 0)
    out = segments.withColumn("spent", F.sum("credits").over(own)).where(F.col("spent") <= F.coalesce(skips, F.lit(0)))
    fame = segments.groupBy("key").agg(F.sum("met").alias("fame")).join(sizes, "key")
    return signed.join(out.select("key", "place"), ["key", "place"], "left_anti").join(fame, "key").select("sig", "key", "n", "fame")


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar, counted exactly."""
    needed = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).distinct()
    sets = sets.select("key", "set").join(needed, "key", "left_semi")
    one, two = (sets.select(F.col("key").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    both = edges.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(similar(common, F.size("sa").cast("long"), F.size("sb").cast("long"), percent)).select("a", "b")


def text_names(text) -> dict:
    """128 bits that stand for a text."""
    return {"x": F.xxhash64(F.lit(1), text.isNull(), text), "y": F.xxhash64(F.lit(2), text.isNull(), text)}


def _joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, x, y, n, key, root, component_id) of every row: its text's name, set's size and name, component by the name and by the smallest doc_id."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(text_names(F.col("text")))
    named = scratch.save(docs.mapInArrow(_classes(k), "doc_id long, x long, y long, n long, key long, text string"), "named")
    texts = scratch.save_bucketed(named.where("text is not null").select("key", "text"), "texts", "key")  # one for each set; met again below without a shuffle
    classes = scratch.save(named.drop("text"), "classes")
    scratch.drop("named")

    near = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    signed = texts.mapInArrow(_signed(k, percent), "sig long, key long, place long")  # made twice: written, they would take more than all else
    sigs = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    signed = scratch.save(signed.join(scratch.save(sigs, "sigs"), "sig"), "shared")
    scratch.drop("sigs")
    sizes = classes.where("n > 0").groupBy("key").agg(F.first("n").cast("int").alias("n"))
    signed = scratch.save(_affordable(signed, sizes, percent), "signed")
    scratch.drop("shared")
    first = signed.groupBy("sig").agg(F.max(F.struct("fame", "key", "n")).alias("f")).select("sig", F.col("f.key").alias("lo"), F.col("f.n").alias("m"))
    signed = scratch.save(signed.drop("fame").join(scratch.save(first, "centers"), "sig"), "groups")

    sketched = "key long, set array<long>, " + ", ".join(f"{c} long" for c in _BITS) + ", wide binary"
    involved = scratch.save(signed.select("key").distinct(), "involved")
    sets = scratch.save(texts.join(involved, "key", "left_semi").mapInArrow(_arrays(k), sketched), "sets")
    scratch.drop("texts", "involved")
    sketch = lambda key, by: sets.select(F.col("key").alias(key), *[F.col(c).alias(by + c) for c in _BITS])

    met = signed.where((F.col("lo") != F.col("key")) & near).select(F.col("lo").alias("a"), F.col("key").alias("b"), "n", "m").distinct()
    met = met.join(sketch("a", "a"), "a").join(sketch("b", "b"), "b").where(_apart(F.col("n"), F.col("m"), "a", "b", percent))
    stars = scratch.save(_plausible(met.select("a", "b"), sets, percent), "stars")
    links = scratch.save(_verified(stars, sets, percent), "links")
    roots = scratch.save(components(scratch, links, "near"), "roots")

    # groups that still hold several components: pairs across them, but for those already judged
    x = scratch.save(signed.select("sig", "key", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    mixed = x.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    x = scratch.save(x.join(scratch.save(mixed, "mixed"), "sig"), "apart")
    x = x.join(sketch("key", "a"), "key")
    y = x.select("sig", F.col("key").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), *[F.col("a" + c).alias("b" + c) for c in _BITS])
    across = (F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & near & _apart(F.col("n"), F.col("m"), "a", "b", percent)
    x = x.withColumnRenamed("key", "a").withColumnRenamed("sig", "_sig")
    pairs = scratch.save(x.join(y, (F.col("_sig") == F.col("sig")) & across).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")), "pairs")
    pairs = scratch.save(_plausible(pairs.select("a", "b"), sets, percent), "pairs-2")
    links = links.unionByName(scratch.save(_verified(pairs, sets, percent), "links-2"))
    roots = components(scratch, links, "all")

    own = classes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    own = scratch.save(own.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "roots-2")
    named = scratch.save(own.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    own = scratch.save(own.join(named, "root").select("key", "root", "component_id"), "own")
    scratch.drop("signed", "centers", "groups", "sets", "stars", "links", "roots", "rooted", "mixed", "apart", "pairs", "pairs-2", "links-2", "roots-2", "components")
    known = classes.where("n > 0").join(own, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return known.unionByName(classes.where("n = 0").withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")}))


def join_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, key, component_id) of every document; equal keys and sizes: equal sets."""
    return _joined(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "key", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return join_sets(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


STAGE_WORDS, STAGE_PERCENT = 5, 80


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id (nulls last; of the texts of one id, and of the rows of one text, that of the smallest hash).

    Rows without words are in no group and stay.
    """
    found = _joined(docs, STAGE_WORDS, STAGE_PERCENT).select(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "x", "y", "n", "root")
    name = ["_none", "_id", "x", "y"]
    best = found.where("n > 0").groupBy("root").agg(F.min(F.struct(*name)).alias("_b")).select("_b.*", F.lit(True).alias("_once"))
    stays = best.unionByName(found.where("n = 0").select(*name).distinct().withColumn("_once", F.lit(False)))
    stays = Scratch(spark).save(stays, "stays")
    others = [F.col(f.name) for f in docs.schema if f.name != "text" and f.dataType.typeName() not in ("map", "variant")]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*others).alias("_h"), F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), *[c.alias(n) for n, c in text_names(F.col("text")).items()])
    rows = rows.join(stays, name).withColumn("_i", F.row_number().over(Window.partitionBy(*name).orderBy("_h")))
    return rows.where("_i = 1 or not _once").select("_row.*")
