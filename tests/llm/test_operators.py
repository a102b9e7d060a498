"""Each operator against a brute-force version on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat_format, decontaminate, quality, repeats, set_join, sharding, source_mix, toxicity, url_filter, vector_search
from tidewright.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, a hot source."""
    rng = random.Random(4)
    rows, base, passage = [], words(rng, 120), words(rng, 40)
    for i in range(60):
        kind = i % 6
        text = base if kind == 0 else words(rng, rng.randrange(1, 90))
        if kind == 1:
            w = base.split()
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            text = " ".join(w)
        if kind == 2:
            text = f"{text} {passage}\n{text}"
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i}", len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n", "en", None, 3), (103, "one two", "é", "s0", 7), (104, words(rng, 20000, 50), "en", "hot", 1), rows[5], rows[5], (None, base, "en", "s0", 1), (105, "É É é Straße 🎯 " * 30, "de", "s1", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 6 != 1), int(i % 6 == 2)) for i in range(60)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def clashing(df, *names):
    return df.withColumns({n: F.lit("x") for n in names})


def collected(df):
    return [tuple(r) for r in df.collect()]


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, percent):
    sets, parent = [grams(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d if d is not None else 1 << 62)
    return Counter((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_set_join(docs, k, percent):
    got = set_join.join_sets(clashing(docs, "key", "n", "sig"), k, percent).select("doc_id", "n_shingles", "component_id")
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()], k, percent)
    assert Counter(collected(got)) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_meet(percent):
    """Sets that are just similar enough share a signature, even after each leaves out all it may."""
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - drop]], rng.integers(0, 1 << 62, int(rng.integers(0, drop + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) == 0 or not set_join.similar(both, len(a), len(b), percent) or np.array_equal(a, b):
            continue
        kept = []
        for s in (a, b):
            sigs, places = set_join.signatures(s, percent)
            other = set(set_join.signatures(b if s is a else a, percent)[0].tolist())
            out = set()  # the adversary leaves out what the other set shares
            for low in set((places >> 40).tolist()):
                left = set_join.plan(low, percent)[2]
                for place in sorted({p for x, p in zip(sigs.tolist(), places.tolist()) if p >> 40 == low and x in other}):
                    if place & 3 <= left:
                        left -= place & 3
                        out.add(place)
            kept.append({x for x, p in zip(sigs.tolist(), places.tolist()) if p not in out})
        assert kept[0] & kept[1]
        differ = len(a) + len(b) - 2 * both
        assert sum(int(x).bit_count() for x in (set_join.parity(a) ^ set_join.parity(b)).view(np.uint64)) <= differ


def test_set_join_keeps_links_over_odd_ids(spark):
    """A null doc_id links its neighbours; two texts under one doc_id are two sets, in whatever order the rows come."""
    rng = random.Random(21)
    a = words(rng, 60).split()
    change = lambda t, at: " ".join([*t[:at], f"n{at}", *t[at + 1 :]])
    b = change(a, 0)
    c = change(b.split(), 59)
    assert components([(1, " ".join(a)), (3, c)], 4, 95) == Counter([(1, 57, 1), (3, 57, 3)])
    bridge = [(1, " ".join(a)), (None, b), (3, c)]
    twice = [(1, " ".join(a)), (1, words(rng, 50)), (2, b)]
    for rows in (bridge, bridge[::-1], twice, twice[::-1], [(None, t) for _, t in bridge] + [(5, words(rng, 30))]):
        got = set_join.join_sets(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 4, 95).select("doc_id", "n_shingles", "component_id")
        want = Counter((d, n, None if i == 1 << 62 else i) for (d, n, i), k in components(rows, 4, 95).items() for _ in range(k))
        assert Counter(collected(got)) == want


def test_near_duplicate_stage(spark):
    """Rows go by text, not by doc_id: a unique text under a repeated id stays, as do texts without words."""
    rng = random.Random(22)
    a, other, third = words(rng, 60), words(rng, 40), words(rng, 30)
    rows = [(1, a, "en", "s", 1), (7, a, "en", "s", 1), (7, other, "en", "s", 2), (None, a + " more", "en", "s", 3), (None, third, "en", "s", 4), (4, "", "en", "s", 5), (4, "", "de", "s", 5), (5, None, None, None, None), (1, a, "en", "s", 1), (1, a, "de", "s", 1)]
    got = clashing(spark.createDataFrame(rows, DOCS), "x", "_row", "root")
    kept = collected(set_join.stage(spark, got, "").select("doc_id", "text", "n_chars"))
    assert Counter(kept) == Counter([(1, a, 1), (7, other, 2), (None, third, 4), (4, "", 5), (4, "", 5), (5, None, None)])
    assert set_join.stage(spark, got, "").columns == got.columns and set_join.stage(spark, got.limit(0), "").count() == 0


def test_every_band_has_a_plan():
    for percent in (80, 85):
        edges = set_join.band_edges(percent)
        assert edges[-1] >= 1 << 40 and all(set_join.plan(b, percent)[0] > 0 for b in range(len(edges) - 2))


def test_wide_sketches_never_part_similar_sets():
    """They differ in no more bits than the sets in elements, whatever their sizes, and tell unlike large sets apart."""
    rng = np.random.default_rng(8)
    for n, m in ((600, 600), (5000, 5200), (3000, 4200), (40000, 33000)):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], rng.integers(0, 1 << 62, max(1, m - int(0.9 * n))).astype(np.uint64)]))
        differ = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert set_join.apart_bits(set_join.wide_parity(a), set_join.wide_parity(b)) <= differ
        c = np.unique(rng.integers(0, 1 << 62, m).astype(np.uint64))
        assert set_join.apart_bits(set_join.wide_parity(a), set_join.wide_parity(c)) * 185 > (len(a) + len(c)) * 15
    assert set_join.wide_parity(np.arange(500, dtype=np.uint64)) is None


def test_set_join_of_long_texts(spark):
    rng = random.Random(61)
    base = words(rng, 4000, 10**6).split()
    rows = [(0, " ".join(base)), (1, " ".join(base[:-60])), (2, words(rng, 4000, 10**6)), (3, " ".join(base[:3000] + words(rng, 900, 10**6).split())), (4, " ".join(base[2000:]) + " " + words(rng, 2100, 10**6))]
    got = set_join.join_sets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert Counter(collected(got)) == components(rows, 4, 85)


def test_set_join_of_nothing(spark):
    assert set_join.join_sets(spark.createDataFrame([], DOCS)).count() == 0


def cut_by_hand(rows, length):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0] if rows[i][0] is not None else 1 << 62)
    starts = defaultdict(lambda: 1 << 63)
    for i in order:
        b, d = (rows[i][1] or "").encode(), rows[i][0] if rows[i][0] is not None else (1 << 63) - 1
        for p in range(len(b) - length + 1):
            starts[b[p : p + length]] = min(starts[b[p : p + length]], d)
    for doc_id, text in rows:
        b, d = (text or "").encode(), doc_id if doc_id is not None else (1 << 63) - 1
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowd", [1, 2, 3, 8, 30, 10**6])
def test_repeats(docs, crowd):
    got = repeats.cut_repeats(clashing(docs, "h", "d", "x"), crowd=crowd)
    assert Counter(collected(got)) == cut_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], 50)


@pytest.mark.parametrize("size", [2, 3, 7, 40, 200])
def test_repeats_of_groups(spark, size):
    """A line shared by ``size`` texts, in ever different and in equal surroundings, within a text and across, around every threshold."""
    rng = random.Random(size)
    line, tail = words(rng, 12), words(rng, 9)
    rows = [(i, "\n".join(f"{words(rng, 3)} {line} {tail if i % 3 else words(rng, 4)}" for _ in range(1 + i % 4))) for i in range(size)]
    rows += [(0, rows[-1][1]), (size, line * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = cut_by_hand(rows, 50)
    for crowd in (4, 64):
        assert Counter(collected(repeats.cut_repeats(frame, crowd=crowd))) == want


def test_repeats_of_a_whole_table(spark):
    """Every document of the smallest table, by the definition: many clean documents truly share a line of 50 bytes or more."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = cut_by_hand([tuple(r) for r in docs.collect()], 50)
    assert Counter(collected(repeats.cut_repeats(docs))) == want and sum(r[2] > 0 for r in want) > 0


def test_anchors_of_chance():
    """Strings of 16 to 32 bytes that texts share without a window of 50 give no shared name; every shared window does."""
    rng = random.Random(5)
    few = [words(rng, 6, 10**6)[:24] for _ in range(40)]
    texts = [" ".join(f"{rng.choice(few)} {words(rng, 2, 10**9)}" for _ in range(60)).encode() for _ in range(30)]
    named = []
    for t in texts:
        place, name, first, last, _ = repeats.anchors_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 50)
        at = {s: (int(n), int(p - s)) for p, n, f, la in zip(place, name, first, last) for s in range(f, la + 1)}
        assert sorted(at) == list(range(len(t) - 49)) and all(0 <= back <= repeats.reach_of(50) for _, back in at.values())
        named.append(at)
    names = Counter(n for at in named for n in {n for n, _ in at.values()})
    assert max(names.values()) == 1
    whole = defaultdict(set)
    for t, at in zip([*texts, b"x" * 7 + texts[0][100:300]], [*named, None]):
        if at is None:
            place, name, first, last, _ = repeats.anchors_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 50)
            at = {s: (int(n), int(p - s)) for p, n, f, la in zip(place, name, first, last) for s in range(f, la + 1)}
        for s, found in at.items():
            whole[t[s : s + 50]].add(found)
    assert all(len(found) == 1 for found in whole.values()) and len(whole) < sum(len(at) for at in named) + 158


def test_hot_names_are_summed_once(monkeypatch):
    """Of a name that many texts hold, one row is ranked for all that are counted at once."""
    h, x = np.repeat([7, 8, 9], [40, 2, 1]).astype(np.int64), np.array([*range(20), *range(20), 1, 2, 3], np.int64)
    rows = [tuple(r.values()) for r in repeats._counted(h, x).to_pylist()]
    assert sorted(r[:3] for r in rows if r[3] == repeats.MEMBER) == [(7, i, 2) for i in range(20)]
    assert [(r[0], r[2]) for r in rows if r[3] == repeats.SUM] == [(7, 40)] and sorted(r[:3] for r in rows if r[3] == repeats.PLAIN) == [(8, 1, 1), (8, 2, 1), (9, 3, 1)]


@pytest.mark.parametrize("hot", [1, 3])
def test_repeats_with_hot_names(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "NAMED", 500)
    for crowd in (2, 30):
        assert Counter(collected(repeats.cut_repeats(docs, crowd=crowd))) == cut_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], 50)


def test_merge_settles_only_equal_bytes():
    """Anchors whose surroundings differ are never merged, even under one name; those of the same d stay open."""
    n = 6
    held = np.zeros((n, 84), np.uint8)
    held[3] = 1
    h, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int32), np.full(n, 34, np.int32)
    d, x, a = np.array([5, 5, 7, 8, 5, 9]), np.array([1, 1, 2, 3, 4, 5]), np.array([0, 9, 0, 0, 0, 0], np.int32)
    order, owner, settled = repeats.merge(h, d, x, a, lo, hi, held)
    got = {int(o): (int(order[w]), bool(s)) for o, w, s in zip(order, owner, settled)}
    assert got == {0: (0, False), 1: (0, False), 2: (2, True), 3: (3, False), 4: (4, False), 5: (5, True)}


def test_repeats_of_nothing(spark):
    assert repeats.cut_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding(spark, docs):
    n = docs.count()
    got = sharding.external_shuffle(clashing(docs, "shard", "slot", "a", "b", "row", "copy", "times", "bucket", "_a", "_times", "odd ` name"), 7, bucket_rows=8)
    rows = got.collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(collected(docs)) and {tuple(r)[5:-2] for r in rows} == {("x",) * 9}
    got = sharding.external_shuffle(docs, 7, bucket_rows=8)
    rows = got.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and n == len(rows)
    again = sharding.external_shuffle(docs.repartition(3, "lang"), 7, bucket_rows=8)
    assert Counter(collected(got)) == Counter(collected(again))
    assert sharding.external_shuffle(spark.createDataFrame([], DOCS)).count() == 0


def test_sharding_of_long_texts(spark):
    """Buckets are cut by bytes too: texts of 20 MB do not meet 512 to a bucket."""
    assert sharding.buckets_for(100_000, 100_000 * (20 << 20)) >= 100_000 and sharding.buckets_for(10, 100) == 1 and sharding.buckets_for(0, 0) == 1
    rows = spark.range(12).select(F.col("id").alias("doc_id"), F.expr("repeat(cast(id as string), 20 * 1024 * 1024)").alias("text"))
    got = sharding.sharded(rows, n_shards=5).select("doc_id", F.length("text").alias("n"), "shard", "slot").collect()
    assert sorted((r["doc_id"], r["n"] // len(str(r["doc_id"]))) for r in got) == [(i, 20 << 20) for i in range(12)]
    assert sorted(Counter(r["shard"] for r in got).values()) == [2, 2, 2, 3, 3]


def test_sharding_is_this_permutation(spark):
    """The permutation by hand: buckets by hash, order in a bucket by hash, Fisher-Yates by drawn hashes, cut into shards."""
    rows = [(i, f"t{i % 40}") for i in range(60)] + [(3, "t3")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    n_buckets, total = sharding.buckets_for(len(rows), 0, 8), len(rows)
    named = frame.select("*", F.xxhash64(F.lit(sharding.SEED), "doc_id", "text").alias("a"), F.xxhash64(F.lit(sharding.SEED + 1), "doc_id", "text").alias("b"))
    seen, records = Counter(), []
    for r in named.collect():
        seen[r["a"], r["b"]] += 1
        records.append((r["a"], r["b"], seen[r["a"], r["b"]], r["doc_id"], r["text"]))
    hashed = spark.createDataFrame(records, "a long, b long, c long, doc_id long, text string").select("*", F.xxhash64(F.lit(sharding.SEED + 2), "a", "b", "c").alias("h")).collect()
    buckets = defaultdict(list)
    for r in hashed:
        buckets[r["h"] % n_buckets].append((r["h"], r["a"], r["b"], r["c"], r["doc_id"], r["text"]))
    draws = spark.range(n_buckets).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(60))).alias("i")).select("k", "i", F.pmod(F.xxhash64(F.lit(sharding.SEED + 3), "k", "i"), F.col("i") + 1).alias("j"))
    draw = {(r["k"], r["i"]): r["j"] for r in draws.collect()}
    order = []
    for k in range(n_buckets):
        own, done = sorted(buckets[k]), []
        for i, row in enumerate(own):
            done.append(row)
            j = draw[k, i]
            done[i], done[j] = done[j], done[i]
        order += done
    want, shards = [], [at * 7 // total for at in range(total)]
    for at, row in enumerate(order):
        want.append((row[4], row[5], shards[at], at - shards.index(shards[at])))
    got = sharding.external_shuffle(frame, 7, bucket_rows=8, bucket_bytes=1 << 30)
    assert Counter(collected(got)) == Counter(want)


def shuffled(spark, run):
    """MB that the stages of run() write to shuffles, from the status store."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    none = [jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()]

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(*none)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before) / 1e6


def test_sharding_shuffles_whole_rows_once(spark, tmp_path):
    """Rows that occur once are shuffled once; what was needed besides the shards is deleted."""
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(20)])
    spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    whole = shuffled(spark, lambda: rows.repartition(4, "doc_id").write.parquet(str(tmp_path / "whole")))
    assert whole > 2 and shuffled(spark, lambda: sharding.sharded(rows)) < 1.3 * whole
    assert [p.name for p in Path(Scratch.opened[-1].base).iterdir()] == ["shards"]


@pytest.mark.parametrize("words", [1, 2, sharding.WORDS])
def test_sharding_counts_rows_marked_by_chance(spark, docs, words):
    """However few marks there are, and if all rows, some or none are repeated, the result is that of the full bitmap."""
    for rows in (docs, docs.union(docs.where("doc_id % 3 = 0")), docs.union(docs)):
        got = collected(sharding.external_shuffle(rows, 7, bucket_rows=8, words=words))
        assert Counter(r[:-2] for r in got) == Counter(collected(rows))
        assert Counter(got) == Counter(collected(sharding.external_shuffle(rows, 7, bucket_rows=8)))
        by = Counter(r[-2] for r in got)
        assert {r[-2:] for r in got} == {(shard, slot) for shard, n in by.items() for slot in range(n)} and max(by.values()) - min(by.values()) <= 1


def test_sharding_writes(docs, tmp_path, spark):
    sharding.write_shards(sharding.external_shuffle(docs, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_sharding_query_writes_whole_documents(spark):
    """The shards that the query writes hold every column of every document, and its digests are theirs."""
    folder = "/root/testdata/sf0.001"
    got = sharding.query(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    written = spark.read.parquet(f"{Scratch.opened[-1].base}/shards")
    assert set(written.columns) == {*docs.columns, "shard", "slot"}
    assert Counter(collected(written.select(*docs.columns))) == Counter(collected(docs))
    held = {r["doc_id"]: (r["text"] or "").encode() for r in written.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got.collect()} == {(d, len(t) + 16, zlib.crc32(t)) for d, t in held.items()}


def mixed_by_hand(rows, weights=(1, 2, 3), cap=3):
    size = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for d, t, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values())
    target, left, open_ = {}, float(total), set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w >= cap * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= full
    return sizes, target


def test_source_mix(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    sizes, target = mixed_by_hand(rows)
    got = source_mix.fair_mix(clashing(docs, "target", "taken", "_key", "_row", "_bucket")).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= sum(sizes.values())
    most = {s: max((len((t or "").encode().split()) for _, t, x in rows if x == s), default=0) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= most[s] for s in sizes)
    assert source_mix.fair_mix(spark.createDataFrame([], DOCS)).count() == 0


def test_decontaminate(spark, docs):
    items = [(0, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (1, "alpha beta"), (2, None), (3, ""), (None, words(random.Random(9), 30))]
    planted = [(200, f"x y z {items[0][1].upper()} q r"), (201, "say alpha beta now"), (202, items[4][1]), (203, items[4][1].replace(items[4][1].split()[0], "changed", 1)), (204, "w1 w2 w3 w4 w5 w6")]
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], m["item_id"]) for r in decontaminate.scan(clashing(all_docs, "matches", "found", "_found", "odd ` name"), item_frame).collect() for m in r["matches"]}
    want = set()
    for r in all_docs.collect():
        for item, text in items:
            w, u = (r["text"] or "").encode().lower().split(), (text or "").encode().lower().split()
            if not u or len(w) < min(5, len(u)):
                continue
            k = min(5, len(u))
            count = lambda x: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))  # noqa: B023, E731
            for a in range(max(1, len(w) - len(u) + 1)):
                x, y = count(w[a : a + len(u)]), count(u)
                if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                    want.add((r["doc_id"], item))
    assert found == want and {(200, 0), (201, 1), (202, None), (203, None)} <= found
    assert {(r["doc_id"], m["item_id"]) for r in decontaminate.scan(all_docs, item_frame, item_words=3).collect() for m in r["matches"]} == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, none).where(F.size("matches") > 0).count() == 0


def test_hamming_blocks_are_complete():
    rng = np.random.default_rng(3)
    index = decontaminate.Index(9, [(i, rng.integers(0, 1 << 62, 5).astype(np.uint64)) for i in range(50)])
    flips = np.zeros(2000, np.uint64)
    for j in range(2000):
        for b in rng.choice(64, rng.integers(0, 24), replace=False):
            flips[j] |= np.uint64(1) << np.uint64(b)
    prints = index.prints[rng.integers(0, 50, 2000)] ^ flips
    window, item, distance = index.near(prints)
    want = {(w, i) for w in range(2000) for i in range(50) if int(prints[w] ^ index.prints[i]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(window.tolist(), item.tolist())) == want


def test_chat_format(spark):
    rows = []
    for c, turns in {1: "ab", 2: "abc", 3: "abc", 4: "abx", 5: "b", 6: "bb", 7: "c"}.items():
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]
    rows += [(None, 0, None, None), (8, None, "user", "q"), (8, 0, "user", "z"), (9, 0, "user", ""), (9, 0, "user", "")]
    rows += [(10, i, "user", str(i)) for i in range(50)]
    chats = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "n", "part")
    got = {(r["conv_id"], r["part"]): r for r in chat_format.format_chats(chats, part_turns=30).collect()}
    assert {c for c, _ in got} == {2, 4, 6, 7, 8, 9, 10, None}
    assert got[2, 0]["n_copies"] == 2 and got[2, 0]["text"].count("<|im_start|>") == 3 and got[10, 1]["n_turns"] == 50
    assert got[None, 0]["text"] == "<|im_start|>unknown\n<|im_end|>\n" and got[8, 0]["text"].startswith("<|im_start|>user\nq")
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_chat_format_tells_null_from_the_word(spark):
    rows = [(None, 0, "user", "a"), ("null", 0, "user", "b"), ("=null", 0, "user", "c"), ("", 0, "user", "d")]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {r["conv_id"] for r in got} == {None, "null", "=null", ""} and all(r["n_turns"] == 1 for r in got)


def test_chat_format_against_sql(spark):
    """Nulls, repeated turn numbers, copies, and a conversation beyond one part: the operator and its SQL agree."""
    import duckdb

    rng = random.Random(31)
    rows = [(1, i, "user", f"t{i}") for i in range(chat_format.BLOCK + 700)] + [(2, i, "user", f"t{i}") for i in range(chat_format.BLOCK + 3)]
    for c in range(3, 40):
        rows += [(c, rng.choice([i, i, 0, None]), rng.choice(["user", "assistant", None]), rng.choice(["x", "y", "", None])) for i in range(rng.randrange(1, 4))]
    rows += [(None, 0, None, None), (None, 1, "user", "q"), (50, 0, None, None), (51, 0, "unknown", "")]
    rows += [(60, None, "user", f"t{i % 90}") for i in range(300)] + [(61, 5, "user", "same")] * 300  # no order but that of the texts, or none
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", chats.toArrow())
    names = ["conv_id", "part", "n_turns", "n_copies", "text"]
    assert Counter(collected(chat_format.format_chats(chats).select(*names))) == Counter(con.sql(chat_format.SQL).select(", ".join(names)).fetchall())


URLS = [
    ("http://A.Example.ORG/es/1?x=1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org/en/1", "block"), ("https://a.org/x", "org/", "allow"), ("https://b.example.com/fr/9#t", "com/fr/", "allow"),
    ("https://example.com/de/", "com/de/", "block"), ("https://example.org", None, None), ("nothing", None, None), (None, None, None), ("https://x.net/es/4", None, None), ("https://myexample.org/es/1", "org/", "allow"), ("a://b://c/d", None, None),
]


def test_url_filter(spark):
    rows = [(i, u, "h") for i, (u, _, _) in enumerate(URLS)] + [(100 + i, f"https://s{i % 7}.example.{t}/{g}/{i}", "h") for i in range(60) for t in ("org", "com") for g in ("es", "fr", "de", "en")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "host", "verdict")).collect() if r["page_id"] < 100}
    for i, (url, rule, verdict) in enumerate(URLS):
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict), url
    assert (got[0]["host"], got[0]["path"]) == ("a.example.org", "/es/1") and (got[6]["host"], got[6]["path"]) == ("", "") and (got[10]["host"], got[10]["path"]) == ("b:", "//c/d")
    assert got[8]["verdict"] == "block" and got[8]["mined"] == "seg=es" and got[7]["verdict"] == "allow"
    unlabelled = spark.createDataFrame([(1, "https://x.net/a")], "page_id long, url string")
    assert url_filter.filter_urls(unlabelled).first()["verdict"] == "allow" and url_filter.filter_urls(unlabelled.limit(0)).count() == 0


def test_url_tokens_are_all_parts(spark):
    url = "HTTPS://A.b.example.org/en/x.y/en/f.HTML?q=1&q=2&r=&flag#top"
    x = spark.createDataFrame([(url,), (None,), ("nothing",)], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    got = [r[0] for r in x.select(url_filter.tokens(F.col("url"), host, path)).collect()]
    want = "scheme=HTTPS label=a label=b label=example label=org seg=en seg=x.y seg=f.HTML ext=HTML key=q key=r key=flag arg=q=1 arg=q=2 arg=r= fragment=top"
    assert got == [sorted(want.split()), [], []]


def test_url_choice_against_brute_force(spark):
    """Each url that no curated rule fits gets the strongest of all rules over all combinations of its tokens; clashing columns stay."""
    from itertools import combinations

    rng = random.Random(41)
    host = lambda: rng.choice(["a.example.org", "b.example.org", "example.org", "x.example.com", "y.net", "a.net"])
    urls = [f"https://{host()}/{rng.choice(['es', 'fr', 'de', 'en'])}/{rng.choice(['1', '2', ''])}{rng.choice(['', '?p=1', '?p=2', '#t'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, f"own {i}", i) for i, u in enumerate(urls)], "page_id long, url string, tokens string, says long")
    h, p = url_filter.host_and_path(F.col("url"))
    held = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_filter.tokens(F.col("url"), h, p).alias("t")).collect()}
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, min_support=0.01).collect()}
    says = dict(url_filter.RULES)
    known = [(held[i], says[r["rule"]]) for i, r in got.items() if r["rule"]]
    for i, r in got.items():
        assert (r["tokens"], r["says"]) == (f"own {i}", i)
        if r["rule"]:
            continue
        best = None
        for n in range(1, len(held[i]) + 1):
            for items in combinations(sorted(held[i]), n):
                met = [v for t, v in known if set(items) <= t]
                for v in set(met):
                    if met.count(v) >= max(0.01 * len(known), url_filter.MIN_ROWS) and met.count(v) / len(met) >= url_filter.MIN_CONFIDENCE:
                        rank = (met.count(v) / len(met), met.count(v) / len(known), -n, v, " ".join(items))
                        best = max(best, rank) if best else rank
        assert (r["mined"], r["verdict"]) == ((best[4].replace(" ", " & "), best[3]) if best else (None, "allow"))


def ordinary(rng, i):
    """A url of some 19 tokens, like those of a shop or a forum."""
    extra = "".join(f"&{k}={rng.randrange(3)}" for k in ("utm_source", "utm_medium", "page", "sort", "lang") if rng.random() < 0.7)
    return f"https://www.s{rng.randrange(4)}.site.org/{rng.choice(['fr', 'es', 'en'])}/p{rng.randrange(6)}/x{rng.randrange(4)}/y0/index.html?utm_campaign=1{extra}#top"


def test_url_long_urls_change_no_support(spark):
    """Rules of up to two items over urls of up to 19 tokens, whatever one odd url holds, against all pairs of tokens by brute force."""
    from itertools import combinations

    rng = random.Random(7)
    urls = [ordinary(rng, i) for i in range(1500)]
    says = ["block" if "/p1/" in u or ("sort=1" in u and "/x2/" in u) else "allow" for u in urls]
    odd = "https://example.org/" + "/".join(f"seg{j}" for j in range(25)) + "?" + "&".join(f"k{j}={j}" for j in range(25))
    for more in ([], [odd]):
        frame = spark.createDataFrame(list(zip(urls + more, says + ["allow"] * len(more))), "url string, verdict string")
        host, path = url_filter.host_and_path(F.col("url"))
        labelled = frame.select(url_filter.tokens(F.col("url"), host, path).alias("tokens"), "verdict")
        rows = [(set(r["tokens"]), r["verdict"]) for r in labelled.collect()]
        least = math.ceil(0.02 * len(rows))
        known = url_filter.frequent(labelled, least)
        held = defaultdict(set)
        for k, (t, _) in enumerate(rows):
            for token in t:
                held[token].add(k)
        assert set(known) == {t for t, k in held.items() if len(k) >= least}
        for t, first in known.items():
            assert first == min(o for o in known if held[o] == held[t])
        assert len(set(known.values())) < len(known)
        items = sorted(set(known.values()))
        want = {}
        for n in (1, 2):
            for c in combinations(items, n):
                both = set.intersection(*[held[t] for t in c])
                for v in ("allow", "block"):
                    met = sum(rows[k][1] == v for k in both)
                    if met >= least and met / len(both) >= 0.8:
                        want[c, v] = (met / len(both), met / len(rows))
        found = url_filter.mine(labelled.withColumn("tokens", url_filter.as_items("tokens", known)), 0.02, 0.8, longest=2, abreast=6)
        got = {(tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in found.collect()}
        assert got == want
        left = {(tuple(r["antecedent"]), r["verdict"]) for r in url_filter.pruned(found).collect()}
        assert left == {(c, v) for (c, v), (conf, _) in want.items() if not any((t,) != c and ((t,), v) in want and want[(t,), v][0] >= conf for t in c)}


def test_url_one_odd_url_changes_no_verdict(spark):
    rng = random.Random(9)
    rows = [(i, f"https://a{i % 5}.example.{rng.choice(['org', 'com'])}/{rng.choice(['es', 'fr', 'de', 'en'])}/{i % 7}") for i in range(800)]
    rows += [(1000 + i, f"https://x{i % 3}.net/{g}/{i % 7}") for i, g in enumerate(["es", "fr", "de", "en"] * 5)]
    odd = (-1, "https://example.org/es/" + "/".join(f"seg{j}" for j in range(30)) + "?" + "&".join(f"k{j}={j}" for j in range(30)))
    verdicts = [{r["page_id"]: (r["verdict"], r["mined"]) for r in url_filter.filter_urls(spark.createDataFrame(x, "page_id long, url string")).where("page_id >= 0").collect()} for x in (rows, [*rows, odd])]
    assert verdicts[0] == verdicts[1] and len({v for v, _ in verdicts[0].values()}) == 2


def test_url_query_that_all_repeat(spark):
    """A query of thirty keys that every third url repeats is one item."""
    same = "&".join(f"k{j}" for j in range(30))
    rows = [(i, f"https://example.org/{'es' if i % 4 else 'xx'}/{i}" + (f"?{same}" if i % 3 == 0 else "")) for i in range(300)]
    got = url_filter.filter_urls(spark.createDataFrame([*rows, (-1, "https://y.net/es/")], "page_id long, url string")).where("page_id = -1").first()
    assert (got["mined"], got["verdict"]) == ("seg=es", "block")


def test_url_rules_count_all_labelled_rows(spark):
    """More than a million labelled rows: confidence is the share among all of them, whichever url repeats."""
    ids = spark.range(1_200_000).withColumnRenamed("id", "page_id")
    url = F.when(F.col("page_id") % 3 == 0, "https://a.example.org/es/1").when(F.col("page_id") % 10 == 1, F.concat(F.lit("https://example.org/en/12?q="), "page_id")).otherwise(F.concat(F.lit("https://example.org/en/2?q="), "page_id"))
    asked = spark.createDataFrame([(-1, "https://x.net/en/")], "page_id long, url string")
    got = url_filter.filter_urls(ids.withColumn("url", url).unionByName(asked)).where("page_id = -1").first()
    blocked = sum(i % 3 != 0 and i % 10 == 1 for i in range(1_200_000))
    assert (got["verdict"], got["mined"]) == ("allow", "seg=en") and got["confidence"] == 1 - blocked / 800_000


def test_mined_rules_against_counts(spark):
    rng = random.Random(2)
    rows = [(sorted(t for t in "abcd" if rng.random() < 0.5), rng.choice(["allow", "block"]) if rng.random() < 0.3 else "allow") for _ in range(200)]
    rows = [(t, "block" if "a" in t and "b" in t else v) for t, v in rows]
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8).collect()}
    want = {}
    for mask in range(1, 16):
        items = [t for i, t in enumerate("abcd") if mask >> i & 1]
        held = [v for t, v in rows if set(items) <= set(t)]
        for v in ("allow", "block"):
            n = held.count(v)
            if held and n >= 0.02 * len(rows) and n / len(held) >= 0.8:
                want[tuple(items), v] = n / len(held)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    x = [(int(i), [float(v) for v in rng.normal(size=8) + 4 * (i % 3)]) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    bad = [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] + [1.0] * 7), (5300, [None] + [1.0] * 7), (5400, [float("inf")] * 8), (5500, [1.0]), (None, [1.0] * 8)]
    df = clashing(spark.createDataFrame(x + bad, "vec_id long, embedding array<float>"), "list", "rank")
    got = defaultdict(list)
    for r in vector_search.search(df, F.col("vec_id") % 50 == 0, block_rows=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, v = np.array([i for i, _ in x]), np.array([e for _, e in x], np.float32).astype(float)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:10]
        mine = got.pop(int(ids[q]))
        assert len(mine) == 10 and all(abs(s - d[np.searchsorted(ids, i)]) < 1e-12 for i, s in mine)
        hits += len({i for i, _ in mine} & {int(ids[j]) for j in order})
        total += 10
    assert not got and hits >= 0.9 * total
    few = vector_search.search(df.where("vec_id in (0, 1, 50)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and vector_search.search(df.limit(0), F.lit(True)).count() == 0


def test_scan_finds_copies_of_the_query():
    """Rotated coordinates of equal vectors differ by rounding; that must not count as a distance beyond a limit of 0."""
    rng = np.random.default_rng(11)
    for scale in (1.0, 1e-6, 1e6):
        v = rng.normal(size=(60, 64)) * scale
        v[::2] = v[0]
        turn, ids = vector_search.rotation(64), np.arange(60)
        block = vector_search.Block(np.zeros(60, int), ids, ids, v, v @ turn)
        for limit in (np.inf, 0.0):
            q, found, whole = vector_search.search_block(block, [np.array([0])], ids[:1], v[:1], v[:1] @ turn, np.array([limit]), 10)
            assert found.tolist() == list(range(2, 22, 2)) and not whole.any() and not q.any()


def test_scan_abandons_early():
    """With the limit that runs on, well under half of the coordinates of far candidates are computed, and hardly a neighbour is lost."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    lists, ids, turn = np.sort(rng.integers(0, 100, 4000)), np.arange(4000), vector_search.rotation(64)
    block = vector_search.Block(lists, ids, ids, v, v @ turn)
    asked = [np.arange(100)] * 40
    d = ((v[:40, None] - v[None]) ** 2).sum(2)
    d[np.arange(40), np.arange(40)] = np.inf
    q, found, _ = vector_search.search_block(block, asked, ids[:40], v[:40], v[:40] @ turn, 1.06 * np.sort(d, axis=1)[:, 9], 10)
    hits = sum(len(set(np.argsort(d[i])[:10]) & set(found[q == i])) for i in range(40))
    assert block.scanned < 0.5 * block.pairs * 64 and hits >= 0.95 * 400


def test_vector_search_of_repeated_ids(spark):
    """Rows of one id are queries and candidates of their own, whatever the blocks of rows and queries."""
    x = [(0, [0.0, 1.0]), (0, [0.0, 3.0]), (1, [0.0, 1.5]), (2, [0.0, 2.8]), (3, [9.0, 9.0])]
    frame = spark.createDataFrame(x, "vec_id long, embedding array<float>")
    for rows in (1, 4096):
        got = vector_search.search(frame, F.col("vec_id") == 0, k=2, block_rows=rows).collect()
        assert Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in got) == Counter([(0, 1, 1, 0.5), (0, 2, 2, 1.8), (0, 1, 2, 0.2), (0, 2, 1, 1.5)])


def test_vector_search_of_copies(spark):
    """A third of all rows are one vector: each of them has ten neighbours at distance 0."""
    rng = np.random.default_rng(12)
    common = rng.normal(size=64)
    x = [(i, [float(v) for v in (common if i % 3 == 0 else rng.normal(size=64))]) for i in range(600)]
    rows = vector_search.search(spark.createDataFrame(x, "vec_id long, embedding array<float>"), F.col("vec_id") % 60 == 0, block_rows=128).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: [(i, 0.0) for i in range(0, 600, 3) if i != q][:10] for q in range(0, 600, 60)}


def test_toxicity(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        rows.append((i, words(rng, rng.randrange(5, 60)) + (f" {rng.choice(['Dolt', 'oaf,', 'CAD'])} " if toxic else " ") + words(rng, 5)))
        marks.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "oaf"), rows[3]]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(clashing(d, "score", "odd ` name"), toxicity.fit(d, lab)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)
    nothing = toxicity.score(d, toxicity.fit(d, lab.limit(0))).collect()
    assert {round(r["score"], 6) for r in nothing} == {0.5} and toxicity.score(d.limit(0), toxicity.fit(d, lab)).count() == 0


def test_scores_are_the_machine_by_hand(spark):
    """w0 + the weights + the products of all pairs of the terms that a text holds, each once."""
    rng = random.Random(71)
    texts = [words(rng, rng.randrange(0, 30), 30) for _ in range(80)] + [None, "", "w1 W1 w1"]
    terms = lambda t: set(toxicity._terms(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tolist()) if t else set()
    places = np.array(sorted(set().union(*map(terms, texts)))[::2], np.int32)
    g = np.random.default_rng(3)
    machine = {"w0": -0.3, "places": places, "w": g.normal(size=len(places)).astype(np.float32), "v": g.normal(0, 0.3, (len(places), 4)).astype(np.float32)}
    at = {int(p): i for i, p in enumerate(places)}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), machine).collect()}
    for i, t in enumerate(texts):
        own = [at[p] for p in terms(t) if p in at]
        total = -0.3 + sum(float(machine["w"][a]) for a in own) + sum(float(machine["v"][a].astype(float) @ machine["v"][b].astype(float)) for n, a in enumerate(own) for b in own[:n])
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-4


def test_toxicity_on_rows_that_no_fit_saw(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    rows = toxicity.score(d, toxicity.fit(d, lab)).where("held_out").join(lab, "doc_id").select("predicted", "toxic").collect()
    assert len(rows) > 500 and sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)
    met = sum(r["predicted"] == 1 == r["toxic"] for r in rows)
    assert met >= 0.85 * sum(r["toxic"] == 1 for r in rows) and met >= 0.9 * sum(r["predicted"] == 1 for r in rows)


def test_machine_learns_pairs():
    """1 with 2 and 3 with 4 are toxic, 1 with 4 and 3 with 2 are not: out of reach of additive weights."""
    rng = np.random.default_rng(0)
    pairs = [(1, 2), (3, 4), (1, 4), (3, 2), (), ()]
    rows = [np.array([*pairs[i], 9], np.int32) for i in rng.integers(0, 6, 3000)]
    y = np.array([float({1, 2} <= set(r.tolist()) or {3, 4} <= set(r.tolist())) for r in rows])
    machine = toxicity.fit_machine(y, rows)
    place = {int(p): i for i, p in enumerate(machine["places"])}

    def predicted(r):
        at = [place[p] for p in r.tolist() if p in place]
        v = machine["v"][at].astype(float)
        return machine["w0"] + machine["w"][at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()) >= 0

    assert np.mean([predicted(r) == t for r, t in zip(rows, y)]) > 0.95


@pytest.mark.parametrize("noise", [0, 20])
def test_machine_learns_pairs_without_marginals(noise):
    """Each member of a pair is as frequent in clean rows as in toxic ones; other terms carry no signal."""
    rng = np.random.default_rng(1)
    pairs = [(1, 2), (3, 4), (1, 4), (3, 2)]
    kind = rng.integers(0, 4, 5000)
    rows = [np.unique(np.array([*pairs[i], *rng.integers(9, 209, noise)], np.int32)) for i in kind]
    y = (kind < 2).astype(float)
    machine = toxicity.fit_machine(y[:4000], rows[:4000])
    place = {int(p): i for i, p in enumerate(machine["places"])}

    def predicted(r):
        at = [place[p] for p in r.tolist() if p in place]
        v = machine["v"][at].astype(float)
        return machine["w0"] + machine["w"][at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()) >= 0

    assert np.mean([predicted(r) == t for r, t in zip(rows[4000:], y[4000:])]) > 0.95


def test_quality(spark, docs, labels):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(["spam"] * 40) if bad and i % 8 else words(rng, 50).upper().replace(" ", "!! ") if bad else words(rng, rng.randrange(3, 80))
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        marks.append((i, int(not bad), 0))
    rows += [(700, None, None, None, None), (701, "", "en", None, -1), rows[1]]
    d, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id long, quality int, toxic int")
    got = quality.score(clashing(d, "score", "keep", "odd ` name"), quality.fit(d, lab)[0]).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r["doc_id"] < 600 and r["doc_id"] % 3 == 0]
    assert sum(r["keep"] == (r["doc_id"] % 4 != 0) for r in known) >= 0.95 * len(known)
    model, found = quality.fit(d, lab)
    again = {(r["doc_id"], r["score"], r["keep"]) for r in quality.score_statistics(found, model).collect()}
    assert again == {(r["doc_id"], r["score"], r["keep"]) for r in got}
    nothing = quality.score(d, quality.fit(d, lab.limit(0))[0]).collect()
    assert {r["score"] for r in nothing} == {0.5} and quality.score(d.limit(0), quality.fit(d, lab)[0]).count() == 0
    assert quality.score(d, quality.fit(d.limit(0), lab)[0]).count() == len(rows)


def test_co_training_exchanges():
    rng = np.random.default_rng(6)
    y = (rng.random(400) < 0.5).astype(float)
    view = lambda z, noise: (z + noise * rng.normal(size=len(z)))[:, None]
    pool = (rng.random(600) < 0.5).astype(float)
    pools, told = [view(pool, 0.2), view(pool, 0.3)], []

    def ask(models, scales):
        for v, label, q, rows in quality.sure_of(models, scales, pools, 0.95):
            told.append((label == pool[rows]).mean())
            yield 1 - v, label, pools[1 - v][rows[:50]]

    model = quality.co_train([view(y, 0.2), view(y, 0.3)], y, ask)
    assert min(model["passed"]) > 0 and min(told) > 0.9


def test_corpus_asker_against_brute_force(spark):
    """Of all unlabelled rows, the surest come, each once, whatever the partitioning."""
    rng = random.Random(51)
    rows = [(i, words(rng, rng.randrange(1, 30)), "en", f"s{i % 3}", i) for i in range(300)]
    found = quality.statistics(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").toArrow()
    views = quality._views(found)
    y = np.array([float(len(t.split()) > 12) for _, t, *_ in rows])
    models = [quality.logistic(v, y) for v in views]
    scales = [quality.logistic(quality.logit(m, v)[:, None], y) for m, v in zip(models, views)]
    pool = quality.statistics(spark.createDataFrame(rows, DOCS)).withColumn("uid", F.col("doc_id")).select("uid", "doc_id", "lang", "source", "n_chars", "stats").repartition(5)
    ask, taken = quality.corpus_asker(pool, 0.6, 20), set()
    for _ in range(2):
        want, now = [], set()
        for v, label, q, sure in quality.sure_of(models, scales, views, 0.6):
            best = sorted((i for i in sure if i not in taken), key=lambda i: (-q[i], i))[:20]
            best = [i for i in best if i not in now]
            now |= set(best)
            if best:
                want.append((1 - v, label, views[1 - v][best]))
        taken |= now
        got = list(ask(models, scales))
        assert [(v, label) for v, label, _ in got] == [(v, label) for v, label, _ in want]
        assert all(np.allclose(a[2], b[2]) for a, b in zip(got, want))


def test_quality_on_rows_that_no_fit_saw(spark):
    """Labels of every fifth document are hidden from the fit and must be found."""
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model, found = quality.fit(d, lab.where(~hidden))
    got = quality.score_statistics(found, model).join(lab.where(hidden), "doc_id").select("keep", "quality").collect()
    assert len(got) > 50 and sum(r["keep"] == (r["quality"] == 1) for r in got) >= 0.95 * len(got)
