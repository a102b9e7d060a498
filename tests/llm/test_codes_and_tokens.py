"""Vector codes, importance resampling and BPE, each against a version by hand; nulls, empty and long inputs, ties, repeats, odd names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import DOCS, clashing, collected
from tidewright.llm import bpe, resample, vector_code

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- vector codes


def coded_by_hand(rows, parts, entries, rounds):
    """rows: (id, vector); every distance to every entry."""
    sound = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(x * 256) for x in v]) for i, v in sound]
    if not ints:
        return Counter(), []
    width = len(ints[0][1]) // parts
    ints.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    out = Counter()
    for (i, _), c in zip(ints, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out[i, bytes(k for _, k in found), sum(d for d, _ in found)] += 1
    return out, books


@pytest.mark.parametrize("n,parts,entries,rounds", [(300, 4, 16, 2), (10, 2, 64, 2), (120, 8, 5, 3), (40, 1, 7, 0)])
def test_vector_codes(spark, n, parts, entries, rounds):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(n)]
    rows += [(n + i, [round(x, 1) for x in v]) for i, (_, v) in enumerate(rows[:20])]  # ties
    rows += [rows[3], rows[3], (5, rows[7][1]), (None, rows[1][1]), (900, None), (901, []), (902, [0.0, None] * 4), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [0.0] * 8), (906, [-0.001] * 8)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "code", "error", "part", "entry", "n", "total", "odd ` name", "a.b")
    coded, books = vector_code.encode(frame.repartition(3), parts=parts, entries=entries, rounds=rounds)
    want, by_hand = coded_by_hand(rows, parts, entries, rounds)
    got = coded.collect()
    assert Counter((r["vec_id"], bytes(r["code"]), r["error"]) for r in got) == want and all(r["total"] == "x" for r in got)
    assert books.tolist() == by_hand
    assert vector_code.fingerprint(books) == hashlib.sha256(",".join(str(x) for b in by_hand for e in b for x in e).encode()).hexdigest()
    one = next(r for r in got if r["vec_id"] == 905)
    assert ((vector_code.decode(bytes(one["code"]), books) * 256) ** 2).sum() == one["error"]


def test_vector_codes_of_nothing_and_of_the_too_large(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = vector_code.encode(frame)
    assert coded.count() == 0 and coded.columns == ["vec_id", "label", "code", "error"] and vector_code.fingerprint(books) == hashlib.sha256(b"").hexdigest()
    rows = [(1, [0.5] * 32), (2, [1e30] * 32), (3, [1.0] * 16), (4, [-2e6] * 32)]
    coded, _ = vector_code.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r["vec_id"], r["error"]) for r in coded.collect()) == [(1, 0), (4, 0)]
    with pytest.raises(ValueError):
        vector_code.encode(frame, entries=257)


@given(st.integers(0, 2**32), st.integers(1, 90), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_nearest_entry(seed, entries, width):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-6, 6, (50, width)), rng.integers(-6, 6, (entries, width))
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    code, best = vector_code.nearest(x, book)
    assert code.tolist() == far.argmin(1).tolist() and best.tolist() == far.min(1).tolist()


# ---------------------------------------------------------------- importance resampling

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, runs=(1, 2, 3)):
    w = WORDS.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in runs for i in range(len(w) - n + 1)], len(w)


def weighed_by_hand(texts, target, buckets=10_000):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counter, many in ((s, texts), (t, target)):
        for x in many:
            counter.update(place(f) for f in features(x)[0])
    top = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in s}
    return [(len(features(x)[0]), features(x)[1], sum(top[place(f)] for f in features(x)[0])) for x in texts]


def noise(doc_id):
    h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@pytest.mark.parametrize("block_bytes,part", [(1 << 24, 1 << 19), (300, 40)])
def test_resampling(spark, monkeypatch, block_bytes, part):
    monkeypatch.setattr(resample, "PART_FEATURES", part)
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["a", "Bee", "c3", "ÉTÉ", "été", "日本", "x_y", "-", "\n", "z" * 80]) for _ in range(n))
    rows = [(i, some(rng.randrange(60)), "en", "s", 1) for i in range(70)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "-- !!", "en", "s", 0), (103, some(30000), "en", "s", 1), rows[4], rows[4], (None, some(40), "en", "s", 1), (None, some(40), "en", "s", 1)]
    target = [some(20) for _ in range(5)] + [None, ""]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3), "weight", "rank", "block", "rows", "c0", "odd ` name", "a.b")
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=20, block_bytes=block_bytes).collect()
    want = weighed_by_hand([r[1] for r in rows], target)
    scored = [(d, n, words, w, w + noise(d)) for (d, *_), (n, words, w) in zip(rows, want)]
    assert Counter((r["doc_id"], r["n_features"], r["n_words"], r["weight"], r["score"]) for r in got) == Counter(scored)
    able = sorted(((-s, d is None, d or 0) for d, _, words, _, s in scored if words >= 20))
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [r[:2] for r in drawn] == [(k + 1, able[k][0]) for k in range(20 * len(able) // 100)]
    assert all((d is None, d or 0) == able[k - 1][1:] for k, _, d in drawn)
    assert {(r["odd ` name"], r["a.b"], r["c0"]) for r in got} == {("x", "x", "x")} and {r["text"] for r in got} == {r[1] for r in rows}


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b " * 20, "en", "s", 1)], DOCS)
    assert resample.resample(none, some).count() == 0
    assert [r["n_features"] for r in resample.resample(some, none, percent=100).collect()] == [117]
    assert [r["rank"] for r in resample.resample(some.where("false").unionByName(some), some, percent=100).collect()] == [1]


@given(st.lists(st.binary(max_size=200), max_size=40))
@settings(max_examples=60, deadline=None)
def test_crc_of_all_at_once(strings):
    ends = np.cumsum([len(s) for s in strings]).astype(np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    assert resample.crc32(ends, ends - [len(s) for s in strings] if strings else ends, data).tolist() == [zlib.crc32(s) for s in strings]


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary(PATH))


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


TEXTS = [
    "", " ", "\n\n  x", "Hello world's 'tis I'll we've", "naïve café 日本語 🎯🎯", "a<|endoftext|>b <|endoftext|> <|endoftext|", "<|endoftext|>", "aaaa" * 300, "abab" * 500,
    "  \u00a0\u3000 x\u2003y\u0085z\x1cq", "٣٤٥ ½ ²x", "don't  stop\r\n\tnow   ", "x" * 5000 + "1" * 3000, "\u0301e\u0301 ʼn ǅ", "'S 'T don'T", "\ufffd\ud7ff\U0010ffff", "ᚠᛇᚻ ௧௨௩ ⅷ", "=" * 999,
]


@pytest.mark.parametrize("text", TEXTS)
def test_encodes_as_the_library(library, encoder, text):
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=80), st.text("abctheing 's\n1!é", max_size=300)))
@settings(max_examples=400, deadline=None)
def test_encodes_any_text_as_the_library(library, encoder, text):
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_characters_of_all_classes(library, encoder):
    """Every character, in the places where its class matters."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}\t{chr(c)}" for c in points[lo : lo + 4096 : 3])
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_every_token_is_its_own_encoding(encoder):
    assert all(encoder.piece(t) == [i] for i, t in enumerate(encoder.tokens[:50256]))


def test_a_text_is_cut_where_no_piece_crosses(encoder, monkeypatch):
    text = " ".join(TEXTS) * 3
    whole = encoder.encode(text)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(bpe, "CUT", size)
        assert encoder.encode(text) == whole


def test_tables_stay_bounded(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    fresh = bpe.Encoder(bpe.vocabulary(PATH))
    assert all(fresh.encode(t) == encoder.encode(t) for t in TEXTS) and len(fresh.memo) <= 3 and len(fresh.fits) <= 3


def test_round_trip_of_a_frame(spark, library):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(50, None, None, None, None), (51, "long tail " * 120_000, "en", "s", 1), (3, TEXTS[3], "en", "s", 1), (None, "x", "en", "s", 1)]
    docs = clashing(spark.createDataFrame(rows, DOCS), "ids", "decoded", "made", "odd ` name", "a.b")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = Counter()
    for d, t, *_ in rows:
        e = library.encode(t or "", add_special_tokens=False)
        want[d, t, np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["text"], bytes(r["ids"]), r["decoded"]) for r in got) == want and {r["a.b"] for r in got} == {"x"}
    assert bpe.decode(bpe.encode(spark.createDataFrame([], DOCS), PATH), PATH).count() == 0


def test_decodes_any_ids(spark, library):
    rng = random.Random(8)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(60))] for _ in range(200)] + [[], [60000, 15496], [50256, 50256], None, [200, 201, 202]]
    frame = spark.createDataFrame([(i, None if x is None else np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)], "i long, ids binary")
    got = {r["i"]: r["decoded"] for r in bpe.decode(frame, PATH).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_query_gives_digests(spark, library):
    from tidewright.llm import registry

    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in registry.QUERIES["op13_bpe"](spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    assert got == {(d, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for d, x in ids.items()}
    assert len(collected(spark.range(1))) == 1
