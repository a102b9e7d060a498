"""Importance resampling towards a target corpus, with a dictionary of the distinct features.

Features are the runs of 1 to 3 words of a text. Every distinct feature string of the corpus is hashed once, to one of 10,000
buckets; a bucket's gain compares how often the target and the corpus use it; a document's weight is the sum of gains of
its features. The highest weights plus Gumbel noise are drawn, which is sampling without replacement in proportion to exp(weight).

1. Documents are gathered into blocks of about ``BLOCK_BYTES`` of text: their words as numbers in the block's own sorted word list. Blocks are written.
2. For each run length, a block sends each of its distinct features once, with its count, to the part of the dictionary that the
   feature belongs to. A part counts its strings over all blocks, hashes each distinct one, and sums counts by bucket.
3. It answers each block with the buckets of the features that this block sent, in the order sent. Joined back to the blocks with the
   gains, they give the weights.

Scale: a feature crosses the network once for each block that holds it, grouped by first words and compressed, and two
bytes come back. Run lengths go one after the other, and the longest in two waves of parts, so that a part of the features lies on
disk at a time. A part holds about ``PART_FEATURES`` features, however common one is: each block sends it once. Numbers of blocks and
parts grow with the text. The gains (one for each bucket) are all that is broadcast.

Defined results: null and empty texts have no feature and weight 0; a text longer than a block is a block of its own; repeated rows are documents of their own, drawn one by
one; a null id is hashed as ``null``; an empty corpus gives an empty table and an empty target counts none. ``keep`` names the columns
that stay; ``n_features n_words weight score rank`` are written over.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import Scratch, chunks, column, mix, table, texts_of
from tidewright.sources.staging import numbered

RUNS = (1, 2, 3)
BUCKETS = 10_000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
BLOCK_BYTES = 16 << 20
PART_FEATURES = 1 << 19
WAVES = 2
AT_ONCE = 1 << 18  # features whose strings a block holds at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=bool)  # bytes of words: digits, lower-case letters, all that is not ASCII
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
LONG = 64  # bytes of a string from which it is hashed on its own


def _pack(data) -> bytes:
    """zstd, after the length."""
    import pyarrow as pa

    data = memoryview(data).cast("B") if len(data) else b""
    return len(data).to_bytes(8, "little") + bytes(pa.compress(data, codec="zstd", asbytes=True))


def _unpack(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _pack_numbers(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first: the high ones of small numbers shrink to nothing."""
    return _pack(np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).reshape(-1))


def _unpack_numbers(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _strings(ends: np.ndarray, data: np.ndarray):
    """Binary strings that lie one after the other in ``data`` and end at ``ends``."""
    import pyarrow as pa

    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _lines(data: bytes):
    """The strings of newline-ended ``data``, newline included."""
    data = np.frombuffer(data, np.uint8)
    return _strings(np.flatnonzero(data == 10) + 1, data)


def crc32(ends: np.ndarray, starts: np.ndarray, data: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for all strings at once, byte by byte of those that are long enough."""
    size = ends - starts
    out = np.zeros(len(size), np.uint32)
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = np.argsort(-size)
    order = order[np.searchsorted(-size[order], -LONG) :]  # longest first, none beyond LONG
    state, at, left = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order], -size[order]
    for j in range(int(-left[0]) if len(left) else 0):
        n = np.searchsorted(left, -j)  # those with more than j bytes
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


# ---------------------------------------------------------------- blocks


def _block(batches: list, number: int):
    """One row: the kept columns of its documents, where the words of each end, the words from the most frequent on, all words as numbers."""
    import pyarrow as pa

    rows = pa.Table.from_batches(batches).combine_chunks()
    data, offsets = texts_of(rows.column("text").combine_chunks())
    low, bounds = _LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    del data, batches
    inside = _INSIDE[low]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(low))]
    begins[edge], stops[edge - 1] = inside[edge], inside[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    del begins, stops
    coded = _strings(np.cumsum(stop - start), low[inside]).dictionary_encode()
    del low, inside, stop
    seen = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(seen, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    names = b"".join(w + b"\n" for w in coded.dictionary.take(pa.array(order)).to_pylist())
    kept = rows.column("kept").combine_chunks()
    ends = np.searchsorted(start, bounds[1:])
    row = {
        "block": pa.array([number]), "rows": pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
        "ends": pa.array([_pack(ends)], pa.binary()), "names": pa.array([_pack(names)], pa.binary()),
        "words": pa.array([_pack_numbers(rank[seen], "<i4")], pa.binary()), "n_words": pa.array([len(start)]),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def blocks(docs: DataFrame, text: str, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    kept = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(0).alias("c0"))
    slim = docs.select(kept.alias("kept"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(slim.schema["kept"].dataType)), T.StructField("ends", T.BinaryType()),
        T.StructField("names", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("n_words", T.LongType()),
    ])

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            offsets = texts_of(batch.column("text"))[1]
            for lo, hi in chunks(offsets, block_bytes):
                held.append(batch.slice(lo, hi - lo))
                size += int(offsets[hi] - offsets[lo])
                if size >= block_bytes:
                    yield _block(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield _block(held, number)

    return slim.mapInArrow(run, schema)


class _Block:
    """The features of a block, always in the same order."""

    def __init__(self, words: bytes, ends: bytes, names: bytes):
        self.words, self.ends = _unpack_numbers(words, "<i4"), np.frombuffer(_unpack(ends), np.int64)
        self.names = _lines(_unpack(names))  # with newlines, for the last word of a feature
        data, offsets = _bytes_of(self.names)
        self.plain = _strings(np.cumsum(np.diff(offsets) - 1), data[data != 10])
        self.crc = crc32(offsets[1:] - 1, offsets[:-1], data).astype(np.uint64)

    def runs(self, n: int):
        """(where runs of n words start, number of each among the distinct ones, one place of each of these, in the order of words)."""
        until = np.repeat(self.ends.astype(np.int32), np.diff(self.ends, prepend=0))  # for each word the end of its document
        start = np.flatnonzero(np.arange(n, len(self.words) + n, dtype=np.int32) <= until).astype(np.int32)  # a block has less than 2 ** 31 words
        del until
        key, many = self.words[start].astype(np.int64), max(1, len(self.names))
        for j in range(1, n):
            if len(key) and int(key.max()) * many >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
            key = key * many + self.words[start + j]
        order = np.argsort(key)
        key = key[order]
        new = np.diff(key, prepend=-1) != 0
        del key
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new, dtype=np.int32) - 1
        return start, number, start[order[new]]

    def dealt(self, place: np.ndarray, n: int, parts: int):
        """(the distinct features by part of the dictionary; how many each part gets). A part follows from the string alone."""
        hashed = np.zeros(len(place), np.uint64)
        for j in range(n):
            hashed = mix(hashed + self.crc[self.words[place + j]])
        part = (hashed % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        del hashed
        return np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)

    def strings(self, place: np.ndarray, n: int):
        """The features that start at these places, each with a newline."""
        import pyarrow as pa
        import pyarrow.compute as pc

        columns = [(self.names if j == n - 1 else self.plain).take(pa.array(self.words[place + j])) for j in range(n)]
        return columns[0] if n == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))


def _bytes_of(strings) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings."""
    data, offsets = texts_of(strings)
    return data, offsets


# ---------------------------------------------------------------- the dictionary


SENT = "part int, block long, names binary, counts binary"


def _send(n: int, parts: int, first: int, last: int):
    """A block's distinct features for the parts from ``first`` up to ``last``: a row for each part that gets any."""

    def grouped(sizes: np.ndarray):
        """Runs of parts that get about AT_ONCE features together."""
        lo = first
        while lo < last:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:last]), AT_ONCE, side="right")))
            yield range(lo, min(hi, last))
            lo = hi

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, words, ends, names in zip(*(batch.column(c) for c in ("block", "words", "ends", "names"))):
                one = _Block(words.as_py(), ends.as_py(), names.as_py())
                _, number, place = one.runs(n)
                if not len(place):
                    continue
                counts = np.bincount(number).astype(np.int32)
                del number
                order, sizes = one.dealt(place, n, parts)
                bound = np.concatenate([[0], np.cumsum(sizes)])
                for group in grouped(sizes):
                    here = order[bound[group.start] : bound[group.stop]]
                    if not len(here):
                        continue
                    data, offsets = _bytes_of(one.strings(place[here], n))
                    got = [p for p in group if sizes[p]]
                    cut = [(bound[p] - bound[group.start], bound[p + 1] - bound[group.start]) for p in got]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(got, pa.int32()), "block": pa.array([block.as_py()] * len(got), pa.int64()),
                        "names": pa.array([_pack(data[offsets[a] : offsets[b]]) for a, b in cut], pa.binary()),
                        "counts": pa.array([_pack_numbers(counts[here[a:b]], "<i4") for a, b in cut], pa.binary()),
                    })

    return run


def _count(buckets: int):
    """One part of the dictionary: its strings counted and hashed, an answer for each block, the sums by bucket beside the first."""

    def run(group):
        import pyarrow as pa

        sent = [_unpack(x.as_py()) for x in group.column("names")]
        counts = np.concatenate([_unpack_numbers(x.as_py(), "<i4") for x in group.column("counts")])
        sizes = np.cumsum([0, *[x.count(b"\n") for x in sent]])
        coded = _lines(b"".join(sent)).dictionary_encode()
        number = coded.indices.to_numpy()
        data, offsets = _bytes_of(coded.dictionary)
        bucket = (crc32(offsets[1:] - 1, offsets[:-1], data) % np.uint32(buckets)).astype(np.int64)
        answer = bucket[number]
        total = np.bincount(answer, counts, buckets).astype(np.int64)  # sums of less than 2 ** 53
        used = np.flatnonzero(total)
        rest = len(sent) - 1
        return pa.table({
            "block": group.column("block"), "part": group.column("part"),
            "answer": pa.array([_pack_numbers(answer[a:b], "<u4") for a, b in zip(sizes, sizes[1:])], pa.binary()),
            "distinct": pa.array([len(bucket), *[0] * rest], pa.int64()),
            "buckets": pa.array([used.tolist(), *[[]] * rest], pa.list_(pa.int32())), "counts": pa.array([total[used].tolist(), *[[]] * rest], pa.list_(pa.int64())),
        })

    return run


ANSWER = "block long, part int, answer binary, distinct long, buckets array<int>, counts array<long>"


def dictionary(held: DataFrame, n: int, parts: int, buckets: int = BUCKETS, first: int = 0, last: int | None = None) -> DataFrame:
    """Answers of the dictionary of runs of n words, or of its parts from ``first`` up to ``last``, to the blocks ``held``."""
    sent = held.select("block", "words", "ends", "names").mapInArrow(_send(n, parts, first, parts if last is None else last), SENT)
    return sent.groupBy("part").applyInArrow(_count(buckets), ANSWER)


def bucket_sums(answers: list[DataFrame]) -> DataFrame:
    """(bucket, n): how many features fall into each bucket that has any."""
    x = reduce(DataFrame.unionByName, [a.where(F.size("buckets") > 0).select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")) for a in answers])
    return x.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def _weigh(keep: int, gains: np.ndarray, parts: int, runs: tuple[int, ...]):
    def run(left, right):
        import pyarrow as pa

        row = {c: left.column(c)[0] for c in ("rows", "words", "ends", "names")}
        one = _Block(row["words"].as_py(), row["ends"].as_py(), row["names"].as_py())
        answers = {}
        for n, part, answer in zip(*(right.column(c).to_pylist() for c in ("n", "part", "answer"))):
            answers[n, part] = answer
        first = np.concatenate([[0], one.ends[:-1]]) if len(one.ends) else one.ends
        count, weight = np.zeros(len(one.ends), np.int64), np.zeros(len(one.ends), np.int64)
        for n in runs:
            start, number, place = one.runs(n)
            if not len(place):
                continue
            order, _ = one.dealt(place, n, parts)
            gain = np.empty(len(place), np.int64)
            gain[order] = gains[np.concatenate([_unpack_numbers(answers[key], "<u4") for key in sorted(answers) if key[0] == n])]
            running = np.concatenate([[0], np.cumsum(gain[number])])
            lo, hi = np.searchsorted(start, first), np.searchsorted(start, one.ends)
            count += hi - lo
            weight += running[hi] - running[lo]
        kept = row["rows"].values.flatten()
        columns = [*kept, pa.array(count), pa.array(weight), pa.array(one.ends - first)]
        return pa.table(columns, names=[*[f"c{i}" for i in range(keep)], "n_features", "weight", "n_words"])

    return run


# ---------------------------------------------------------------- weights and the draw


def gains(corpus: DataFrame, target: DataFrame, spark, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket, with one added to each count."""
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    totals = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(totals["S"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(totals["T"] + buckets))
    found = both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("g")).orderBy("bucket").collect()  # a row for each bucket
    return np.array([r["g"] for r in found], dtype=np.int64)


def _corpus(docs: DataFrame, text: str, keep: list[str], scratch: Scratch, name: str, block_bytes: int, runs: tuple[int, ...], buckets: int):
    """(blocks, number of parts, all answers with their run length n), written."""
    held = scratch.save(blocks(docs, text, keep, block_bytes), f"{name}_blocks")
    words = held.agg(F.sum("n_words")).first()[0] or 0
    parts, answers = max(1, -(-words // PART_FEATURES)), []
    for n in runs:
        half = parts // 2 if n == max(runs) else 0
        for first, last in ((0, half), (half, parts)):
            if first < last:
                answers.append(scratch.save(dictionary(held, n, parts, buckets, first, last).withColumn("n", F.lit(n)), f"{name}_{n}_{first}"))
    return held, parts, answers


def weights(docs: DataFrame, target: DataFrame, keep: list[str], text: str = "text", target_text: str = "text", runs: tuple[int, ...] = RUNS, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns of every document with n_features, weight and n_words, written to the shared folder."""
    made, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    wanted = bucket_sums(_corpus(target, target_text, [], made, "target", block_bytes, runs, buckets)[2])
    held, parts, found = _corpus(docs, text, keep, made, "corpus", block_bytes, runs, buckets)
    gain = gains(bucket_sums(found), wanted, docs.sparkSession, buckets)
    answers = reduce(DataFrame.unionByName, [one.select("n", "block", "part", "answer") for one in found])
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("n_features", "weight", "n_words")]])
    out = []
    for wave in range(WAVES):  # of blocks: a part of them is shuffled at a time
        mine = F.pmod(F.xxhash64("block"), F.lit(WAVES)) == wave
        both = held.where(mine).select("block", "rows", "words", "ends", "names").groupBy("block").cogroup(answers.where(mine).groupBy("block"))
        out.append(scratch.save(both.applyInArrow(_weigh(len(keep), gain, parts, runs), schema), f"weights_{wave}"))
    made.remove()
    return reduce(DataFrame.unionByName, out).toDF(*keep, "n_features", "weight", "n_words")


def noise(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate that the key decides."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **options) -> DataFrame:
    """Every document's kept columns (all, if none are named) with n_features, n_words, weight, score and rank; rank is null for those not drawn."""
    mine = ("n_features", "n_words", "weight", "score", "rank")
    keep = [c for c in (keep or docs.columns) if c not in mine]
    x = weights(docs, target, keep, **options).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    able = F.col("n_words") >= least_words
    ranked = numbered(x.where(able), F.desc("score"), F.col(key).asc_nulls_last(), name="rank")
    drawn = x.where(able).count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(x.where(~able).withColumn("rank", F.lit(None).cast("long"))).select(*map(column, keep), *mine)


def query(spark, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resample(docs, target, keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
WITH RECURSIVE crc(b, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), crcs AS (
  SELECT list(c ORDER BY b) AS steps FROM crc WHERE k = 8
), texts AS (
  SELECT false AS wanted, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT true, row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT wanted, r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS (
  SELECT wanted, r, unnest(list_concat(
           w,
           list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
           list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM words
), counted AS (
  SELECT wanted, r, f, count(*) AS n FROM features GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(
              list_transform(range(0, strlen(f)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)),
              lambda c, b: xor(c >> 8, steps[CAST(xor(c & 255, b) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM counted), crcs
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT wanted), 0) AS s, coalesce(sum(n) FILTER (wanted), 0) AS t
  FROM counted JOIN hashed USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(total_s + {BUCKETS} AS DOUBLE)
                                      / (CAST(s + 1 AS DOUBLE) * CAST(total_t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g
  FROM sums, (SELECT sum(s) AS total_s, sum(t) AS total_t FROM sums)
), weighed AS (
  SELECT r, sum(n) AS n_features, sum(n * g) AS weight
  FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE NOT wanted GROUP BY r
), scored AS (
  SELECT doc_id, len(w) >= {LEAST_WORDS} AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) + 0.5)
                                                          / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (r) WHERE NOT wanted
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
