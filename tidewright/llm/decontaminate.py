"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

A benchmark item of n words is compared with every window of n words of every document (all of the
document if it is shorter). Windows that hold a shingle of an item of their size get a 64-bit SimHash,
weighted by how often each shingle occurs in the window; a window without such a shingle shares
nothing with any item of its size and could not pass the verification. Fingerprints within ``RADIUS``
bits of an item's are found by ``BLOCKS`` blocks: of so many differing bits, some block holds one at
most, so looking up each block with its one-bit neighbours misses none. Candidates are verified by
the exact weighted Jaccard similarity of their five-word shingles (sum of smaller over sum of larger counts).

Documents are scanned once, without a shuffle. Items go to all tasks in blocks of ``item_words`` words
at most (a scan for each block), so what is sent is bounded whatever the benchmark's size.

Defined results: null and empty texts match nothing; items without words match nothing; an item of
fewer than five words is one shingle; repeated rows match alike; empty tables give empty results; other
columns of the documents stay, ``matches`` is written over.
"""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import U, documents_words, map_rows, mix, shingles_of, table, word_count, words_of

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS = 10  # of six or seven bits
RADIUS = 2 * BLOCKS - 1  # with one differing bit allowed in a block
ITEM_WORDS = 2_000_000  # of benchmark text in one scan
_CUTS = np.linspace(0, BITS, BLOCKS + 1).astype(int)
MATCHES = "array<struct<item_id:bigint,start_word:int,n_words:int,similarity:double,distance:int>>"


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 ones and minus ones for each shingle."""
    bits = np.unpackbits(mix(shingles ^ U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of shingles[s : s + n] for each s of ``starts``, which lie close together or not."""
    lo, hi = int(starts.min()), int(starts.max()) + n
    upto = np.zeros((hi - lo + 1, BITS), np.int32)
    np.cumsum(_signs(shingles[lo:hi]), axis=0, out=upto[1:])
    bits = upto[starts - lo + n] - upto[starts - lo] > 0
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of smaller over sum of larger counts."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(place[: len(a)], minlength=len(values)), np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Index:
    """Items of one size: fingerprints under each value of each block, one-bit neighbours included."""

    def __init__(self, words: int, items: list[tuple[int, np.ndarray]]):
        self.words, self.k = words, min(SHINGLE, words)
        self.n = words - self.k + 1  # shingles
        self.ids = [i for i, _ in items]
        self.shingles = [s for _, s in items]
        self.known = np.unique(np.concatenate(self.shingles))
        self.prints = np.concatenate([fingerprints(s, np.zeros(1, int), len(s)) for s in self.shingles])
        self.blocks = []
        for lo, hi in zip(_CUTS[:-1], _CUTS[1:]):
            own = (self.prints >> U(lo)).astype(np.int64) & ((1 << (hi - lo)) - 1)
            near = np.concatenate([own, *[own ^ (1 << b) for b in range(hi - lo)]])
            item = np.tile(np.arange(len(own)), hi - lo + 1)
            order = np.argsort(near, kind="stable")
            cut = np.searchsorted(near[order], np.arange((1 << (hi - lo)) + 1))
            self.blocks.append((int(lo), (1 << int(hi - lo)) - 1, cut, item[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within RADIUS bits."""
        found = []
        for lo, mask, cut, item in self.blocks:
            value = (prints >> U(lo)).astype(np.int64) & mask
            n = cut[value + 1] - cut[value]
            window = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(cut[value] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found.append(window * len(self.ids) + item[at])
        both = np.unique(np.concatenate(found))
        window, item = both // len(self.ids), both % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        keep = distance <= RADIUS
        return window[keep], item[keep], distance[keep]


def build(items: list[tuple[int, bytes]]) -> list[Index]:
    sizes: dict[int, list] = {}
    for item_id, text in items:
        data = np.frombuffer(text, np.uint8)
        words, _ = words_of(data, np.array([0, len(data)])) if len(data) else (np.zeros(0, np.uint64), None)
        if len(words):
            sizes.setdefault(len(words), []).append((item_id, shingles_of(words, SHINGLE)))
    return [Index(n, own) for n, own in sorted(sizes.items())]


def matches_of(words: np.ndarray, indexes: list[Index], hits: dict[int, np.ndarray], threshold: float) -> list[dict]:
    """Each item's best window in one document. hits: by shingle length, the places of items' shingles."""
    out = []
    for x in indexes:
        at = hits.get(x.k)
        if at is None or not len(at):
            continue
        shingles = shingles_of(words, x.k)
        n = min(x.n, len(shingles))
        own = at[np.isin(shingles[at], x.known)]
        if not len(own):
            continue
        top = len(shingles) - n
        cover = np.zeros(top + 2, np.int64)  # windows that hold one of these shingles
        np.add.at(cover, np.clip(own - n + 1, 0, top), 1)
        np.add.at(cover, np.clip(own, 0, top) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(starts) > 4 * n) + 1, np.arange(1 << 15, len(starts), 1 << 15)]))
        for part in np.split(starts, cuts.astype(int)):  # far apart, or many: summed apart
            window, item, distance = x.near(fingerprints(shingles, part, n))
            best: dict[int, tuple] = {}
            for w, i, d in zip(window.tolist(), item.tolist(), distance.tolist()):
                s = weighted_similarity(shingles[part[w] : part[w] + n], x.shingles[i])
                if s >= threshold and (i not in best or s > best[i][0]):
                    best[i] = (s, int(part[w]), d)
            out += [{"item_id": x.ids[i], "start_word": p, "n_words": min(x.words, len(words)), "similarity": s, "distance": d} for i, (s, p, d) in best.items()]
    kept: dict[int, dict] = {}
    for m in out:
        if m["item_id"] not in kept or (m["similarity"], -m["start_word"]) > (kept[m["item_id"]]["similarity"], -kept[m["item_id"]]["start_word"]):
            kept[m["item_id"]] = m
    return sorted(kept.values(), key=lambda m: (m["item_id"] is None, m["item_id"]))


def _item_blocks(items: DataFrame, item_words: int):
    """The items, block by block of ``item_words`` words at most (or one item)."""
    sized = items.select("item_id", F.col("text").cast("binary").alias("text"), word_count(F.col("text")).alias("n")).where("n > 0")
    block, n = [], 0
    for r in sized.toLocalIterator():
        if block and n + r["n"] > item_words:
            yield block
            block, n = [], 0
        block.append((r["item_id"], bytes(r["text"])))
        n += r["n"]
    yield block


def scan(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, item_words: int = ITEM_WORDS) -> DataFrame:
    """``docs`` with ``matches``: each benchmark item found, with its best window."""
    docs = docs.drop("matches")
    found = "found"  # by blocks before; a name that no column has
    while found in docs.columns:
        found += "_"
    out = None
    for block in _item_blocks(items, item_words):
        indexes = build(block)
        by_k = {k: np.unique(np.concatenate([x.known for x in indexes if x.k == k])) for k in {x.k for x in indexes}}
        sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((indexes, by_k)))

        def scanned(batches, sent=sent):
            import pyarrow as pa

            indexes, by_k = cloudpickle.loads(sent.value)
            member = {}
            for k, known in by_k.items():  # a bitmap of 2 ** 20 places rules most shingles out
                bitmap = np.zeros(1 << 20, bool)
                bitmap[(known >> U(44)).astype(np.int64)] = True
                member[k] = (known, bitmap)
            for batch in batches:
                column = [None] * batch.num_rows
                for i, words in documents_words(batch):
                    hits = {}
                    for k, (known, bitmap) in member.items():
                        if len(words) >= k:
                            shingles = shingles_of(words, k)
                            maybe = np.flatnonzero(bitmap[(shingles >> U(44)).astype(np.int64)])
                            if len(maybe):
                                maybe = maybe[known[np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)] == shingles[maybe]]
                            if len(maybe):
                                hits[k] = maybe
                    column[i] = matches_of(words, indexes, hits, threshold) if hits else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, _arrow_matches())], names=[*batch.schema.names, "matches"])

        before = docs if out is None else out.withColumnRenamed("matches", found)
        out = map_rows(before, scanned, matches=T._parse_datatype_string(MATCHES))
        if found in out.columns:
            out = out.withColumn("matches", F.concat(found, "matches")).drop(found)
    return out


def _arrow_matches():
    import pyarrow as pa

    return pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64()), ("distance", pa.int32())]))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return scan(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).drop("matches")
