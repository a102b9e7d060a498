"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are rotated by one random orthogonal matrix and put into the inverted lists of centroids that are
fitted on a bounded sample. A query scans its lists from the nearest on, column block by column block of the
rotated coordinates: the partial squared distance over d of D coordinates, times D / d, estimates the whole. The
hypothesis that a candidate belongs to the k nearest is rejected, and the candidate abandoned, where its estimate
exceeds (1 + EPSILON * sqrt((1 - d / D) / d)) ** 2 times the query's k-th best squared distance so far (the deviation
that a random rotation allows, which shrinks to nothing at D), and by more than rounding: copies of the query stay even where that best is 0.
That limit runs on: pass one searches the nearest ``SEED_SHARE`` of the rows, pass two starts all other lists of a query
with the limit of pass one and tightens it from list to list. Distances returned are exact, in double precision, on the original vectors.

A query probes lists until ``probe_rows`` rows or a share of all rows are reached, whichever is more, so small tables are
searched whole. The share is the least that finds ``TARGET`` of the true neighbours among a quarter of the sample that no
centroid was fitted on (where neighbours lie farther apart than in all rows, so it errs on the safe side); vectors without
local structure need a large one.

Lists are packed into blocks of about ``block_rows`` rows, nearby lists together; a longer list is cut by hash, so one that
holds a third of all rows is scanned by many tasks. Queries are dealt over blocks of ``block_rows`` too: a task holds a block of either.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor
do vectors of another length than most; a null id takes no part; equal vectors tie, smaller ids first; rows
of a repeated id are queries and candidates of their own (a query leaves out its own row, not its id); fewer
candidates than k give them all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import Scratch, table

K = 10
SAMPLE_ROWS = 20_000  # that the centroids are fitted on, about, at most; by hash of the id
MAX_LISTS = 2048
LIST_ROWS = 16  # rows of a list that small tables aim at
PROBE_ROWS = 512
SEED_SHARE = 0.01  # of all rows, searched first for the limit
TARGET = 0.9  # recall on the sample that sets the share of all rows to probe
SAMPLE_QUERIES = 256
BLOCK_ROWS = 4096
COLUMNS = 8  # in a column block
EPSILON = 1.5  # about two standard deviations


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centroids_of(x: np.ndarray, n: int, steps: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm from random distinct rows."""
    x = np.unique(x, axis=0)
    if len(x) <= n:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(steps):
        own = nearest(x, c)
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=n) for j in range(x.shape[1])], axis=1)
        counts = np.bincount(own, minlength=n)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norms = (c**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * part @ c.T, axis=1) for part in np.array_split(x, max(1, len(x) // 2048))])


def share_needed(x: np.ndarray, c: np.ndarray, k: int, target: float = TARGET, queries: int = SAMPLE_QUERIES) -> float:
    """The share of rows that queries must probe to find ``target`` of their k nearest in this sample."""
    if len(x) <= k + 1 or len(c) < 2:
        return 1.0
    own = nearest(x, c)
    rows, norms = np.bincount(own, minlength=len(c)), (x**2).sum(1)
    needed = []
    for i in np.random.default_rng(1).choice(len(x), min(queries, len(x)), replace=False):
        whole = norms - 2 * x @ x[i]
        whole[i] = np.inf
        order = np.argsort(((c - x[i]) ** 2).sum(1), kind="stable")
        upto = np.empty(len(c))
        upto[order] = np.cumsum(rows[order])
        needed.append(upto[own[np.argpartition(whole, k)[:k]]])
    return float(np.quantile(np.concatenate(needed), target) / len(x))


class Block:
    """A block of rows in the order of their lists, rotated coordinates in column blocks."""

    def __init__(self, lists: np.ndarray, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.lists, self.uids, self.ids, self.vectors, self.rotated = lists[order], uids[order], ids[order], vectors[order], rotated[order]
        self.dim, self.scanned, self.pairs = rotated.shape[1], 0, 0  # coordinates computed, pairs met

    def scan(self, one: int, uids: np.ndarray, exact: np.ndarray, rotated: np.ndarray, limit: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, squared distance) of the candidates of list ``one`` that no test rejects, ``limit`` being each query's."""
        lo, hi = np.searchsorted(self.lists, [one, one + 1])
        rows = self.rotated[lo:hi]
        slack = 16 * self.dim * np.finfo(float).eps * ((rotated**2).sum(1) + np.where(np.isfinite(limit), limit, 0))
        q, x = np.nonzero(uids[:, None] != self.uids[None, lo:hi])
        partial, d = np.zeros(len(q)), 0
        self.pairs += len(q)
        while d < self.dim:
            width = min(COLUMNS, self.dim - d)
            if d == 0:  # dense: all pairs at once
                a, b = rotated[:, :width], rows[:, :width]
                partial = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)[q, x]
            else:
                partial = partial + ((rotated[q, d : d + width] - rows[x, d : d + width]) ** 2).sum(1)
            d += width
            self.scanned += len(q) * width
            if d < self.dim:
                keep = partial * self.dim / d <= (limit * (1 + epsilon * np.sqrt((1 - d / self.dim) / d)) ** 2 + slack)[q]
                q, x, partial = q[keep], x[keep], partial[keep]
        whole = ((self.vectors[lo + x] - exact[q]) ** 2).sum(1)
        keep = whole <= limit[q]
        return q[keep], lo + x[keep], whole[keep]


def best_of(k: int, q: np.ndarray, ids: np.ndarray, whole: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k nearest of each query, ties to smaller ids, in order."""
    order = np.lexsort((ids, whole, q))
    rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    order = order[rank < k]
    return tuple(c[order] for c in (q, ids, whole, *more))


def search_block(block: Block, asked: list[np.ndarray], uids: np.ndarray, exact: np.ndarray, rotated: np.ndarray, limit: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, ...]:
    """(query, id, squared distance) of the k nearest of each query among the lists ``asked`` (an array for each query) of this block."""
    who = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    which = np.concatenate(asked) if len(asked) else np.zeros(0, int)
    order = np.argsort(which, kind="stable")
    which, who = which[order], who[order]
    limit = limit.copy()
    held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
    for one in np.unique(which):
        some = who[slice(*np.searchsorted(which, [one, one + 1]))]
        for at in range(0, len(some), 256):  # bounds the pairs held at once
            part = some[at : at + 256]
            q, x, whole = block.scan(one, uids[part], exact[part], rotated[part], limit[part], k, epsilon)
            if len(q):
                held = best_of(k, *map(np.concatenate, zip(held, (part[q], block.ids[x], whole))))
                last = np.searchsorted(held[0], np.arange(len(asked)), side="right") - 1
                full = np.flatnonzero(last - np.searchsorted(held[0], np.arange(len(asked))) == k - 1)
                limit[full] = np.minimum(limit[full], held[2][last[full]])
    return held


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ok)


def _pack(sizes: np.ndarray, centroids: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of every list and the number of blocks: nearby lists share one until it is full."""
    left, order = set(range(len(sizes))), []
    at = 0
    while left:  # a walk from each list to the nearest one left
        rest = np.fromiter(left, int)
        at = int(rest[np.argmin(((centroids[rest] - centroids[at]) ** 2).sum(1))])
        left.discard(at)
        order.append(at)
    first, count, block, filled = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    for one in order:
        n = int(sizes[one])
        if filled and filled + n > block_rows:
            block, filled = block + 1, 0
        first[one], count[one] = block, max(1, -(-n // block_rows))
        if count[one] > 1:
            block, filled = block + int(count[one]), 0
        else:
            filled += n
    return first, count, block + 1


def search(vectors: DataFrame, queries, k: int = K, probe_rows: int = PROBE_ROWS, probe_share: float | None = None, block_rows: int = BLOCK_ROWS, max_lists: int = MAX_LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; ``queries``: a condition on vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    x = _valid(vectors)
    common = x.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(queries).alias("asked")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = common["dim"], common["n"]
    x = x.where(F.size("v") == dim)
    turn = rotation(dim)
    part = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE_ROWS / total) * (1 << 30)))
    n_lists = int(min(max_lists, max(1, total // LIST_ROWS)))

    def fit(batches):
        import pyarrow as pa

        rows = sorted(v for b in batches for v in b.column("v").to_pylist())
        rows = np.array(rows).reshape(-1, dim) @ turn
        held = np.random.default_rng(2).permutation(len(rows)) % 4 == 0  # rows that centroids were fitted on lie too close to them
        c = centroids_of(rows[~held], n_lists) if len(rows) > 1 else np.zeros((1, dim))
        yield pa.RecordBatch.from_pydict({"c": pa.array([c.tobytes()], pa.binary()), "share": pa.array([share_needed(rows[held], c, k)])})

    fitted = x.where(part).select("v").repartition(1).mapInArrow(fit, "c binary, share double").collect()
    lists = np.frombuffer(fitted[0]["c"]).reshape(-1, dim) if fitted else np.zeros((1, dim))
    centroids = spark.sparkContext.broadcast(lists)  # max_lists * dim doubles at most

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            v = np.array(b.column("v").to_pylist()).reshape(-1, dim)
            own = nearest(v @ turn, centroids.value) if len(v) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], names=[*b.schema.names, "list"])

    indexed = scratch.save(x.mapInArrow(assign, "vec_id long, v array<double>, list int").withColumn("uid", F.monotonically_increasing_id()), "lists")
    sizes = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_lists rows at most
    n_of = np.array([sizes.get(i, 0) for i in range(len(lists))])
    first, count, _ = _pack(n_of, lists, block_rows)
    share = probe_share if probe_share is not None else fitted[0]["share"] if fitted else 1.0
    seed, most = max(4 * k, int(SEED_SHARE * total)), max(probe_rows, int(share * total))
    deals = max(1, -(-common["asked"] // block_rows))  # blocks of queries

    def probe(after: int, upto: int):
        """Each query with the blocks that hold its lists: from the one past ``after`` rows to the one that reaches ``upto``."""

        def run(batches):
            import pyarrow as pa

            for b in batches:
                v = np.array(b.column("v").to_pylist()).reshape(-1, dim)
                rows, where, which = [], [], []
                for i, q in enumerate(v @ turn):
                    order = np.argsort(((centroids.value - q) ** 2).sum(1), kind="stable")
                    before = np.cumsum(n_of[order]) - n_of[order]
                    own = order[(before >= after) & (before < upto) & (n_of[order] > 0)] if after else order[(before < upto) & (n_of[order] > 0)]
                    single = own[count[own] == 1]
                    for block in np.unique(first[single]).tolist():
                        rows.append(i), where.append(block), which.append(single[first[single] == block])
                    for one in own[count[own] > 1].tolist():
                        for block in range(first[one], first[one] + count[one]):
                            rows.append(i), where.append(block), which.append(np.array([one]))
                cut = np.concatenate([[0], np.cumsum([len(w) for w in which])]).astype(np.int32)
                asked = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, np.int32), *which]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int32())) for c in b.columns], pa.array(where, pa.int32()), asked], names=[*b.schema.names, "block", "asked"])

        return run

    deal = F.pmod(F.xxhash64(F.lit(4), "uid"), F.lit(deals)).cast("int")
    asking = indexed.where(queries).select("uid", F.col("vec_id").alias("query_id"), "v")
    at = lambda values: F.element_at(F.array(*[F.lit(int(n)) for n in values]), F.col("list") + 1)
    held = indexed.withColumn("block", (at(first) + F.pmod(F.xxhash64(F.lit(9), "uid"), at(count))).cast("int"))
    held = held.select("uid", "vec_id", "v", "list", "block")
    out = "uid long, query_id long, vec_id long, whole double"

    def scan(key, left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "whole": pa.array([], pa.float64())})
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        v, exact = matrix(right), matrix(left)
        block = Block(right.column("list").to_numpy(), right.column("uid").to_numpy(), right.column("vec_id").to_numpy(), v, v @ turn)
        asked = left.column("asked").combine_chunks()
        asked = np.split(asked.flatten().to_numpy(), np.cumsum(np.diff(asked.offsets.to_numpy()))[:-1])
        uids = left.column("uid").to_numpy()
        q, ids, whole = search_block(block, asked, uids, exact, exact @ turn, left.column("limit").to_numpy().copy(), k)
        return pa.table({"uid": pa.array(uids[q]), "query_id": left.column("query_id").take(pa.array(q)), "vec_id": pa.array(ids), "whole": pa.array(whole)})

    keys = ["block", "deal"]
    # Spark keeps the k best of each task before the shuffle (WindowGroupLimit)
    by_score = Window.partitionBy("uid").orderBy("whole", "vec_id")

    def nearest_of(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("deal", deal)
        pairs = asked.select("block", F.col("deal").alias("by")).distinct()
        met = held.join(pairs, "block").withColumnRenamed("by", "deal")  # a row goes to the deals that probe its block, and to no other
        found = asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(scan, out)
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    sent, none = "uid long, query_id long, v array<double>, limit double, block int, asked array<int>", F.lit(float("inf"))
    near = scratch.save(nearest_of(asking.withColumn("limit", none).mapInArrow(probe(0, seed), sent)), "near")
    limits = near.groupBy("uid").agg(F.when(F.count(F.lit(1)) == k, F.max("whole")).alias("limit"))
    rest = asking.join(limits, "uid", "left").withColumn("limit", F.coalesce("limit", none)).mapInArrow(probe(seed, most), sent)
    found = near.drop("rank").unionByName(nearest_of(rest).drop("rank"))
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.sqrt("whole").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
