"""Repeated byte strings by sampled prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
doc_id. Ranking every position is out of reach (each byte of text would cost some 16 bytes in every
round), so positions are sampled such that nothing is lost: of the 16-byte strings inside each
window of 50 bytes the one with the smallest hash is the window's anchor; equal windows have equal anchors.

Sixteen bytes are too few to name an anchor: in n times the text n squared times as many pairs of places share them by chance. So an anchor
has one or two names of 33 bytes: windows that start 17 bytes or more before it hold the 33 bytes that end with the anchor, the
others those that begin with it. Each name goes on as an anchor of its own with its part of the windows.

Round one ranks all anchors by a 64-bit hash of these 33 bytes; those of one text alone are
unique and done. Round two: the anchors left go out with the bytes of their windows, which are ranked at
50 bytes, past the threshold, as strings at growing distance before the anchor; a window is repeated where
its rank came before in a smaller doc_id. Names only propose: a byte goes after the bytes of both windows were compared.

Names cross the network once in round one; a task ranks those of its part. Hot ranks: of a name that more than ``HOT`` of the texts counted at
once hold, only their sum is ranked; the texts are joined to the result, so that Spark can split a hot rank over tasks. Before round two every task merges its anchors that lie in equal
surroundings: of a line that a text repeats, one is sent for all, and copies in larger doc_ids are settled on the
spot. What is left of a rank with more than ``crowd`` anchors is not held by one task: Spark settles equal surroundings
among all tasks in the same way, and the windows of what stays become rows, of which it takes the smallest doc_id; both by partial sums over
128-bit names (2e-13 false matches are expected among 1e13 of them).

Defined results: null and empty texts have 0 bytes and lose none; texts of fewer than 50 bytes lose
none; a null doc_id counts as the largest; repeated doc_ids are not smaller than each other; repeated rows
have equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import _BYTE, Scratch, U, chunks, powers, mix, rolling, table, texts_of, window_hash

LENGTH = 50
SEED_BYTES = 16
CROWD = 128  # anchors of a rank that one task holds; windows of the others are rows of their own
MERGED = 1 << 15  # anchors of a task that are merged at once
NAMED = 1 << 20  # names of a task that are counted at once
HOT = 16  # texts that a name has among them; of one that has more the sum goes on
PART = 1 << 21  # names that a task ranks
PLAIN, SUM, MEMBER = 0, 1, 2  # rows of names: of a text; of all texts of a hot name that were counted at once; of one of these
_CHUNK = 1 << 18
_MASK = U(0xFFFFFFFF)


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if width > n else v


def step(length: int) -> int:
    """How far an anchor's first name lies before its second."""
    return (length - SEED_BYTES + 1) // 2


def reach_of(length: int) -> int:
    """How far before a name's place the windows that hold it may start; names have ``length`` less that many bytes."""
    return length - SEED_BYTES - step(length)


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, name of its bytes, first and last window start, text number) of each named anchor of these texts."""
    if len(data) < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    start = np.arange(len(data) - SEED_BYTES + 1)
    prefix = rolling(_BYTE[data])
    least = _slide_min((window_hash(prefix, start, start + SEED_BYTES) & ~_MASK) | start.astype(np.uint64), length - SEED_BYTES + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + length <= bounds[text + 1])
    seed = (least[valid] & _MASK).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, int)
    last = np.concatenate([cut[1:], [len(seed)]])[: len(cut)] - 1
    seed, first, last, text = seed[cut], valid[cut], valid[last], text[valid[cut]]
    before = seed - step(length)  # windows from here on back have their name here, the others at the seed
    place, first, last = (np.stack(pair, 1).ravel() for pair in ((before, seed), (first, np.maximum(first, before + 1)), (np.minimum(last, before), last)))
    kept = np.flatnonzero(first <= last)
    place = place[kept]
    return place, window_hash(prefix, place, place + length - reach_of(length)), first[kept], last[kept], text[kept // 2]


def _emit(length: int):
    def run(batches):
        seen: set[int] = set()  # texts of this task: a copy adds nothing
        parts: list[tuple] = []
        for batch in _then_none(batches):
            if batch is not None:
                data, offsets = texts_of(batch.column("text"))
                x = batch.column("x").to_numpy()
                new = np.zeros(len(x), bool)
                for i, v in enumerate(x.tolist()):
                    new[i] = v not in seen
                    seen.add(v)
                for lo, hi in chunks(offsets, _CHUNK):
                    if new[lo:hi].any():
                        _, name, _, _, text = anchors_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                        own = new[lo + text]
                        parts.append((name[own].view(np.int64), x[lo + text[own]]))
            if parts and (batch is None or sum(len(p[0]) for p in parts) >= NAMED):
                yield _counted(*(np.concatenate(c) for c in zip(*parts)))
                parts = []

    return run


def _counted(h: np.ndarray, x: np.ndarray):
    """(name, text, how often) of these anchors; names of more than HOT texts apart, with one row for their sum."""
    import pyarrow as pa

    order = np.lexsort((x, h))
    h, x = h[order], x[order]
    first = np.flatnonzero(_changes(h) | _changes(x))
    h, x, c = h[first], x[first], np.diff(np.append(first, len(h)))
    begin = np.flatnonzero(_changes(h))
    size = np.diff(np.append(begin, len(h)))
    hot = size > HOT
    kind = np.repeat(np.where(hot, MEMBER, PLAIN), size)
    columns = np.append(h, h[begin[hot]]), np.append(x, x[begin[hot]]), np.append(c, np.add.reduceat(c, begin)[hot] if len(h) else c), np.append(kind, np.full(hot.sum(), SUM))
    by_text = np.argsort(columns[1], kind="stable")
    h, x, c, kind = (v[by_text] for v in columns)  # texts in runs: they take little room
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(c), pa.array(kind.astype(np.int8))], names=["h", "x", "c", "kind"])


def _changes(v: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    return np.concatenate([np.ones(min(1, len(v)), bool), v[1:] != v[:-1]])


def _ranked(crowd: int):
    """Of the names of a part those of more than one text, with whether more than ``crowd`` anchors have them."""

    def run(batches):
        import pyarrow as pa

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        h, x, c, kind = (np.concatenate([b.column(name).to_numpy() for b in held]) for name in ("h", "x", "c", "kind"))
        del held
        order = np.argsort(h)
        h, x, c, kind = h[order], x[order], c[order], kind[order]
        begin = np.flatnonzero(_changes(h))
        size = np.diff(np.append(begin, len(h)))
        shared = (np.minimum.reduceat(x, begin) < np.maximum.reduceat(x, begin)) | (np.maximum.reduceat(kind, begin) == SUM)
        kept, crowded = np.flatnonzero(np.repeat(shared, size)), np.repeat(np.add.reduceat(c, begin) > crowd, size)
        for at in range(0, len(kept), 1 << 16):
            rows = kept[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(v[rows]) for v in (h, x, crowded, kind == SUM)], names=["h", "x", "crowded", "sum"])

    return run


def _contexts(length: int):
    reach, width = reach_of(length), length + reach_of(length)

    def run(batches):
        import pyarrow as pa

        parts: list[tuple] = []
        for batch in _then_none(batches):
            if batch is not None:
                data, offsets = texts_of(batch.column("text"))
                (few, to), (many, till) = (_lists(batch.column(c)) for c in ("few", "many"))
                d, x = batch.column("d").to_numpy(), batch.column("x").to_numpy()
                for lo, hi in chunks(offsets, _CHUNK):
                    part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                    place, name, first, last, text = anchors_of(part, bounds, length)
                    cut = np.searchsorted(text, np.arange(hi - lo + 1))
                    kind = np.zeros(len(place), np.int8)
                    for i in range(hi - lo):
                        own = name[cut[i] : cut[i + 1]].view(np.int64)
                        kind[cut[i] : cut[i + 1]] = np.isin(own, few[to[lo + i] : to[lo + i + 1]]) + 2 * np.isin(own, many[till[lo + i] : till[lo + i + 1]])
                    kept = np.flatnonzero(kind)
                    least, most = place[kept] - last[kept], place[kept] - first[kept]
                    column = np.arange(width)[None, :]
                    inside = (column >= (reach - most)[:, None]) & (column < (reach - least + length)[:, None])
                    held = np.where(inside, part[np.clip(place[kept][:, None] + column - reach, 0, max(0, len(part) - 1))], 0).astype(np.uint8) if len(kept) else np.zeros((0, width), np.uint8)
                    start = (place[kept] - bounds[text[kept]]).astype(np.int32)
                    parts.append((name[kept].view(np.int64), kind[kept] == 2, d[lo + text[kept]], x[lo + text[kept]], start, least.astype(np.int32), most.astype(np.int32), held))
                    if sum(len(p[0]) for p in parts) >= MERGED:
                        yield _merged(pa, parts)
                        parts = []
        if parts:
            yield _merged(pa, parts)

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column."""
    return column.values.to_numpy(), column.offsets.to_numpy()


def surroundings(h, lo, hi, held, seed: int = 0) -> np.ndarray:
    """A name of 64 bits for what merge() compares."""
    key = mix(h.view(np.uint64) ^ (lo * 64 + hi).astype(np.uint64) + U(seed))
    words = np.pad(held, ((0, 0), (0, -held.shape[1] % 8))).view(np.uint64)
    for j in range(words.shape[1]):
        key = mix(key + words[:, j])
    return key


def merge(h, d, x, a, lo, hi, held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in equal surroundings: (their order, for each in it the place of the one that goes for it, whether a smaller d settles it)."""
    key = surroundings(h, lo, hi, held)
    order = np.lexsort((a, x, d, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    one, two = order, order[head]
    equal = (h[one] == h[two]) & (lo[one] == lo[two]) & (hi[one] == hi[two]) & (held[one] == held[two]).all(1)
    settled = equal & (d[one] > d[two])
    owner = np.where(equal & (d[one] == d[two]) & (x[one] == x[two]), head, np.arange(len(order)))
    return order, owner, settled


def _merged(pa, parts: list[tuple]):
    h, crowded, d, x, a, lo, hi, held = (np.concatenate(c) for c in zip(*parts))
    order, owner, settled = merge(h, d, x, a, lo, hi, held)
    own = np.flatnonzero(owner == np.arange(len(order)))
    by_owner = np.argsort(owner, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(order))[own])]).astype(np.int32)
    rows, done = order[own], settled[own]
    bits = ((np.int64(1) << (hi - lo + 1).astype(np.int64)) - 1) << lo.astype(np.int64)
    size = np.where(done, 0, held.shape[1])
    data = pa.py_buffer(np.ascontiguousarray(held[rows[~done]]))
    bytes_ = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), data])
    places = pa.ListArray.from_arrays(pa.array(cut), pa.array(a[order[by_owner]]))
    many = crowded[rows] & ~done
    names = np.zeros((2, len(rows)), np.uint64)
    for seed in (0, 1):
        names[seed, many] = surroundings(*(c[rows[many]] for c in (h, lo, hi, held)), seed + 1)
    columns = [pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), pa.array(h[rows]), pa.array(crowded[rows]), pa.array(d[rows]), pa.array(x[rows]), places, pa.array(lo[rows]), pa.array(hi[rows]), bytes_, pa.array(np.where(done, bits[rows], 0))]
    return pa.RecordBatch.from_arrays(columns, names=["s1", "s2", "h", "crowded", "d", "x", "a", "lo", "hi", "held", "mask"])


def _matrix(column, width: int) -> np.ndarray:
    data, offsets = texts_of(column)
    return data[offsets[0] : offsets[-1]].reshape(-1, width)


def _prefix(held: np.ndarray) -> np.ndarray:
    out = np.zeros((held.shape[0], held.shape[1] + 1), np.uint64)
    np.cumsum(_BYTE[held] * powers(U(0x9E3779B97F4A7C15), held.shape[1])[None, :], axis=1, out=out[:, 1:])
    return out


def repeated_windows(h: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, held: np.ndarray, length: int) -> np.ndarray:
    """A bit mask for each anchor: bit t if its window that starts t bytes before it starts in a smaller d too. Rows in the order of (h, d)."""
    reach = reach_of(length)
    mask, group = np.zeros(len(h), np.int64), mix(h.view(np.uint64))
    ranks = np.empty((reach + 1, len(h)), np.uint64)
    for at in range(0, len(h), 1 << 15):  # bounds what the prefix sums take
        prefix = _prefix(held[at : at + (1 << 15)])
        for t in range(reach + 1):
            ranks[t, at : at + (1 << 15)] = prefix[:, reach - t + length] - prefix[:, reach - t]
    for t in range(reach + 1):
        rows = np.flatnonzero((lo <= t) & (t <= hi))
        if len(rows) < 2:
            continue
        rank = mix(ranks[t, rows] ^ group[rows])
        order = np.argsort(rank)
        rank, rows = rank[order], rows[order]
        new = np.concatenate([[True], rank[1:] != rank[:-1]])
        head = np.minimum.reduceat(rows, np.flatnonzero(new))[np.cumsum(new) - 1]  # of a rank, the first row has the smallest d
        later = np.flatnonzero(d[rows] > d[head])
        rows, head, at = rows[later], head[later], reach - t
        mask[rows[(held[rows, at : at + length] == held[head, at : at + length]).all(1)]] |= 1 << t
    return mask


def _judge(length: int):
    width = length + reach_of(length)

    def run(batches):
        import pyarrow as pa

        kept = None
        for batch in _then_none(batches):
            own = None if batch is None else pa.Table.from_batches([batch])
            kept = own if kept is None else kept if own is None else pa.concat_tables([kept, own])
            if kept is None or (batch is not None and kept.num_rows < 50_000):
                continue
            h = kept.column("h").to_numpy()
            end = len(h) if batch is None else int(np.searchsorted(h, h[-1], side="left"))  # whole ranks only
            now, kept = kept.slice(0, end).combine_chunks(), kept.slice(end)
            if now.num_rows:
                d = now.column("d").to_numpy()
                mask = repeated_windows(h[:end], d, now.column("lo").to_numpy(), now.column("hi").to_numpy(), _matrix(now.column("held").combine_chunks(), width), length)
                hit = pa.array(np.flatnonzero(mask))
                out = now.select(["d", "x", "a"]).take(hit).append_column("mask", pa.array(mask[mask != 0]))
                yield from out.to_batches()

    return run


def _then_none(batches):
    yield from batches
    yield None


def _windows(length: int):
    reach, width = reach_of(length), length + reach_of(length)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lo, hi = part.column("lo").to_numpy(), part.column("hi").to_numpy()
                held = _matrix(part.column("held"), width)
                rows = np.repeat(np.arange(len(lo)), hi - lo + 1)
                t = np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[rows]
                ranks = [window_hash_at(_prefix(bytes_), rows, reach - t, reach - t + length) for bytes_ in (held, held ^ 0xA7)]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*[pa.array(r.view(np.int64)) for r in ranks], *[part.column(c).take(take) for c in ("d", "id")], pa.array(t.astype(np.int32))], names=["r1", "r2", "d", "id", "t"])

    return run


def window_hash_at(prefix: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end of each row, wherever they lie in it."""
    inverse = powers(U(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), prefix.shape[1])
    return mix((prefix[rows, end] - prefix[rows, start]) * inverse[start])


def _cut(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            removed, spans, sha = [], [], []
            found = batch.column("found")
            places, masks = found.values.field("a"), found.values.field("mask").to_numpy()
            cut, starts, values = found.offsets.to_numpy(), places.offsets.to_numpy(), places.values.to_numpy()
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = slice(cut[i], cut[i + 1])
                mask = np.repeat(masks[own], np.diff(starts[cut[i] : cut[i + 1] + 1]))
                a = values[starts[cut[i]] : starts[cut[i + 1]]].astype(np.int64)
                start = np.concatenate([a[(mask >> t) & 1 == 1] - t for t in range(reach_of(length) + 1)])
                cover = np.bincount(start, minlength=len(text) + 1) - np.bincount(start + length, minlength=len(text) + 1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]))
                sha.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("x"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["d", "x", "n_removed", "n_spans", "kept_sha256"])

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    last = (1 << 63) - 1
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("d"))
    x = x.withColumns({"x": F.xxhash64("text", F.octet_length("text")), "y": F.xxhash64(F.lit(3), "text")})  # a text's name has 128 bits
    slim = scratch.save(x.select("doc_id", "d", "x", "y", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "slim")
    firsts = scratch.save(slim.groupBy("x", "y").agg(F.min("d").alias("d")), "firsts")

    anchors = scratch.save(x.where(F.octet_length("text") >= length).select("text", "x").mapInArrow(_emit(length), "h long, x long, c long, kind byte"), "anchors")
    plain = anchors.where(F.col("kind") != MEMBER)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-plain.count() // PART))
    ranks = scratch.save(plain.repartition(parts, "h").mapInArrow(_ranked(crowd), "h long, x long, crowded boolean, sum boolean"), "ranks")
    members = anchors.where(F.col("kind") == MEMBER).select("h", "x").join(ranks.where("sum").select("h", "crowded").distinct(), "h")
    shared = scratch.save(ranks.where("not sum").select("h", "x", "crowded").unionByName(members), "shared")
    scratch.drop("anchors", "ranks")
    lists = shared.groupBy("x").agg(F.collect_set(F.when(~F.col("crowded"), F.col("h"))).alias("few"), F.collect_set(F.when(F.col("crowded"), F.col("h"))).alias("many"))

    own = lists.join(firsts.select("x", "d").distinct(), "x")
    held = x.select("d", "x", "text").join(own, ["d", "x"]).select("d", "x", "text", "few", "many")
    made = "s1 long, s2 long, h long, crowded boolean, d long, x long, a array<int>, lo int, hi int, held binary, mask long"
    held = scratch.save(held.mapInArrow(_contexts(length), made), "contexts")
    scratch.drop("shared")

    place = ["d", "x", "a"]
    found = held.where("mask = 0 and not crowded").select("h", *place, "lo", "hi", "held").repartition("h").sortWithinPartitions("h", "d").mapInArrow(_judge(length), "d long, x long, a array<int>, mask long")
    found = scratch.save(found, "found").unionByName(held.where("mask <> 0").select(*place, "mask"))

    crowds = held.where("mask = 0 and crowded")
    least = scratch.save(crowds.groupBy("s1", "s2").agg(F.min("d").alias("least")), "least")
    crowds = crowds.join(least, ["s1", "s2"]).withColumn("mask", F.when(F.col("d") > F.col("least"), F.expr("shiftleft(shiftleft(1L, hi - lo + 1) - 1, lo)")).otherwise(F.lit(0)))
    crowds = scratch.save(crowds.select(F.monotonically_increasing_id().alias("id"), *place, "lo", "hi", "held", "mask"), "crowds")
    windows = crowds.where("mask = 0").mapInArrow(_windows(length), "r1 long, r2 long, d long, id long, t int")
    least = scratch.save(windows.groupBy("r1", "r2").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").drop("most"), "least-2")
    later = windows.join(least, ["r1", "r2"]).where("d > least").groupBy("id").agg(F.expr("bit_or(shiftleft(1L, t))").alias("mask"))
    later = crowds.select("id", *place).join(scratch.save(later, "later"), "id").drop("id")

    found = found.unionByName(crowds.where("mask <> 0").select(*place, "mask")).unionByName(later).groupBy("d", "x").agg(F.collect_list(F.struct("a", "mask")).alias("found"))
    parts = scratch.save(x.select("d", "x", "text").join(found, ["d", "x"]).mapInArrow(_cut(length), "d long, x long, n_removed long, n_spans long, kept_sha256 string"), "parts").dropDuplicates(["d", "x"])
    scratch.drop("contexts", "found", "least", "crowds", "least-2", "later")

    out = slim.join(firsts.withColumnRenamed("d", "first"), ["x", "y"]).join(parts, ["d", "x"], "left")
    copy = (F.col("d") > F.col("first")) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
