"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its lower-cased words and their first four and five bytes (stems of inflected
insults), hashed into 2 ** 20 places. Every place that ``MIN_ROWS`` rows hold enters the model; it
scores w0 + sum w_i + sum over pairs <v_i, v_j> of the places present, so that two terms can mean
together what neither means alone. It is fitted on the log loss, in one task, on a bounded sample of
labelled rows: first by Adam on the places whose presence alone tells labels apart, then from there by
AdaGrad on all places, under the same penalty. Of these rounds the one with the least loss on a fifth of the
rows, held back, is taken, without the places whose weights these rows do not need; if that is the start, the start fitted on all rows is the model. Scoring is one
pass over the texts without a shuffle; the model that goes to all tasks takes 40 bytes a place (42 MB at most).

Defined results: a null or empty text gets the score of no terms; a null doc_id is held out (never
learnt from); null labels are not learnt from; repeated rows are scored alike; with labels of one
class only or none, every score is the rate of toxic labels ((positives + 1) / (rows + 2)); an empty
table gives an empty table; other columns stay, ``held_out score predicted`` are written over.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import U, chunks, map_rows, spans_of, table, texts_of, window_hash

BITS = 20
STEMS = (4, 5, 1 << 40)  # bytes of a word that make a term; the last is the whole word
FIT_ROWS = 20_000  # labelled rows that the fit uses, about; chosen by hash of doc_id
MAX_TERMS = 4096  # that the fit starts from
MIN_ROWS = 5  # labelled rows that a term must be in
MIN_Z = 4.5  # standard errors by which the toxic rate of a term must differ for the fit to start from it
FACTORS = 8
STEPS = 300
EPOCHS = 8  # over all terms
LEAST_STEPS = 160  # over all terms, for few rows
BATCH = 256  # rows in a step over all terms
L2_W, L2_V = 1e-5, 1e-4
SPARE = 1e-3  # of log loss a row
PRUNE = (0.3, 0.2, 0.1, 0.05, 0.02)  # weights below which a place may go: the first that costs no more than SPARE


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text number) of every term of these texts, repeats included."""
    start, end, text, prefix = spans_of(data, bounds)
    places = [window_hash(prefix, start, np.minimum(end, start + k)) + U(k) for k in STEMS]
    return np.concatenate([(p >> U(64 - BITS)).astype(np.int32) for p in places]), np.tile(text, len(STEMS))


def _each(batch):
    """(first row, last row + 1, places, row numbers) for chunks of the batch."""
    data, offsets = texts_of(batch.column("text"))
    for lo, hi in chunks(offsets):
        place, text = _terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, place, text


def _features(batches):
    import pyarrow as pa

    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, hi, place, text in _each(batch):
            both = np.unique(text.astype(np.int64) << BITS | place)
            cut = np.searchsorted(both >> BITS, np.arange(hi - lo + 1))
            found = (both & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(label[lo:hi], pa.int32()), "places": pa.array([found[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _row_sums(z: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of as many rows of ``z`` as ``counts`` says, one after the other."""
    out, some = np.zeros((len(counts), z.shape[1])), counts > 0
    if some.any():
        out[some] = np.add.reduceat(z, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.float64)
    return out


def _scores(z: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores without w0 of rows that hold these places, given as (w, v) each; and the sums of (w, v)."""
    total = _row_sums(z, counts)
    squares = _row_sums((z[:, 1:] ** 2).sum(1)[:, None], counts)[:, 0]
    return total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - squares), total


def _step_rows(rows: list[np.ndarray], index: np.ndarray) -> tuple:
    """A step's places by place: row numbers, distinct places, where each begins, its number for each; their order by row, and the rows' sizes."""
    cols = [c[c >= 0] for c in (index[r] for r in rows)]
    counts = np.array([len(c) for c in cols])
    col = np.concatenate(cols)
    order = np.argsort(col, kind="stable")
    row = np.repeat(np.arange(len(rows), dtype=np.int32), counts)[order]
    own, first, local = np.unique(col[order], return_index=True, return_inverse=True)
    return row, own, first, local.astype(np.int32), np.argsort(row, kind="stable").astype(np.int32), counts


def fit_machine(y: np.ndarray, rows: list[np.ndarray], factors: int = FACTORS, steps: int = STEPS) -> dict:
    """The machine from labels and each row's distinct places, all that MIN_ROWS rows hold."""
    if len(y) < 5 or y.sum() in (0, len(y)):
        return fit_start(y, rows, factors, steps)
    n = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    places = np.flatnonzero(n >= MIN_ROWS).astype(np.int32)
    index = np.full(1 << BITS, -1, np.int32)
    index[places] = np.arange(len(places))
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    held, learnt = order[: len(y) // 5], order[len(y) // 5 :]
    start = fit_start(y[learnt], [rows[i] for i in learnt], factors, steps)
    p = np.zeros((len(places), 1 + factors), np.float32)
    p[:, 1:] = rng.normal(0, 0.01, (len(places), factors))  # small: a text has hundreds of places
    at = index[start["places"]]
    p[at, 0], p[at, 1:] = start["w"], start["v"]
    w0, moved = start["w0"], np.full(p.shape, 0.01, np.float32)
    split = lambda ids: [(y[ids[i : i + BATCH]], _step_rows([rows[j] for j in ids[i : i + BATCH]], index)) for i in range(0, len(ids), BATCH)]
    tests, parts = split(held), [x for x in split(learnt) if len(x[1][1])]

    def loss(p) -> float:
        out = 0.0
        for t, (_, own, _, local, back, counts) in tests:
            s = w0 + _scores(p[own][local[back]], counts)[0]
            out += np.logaddexp(0, np.where(t > 0, -s, s)).sum()
        return out

    plain = np.zeros_like(p)
    plain[at] = p[at]
    least, best = loss(plain), None
    steps_of = np.bincount(np.concatenate([x[1][1] for x in parts]), minlength=len(places)) if parts else None
    l2 = len(learnt) * np.array([L2_W] + [L2_V] * factors, np.float32)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // len(parts))) if parts else 0):
        for i in rng.permutation(len(parts)):
            t, (row, own, first, local, back, counts) = parts[i]
            q = p[own]
            s, total = _scores(q[local[back]], counts)
            g = (1 / (1 + np.exp(-np.clip(w0 + s, -30, 30))) - t).astype(np.float32)
            total = total.astype(np.float32)
            total[:, 0] = 1
            grad = np.add.reduceat((g[:, None] * total)[row], first, axis=0)
            grad[:, 1:] -= np.add.reduceat(g[row], first)[:, None] * q[:, 1:]
            grad = (grad + l2 * q / steps_of[own, None].astype(np.float32)) / len(t)
            moved[own] += grad**2
            p[own] = q - 0.1 * grad / np.sqrt(moved[own])
        now = loss(p)
        if now < least:
            least, best = now, p.copy()
    if best is None:
        return fit_start(y, rows, factors, steps)
    size = np.abs(best).max(1)
    for small in PRUNE:  # places of hardly any weight cost time in every text: they go as far as the rows held back don't mind
        kept = size >= small
        if kept.any() and loss(np.where(kept[:, None], best, 0)) <= least + SPARE * len(held):
            places, best = places[kept], best[kept]
            break
    return {"w0": w0, "places": places, "w": best[:, 0], "v": best[:, 1:]}


def fit_start(y: np.ndarray, rows: list[np.ndarray], factors: int = FACTORS, steps: int = STEPS) -> dict:
    """The machine from those places alone that tell labels apart on their own."""
    base = {"w0": float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), "places": np.zeros(0, np.int32), "w": np.zeros(0, np.float32), "v": np.zeros((0, factors), np.float32)}
    if y.sum() in (0, len(y)):
        return base
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate(rows)
    n = np.bincount(place, minlength=1 << BITS).astype(float)
    pos = np.bincount(place, weights=y[row], minlength=1 << BITS)
    rate = y.mean()
    z = np.abs(pos - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-9)
    z[n < MIN_ROWS] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:MAX_TERMS])
    best = best[z[best] >= MIN_Z].astype(np.int32)
    if not len(best):
        return base
    index = np.full(1 << BITS, -1, np.int64)
    index[best] = np.arange(len(best))
    keep = index[place] >= 0
    row, col = row[keep], index[place[keep]]
    rng = np.random.default_rng(7)
    m, k = len(y), factors
    params = [np.array([base["w0"]]), np.zeros(len(best)), rng.normal(0, 0.05, (len(best), k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w0, w, v = params
        vs = v[col]
        total = np.stack([np.bincount(row, weights=vs[:, f], minlength=m) for f in range(k)], axis=1)
        pair = 0.5 * ((total**2).sum(1) - np.bincount(row, weights=(vs**2).sum(1), minlength=m))
        p = 1 / (1 + np.exp(-np.clip(w0[0] + np.bincount(row, weights=w[col], minlength=m) + pair, -30, 30)))
        g = (p - y) / m
        each = g[row][:, None] * (total[row] - vs)
        gv = np.stack([np.bincount(col, weights=each[:, f], minlength=len(best)) for f in range(k)], axis=1)
        grads = [np.array([g.sum()]), np.bincount(col, weights=g[row], minlength=len(best)) + L2_W * w, gv + L2_V * v]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            params[i] = params[i] - 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return {"w0": float(params[0][0]), "places": best, "w": params[1].astype(np.float32), "v": params[2].astype(np.float32)}


def _fit(batches):
    import pyarrow as pa

    y, rows = [], []
    for batch in batches:
        y += batch.column("toxic").to_pylist()
        rows += batch.column("places").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (rows[i], y[i]))  # the fit depends on the order
    y, rows = [y[i] for i in order], [np.frombuffer(rows[i], np.int32) for i in order]
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit_machine(np.array(y, dtype=float), rows))], pa.binary())})


def held_out(doc_id):
    """Rows never learnt from: crc32 of doc_id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The machine from labelled rows that are not held out, about ``fit_rows`` of them at most."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic").mapInArrow(_features, "toxic int, places binary")
    models = rows.repartition(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fit_machine(np.zeros(0), [])


def score(docs: DataFrame, machine: dict) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    docs = docs.drop("held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches):
        import pyarrow as pa

        model = sent.value
        index = np.full(1 << BITS, -1, np.int32)
        index[model["places"]] = np.arange(len(model["places"]))
        p = np.concatenate([model["w"][:, None], model["v"]], axis=1)
        for batch in batches:
            out = np.full(batch.num_rows, model["w0"])
            for lo, hi, place, text in _each(batch):
                col = index[place]
                both = np.unique(text[col >= 0].astype(np.int64) << BITS | col[col >= 0])
                counts = np.bincount(both >> BITS, minlength=hi - lo)
                out[lo:hi] += _scores(p[both & ((1 << BITS) - 1)], counts)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=[*batch.schema.names, "score"])

    out = map_rows(docs, scored, score=T.DoubleType())
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
