"""Quality by co-training of two views.

The content view sees the text alone (word, repeat, letter and symbol statistics), the metadata view
sees lang, source and n_chars alone. Each is a logistic regression. In every round each view names the
unlabelled rows it is surest of among all unlabelled documents, by probabilities calibrated on held-back labels; they join the
other view's training rows. A view that is never sure of anything passes nothing on. In the end both
are calibrated again and a regression on their two logits scores all documents.

The texts are read once for statistics of some dozen numbers a row, which are written; a round is a pass over these, and
from it come the ``PER_ROUND`` surest rows of either class and view. The fit uses those and a bounded sample of labelled rows.
Scoring is one pass without a shuffle.

Defined results: null or empty texts have all statistics 0; nulls in metadata are values of their
own (langs and sources are hashed, and share places where there are more of them than places); null labels are not learnt from;
labels of one class or none give every document the rate ((ones + 1) / (rows + 2)); a null doc_id is unlabelled; repeated rows
are scored alike; other columns stay and ``content_score metadata_score score keep`` are written over; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewright.llm.common import Scratch, chunks, column, map_rows, table, texts_of, words_of

FIT_ROWS = 20_000  # labelled rows, about, at most; by hash of doc_id
ROUNDS = 5
PER_ROUND = 500  # rows of each class that a view names in a round, at most
SURE = 0.95  # calibrated probability from which a row is named
KEEP = 0.5  # documents below this score go
_LANGS, _SOURCES = 16, 64  # places of hashed metadata values
_CLASSES = ("upper", "lower", "digit", "mark", "odd", "bar", "shout")
_KIND = np.full(256, 4, np.int8)  # by byte: odd signs unless named below
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 1, 1, 2
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 3
_KIND[ord("|")], _KIND[ord("!")] = 5, 6
_KIND[[0x20, *range(0x09, 0x0E)]] = -1


def content_statistics(batch) -> np.ndarray:
    """A row of statistics for each text of the batch."""
    data, offsets = texts_of(batch.column("text"))
    out = np.zeros((len(offsets) - 1, 8 + len(_CLASSES)))
    for lo, hi in chunks(offsets):
        part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words, first = words_of(part, bounds)
        kind = _KIND[part]
        for k in range(len(_CLASSES)):
            upto = np.concatenate([[0], np.cumsum(kind == k)])
            out[lo:hi, k] = upto[bounds[1:]] - upto[bounds[:-1]]
        line = np.concatenate([[0], np.cumsum(part == 10)])
        lines = line[bounds[1:]] - line[bounds[:-1]]
        for i in range(hi - lo):
            own = words[first[i] : first[i + 1]]
            n = len(own)
            if n:
                counts = np.unique(own, return_counts=True)[1]
                letters = out[lo + i, : len(_CLASSES)].sum()
                out[lo + i, : len(_CLASSES)] /= max(letters, 1)
                out[lo + i, len(_CLASSES) :] = (np.log1p(n), letters / n, len(counts) / n, np.log(len(counts) + 1) / np.log(n + 1), counts.max() / n, (own[1:] == own[:-1]).mean() if n > 1 else 0, lines[i] / n, 1)
    return out


def content_features(x: np.ndarray) -> np.ndarray:
    """Statistics, their logs and the squares of those that are not shares."""
    return np.concatenate([x, np.log(x + 1e-3), x[:, len(_CLASSES) :] ** 2], axis=1)


def metadata_features(lang, source, n_chars) -> np.ndarray:
    """Hashed lang, hashed source, and the size of n_chars."""
    out = np.zeros((len(lang), _LANGS + _SOURCES + 3))
    place = {}  # of the values of this batch
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars)):
        if (a, b) not in place:
            place[a, b] = zlib.crc32(f"l{a}".encode()) % _LANGS, _LANGS + zlib.crc32(f"s{b}".encode()) % _SOURCES
        out[i, place[a, b]] = 1
        size = np.log1p(max(n, 0)) if n is not None else 0.0
        out[i, -3:] = (size / 10, (size / 10) ** 2, n is None)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 25) -> dict:
    """Weighted ridge-penalised logistic regression on standardised columns, by Newton's method."""
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = np.concatenate([(x - mean) / std, np.ones((len(x), 1))], axis=1)
    weight = np.ones(len(y)) if weight is None else weight
    beta, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2 * weight.sum())
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((z * h[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + move * min(1.0, 5.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return {"mean": mean, "std": std, "beta": beta}


def logit(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["std"] @ model["beta"][:-1] + model["beta"][-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sure_of(models: list[dict], scales: list[dict], views: list[np.ndarray], sure: float):
    """(view, label, probability, rows) for what each view is sure of."""
    for v in (0, 1):
        p = sigmoid(logit(scales[v], logit(models[v], views[v])[:, None])) if len(views[v]) else np.zeros(0)
        for label, q in ((1, p), (0, 1 - p)):
            yield v, label, q, np.flatnonzero(q >= sure)


def co_train(views: list[np.ndarray], y: np.ndarray, ask, rounds: int = ROUNDS) -> dict:
    """Two views of the labelled rows to the fitted views, their calibrations and the blend.

    ``ask`` takes models and calibrations and gives (view that is told, label, that view's features of the rows) of a round.
    Every fourth labelled row is held back: calibration and blend never see a row that a view learnt from.
    """
    if len(y) < 8 or y.sum() in (0, len(y)):
        return {"rate": float((y.sum() + 1) / (len(y) + 2))}
    held = np.arange(len(y)) % 4 == 3
    if y[held].sum() in (0, held.sum()) or y[~held].sum() in (0, (~held).sum()):
        held = np.zeros(len(y), bool)
    test = held if held.any() else ~held
    extra: list[list] = [[], []]  # what each view was told by the other: (features, label)
    for turn in range(rounds + 1):
        models, scales = [], []
        for v in (0, 1):
            x = np.concatenate([views[v][~held], *[rows for rows, _ in extra[v]]])
            t = np.concatenate([y[~held], *[np.full(len(rows), label) for rows, label in extra[v]]])
            w = np.concatenate([np.ones((~held).sum()), *[np.full(len(rows), 0.5) for rows, _ in extra[v]]])
            models.append(logistic(x, t, w))
            scales.append(logistic(logit(models[v], views[v][test])[:, None], y[test], l2=1e-2))
        if turn < rounds:
            for v, label, rows in ask(models, scales):
                extra[v].append((rows, label))
    both = np.stack([logit(scales[v], logit(models[v], views[v][test])[:, None]) for v in (0, 1)], axis=1)
    return {"models": models, "scales": scales, "blend": logistic(both, y[test], l2=1e-3), "passed": [sum(len(r) for r, _ in e) for e in extra]}


def _views(batch) -> list[np.ndarray]:
    """Both views' features from a batch of statistics."""
    width = 8 + len(_CLASSES)
    stats = np.frombuffer(b"".join(batch.column("stats").to_pylist()), np.float64).reshape(-1, width) if batch.num_rows else np.zeros((0, width))
    return [content_features(stats), metadata_features(*[batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")])]


_META = "lang string, source string, n_chars long, stats binary"


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_chars, stats) of every document: the one pass over the texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            stats = pa.array([row.tobytes() for row in content_statistics(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "lang", "source", "n_chars")], stats], names=["doc_id", "lang", "source", "n_chars", "stats"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"), "text")
    return x.mapInArrow(run, "doc_id long, " + _META)


def corpus_asker(pool: DataFrame, sure: float = SURE, per_round: int = PER_ROUND):
    """An ``ask`` for co_train over all rows of ``pool`` (uid, doc_id and statistics): each row is named once.

    To the driver come ``per_round`` rows for either class and view. Spark keeps the surest of each task before it shuffles them.
    """
    named: set[int] = set()

    def ask(models, scales):
        import pyarrow as pa

        known = np.array(sorted(named), np.int64)

        def run(batches):
            for batch in batches:
                free = ~np.isin(batch.column("uid").to_numpy(), known)
                for v, label, q, rows in sure_of(models, scales, _views(batch), sure):
                    rows = rows[free[rows]]
                    rows = pa.array(rows[np.argsort(-q[rows], kind="stable")][:per_round])
                    kind = pa.array(np.full(len(rows), 2 * v + label, np.int32))
                    yield pa.RecordBatch.from_arrays([kind, pa.array(q).take(rows), *[batch.column(c).take(rows) for c in batch.schema.names]], names=["kind", "q", *batch.schema.names])

        found = pool.mapInArrow(run, "kind int, q double, uid long, doc_id long, " + _META)
        for by in (["kind", F.pmod("uid", F.lit(64))], ["kind"]):
            best = Window.partitionBy(*by).orderBy(F.desc("q"), "doc_id", "uid")
            found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_round).drop("_n")
        found = found.orderBy("kind", F.desc("q"), "doc_id", "uid").toArrow()
        for v in (0, 1):
            for label in (1, 0):
                rows = found.filter(pa.array([k == 2 * v + label and u not in named for k, u in zip(found.column("kind").to_pylist(), found.column("uid").to_pylist())], pa.bool_()))
                named.update(rows.column("uid").to_pylist())
                if rows.num_rows:
                    yield 1 - v, label, _views(rows)[1 - v]

    return ask


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict, DataFrame]:
    """(the co-trained views, the statistics of all documents): from about ``fit_rows`` labelled documents at most and all unlabelled ones."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(statistics(docs).withColumn("uid", F.monotonically_increasing_id()), "statistics")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    met = found.select("doc_id", "uid").join(known, "doc_id")
    n = known.count()
    part = F.lit(int(min(1.0, fit_rows / max(1, n)) * (1 << 30)))
    met = met.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) < part)
    own = found.join(met.drop("doc_id"), "uid")
    one = F.min_by(F.struct(*[c for c in own.columns if c != "doc_id"]), F.struct("stats", "lang", "source", "n_chars"))  # of a repeated id
    own = own.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()  # fit_rows, about, at most
    y = np.array(own.column("quality").to_pylist(), float)
    pool = found.join(known, "doc_id", "left_anti").select("uid", "doc_id", "lang", "source", "n_chars", "stats")
    pool = scratch.save(pool, "pool")
    return co_train(_views(own), y, corpus_asker(pool)), found


def score_statistics(found: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """Statistics with content_score, metadata_score, score (of quality 1) and keep."""

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            found = _scores(batch, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found), pa.array(found[2] >= keep)], names=[*batch.schema.names, *_NAMES])

    return map_rows(found, scored, **_SCORES)


_NAMES = ["content_score", "metadata_score", "score", "keep"]
_SCORES = dict(zip(_NAMES, [T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]))


def _scores(batch, model: dict) -> list[np.ndarray]:
    if "rate" in model:
        return [np.full(batch.num_rows, model["rate"])] * 3
    logits = [logit(model["scales"][v], logit(model["models"][v], x)[:, None]) for v, x in enumerate(_views(batch))]
    return [sigmoid(x) for x in logits] + [sigmoid(logit(model["blend"], np.stack(logits, axis=1)))]


def score(docs: DataFrame, model: dict, keep: float = KEEP) -> DataFrame:
    """``docs`` with content_score, metadata_score, score (of quality 1) and keep."""
    docs = docs.drop(*_NAMES)

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            stats = pa.array([row.tobytes() for row in content_statistics(batch)], pa.binary())
            meta = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("lang", "source", "n_chars")], stats], names=["lang", "source", "n_chars", "stats"])
            found = _scores(meta, model)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found), pa.array(found[2] >= keep)], names=[*batch.schema.names, *_NAMES])

    return map_rows(docs, scored, **_SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model, found = fit(docs, table(spark, sf_dir, "labels"))
    return score_statistics(found, model).select("doc_id", *_NAMES)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    model, _ = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("keep").select(*map(column, docs.columns))
