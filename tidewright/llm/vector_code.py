"""Vector codes: one entry number for each part of a vector, found by partial-distance search.

Each component x becomes the integer floor(scale * x). Vectors are cut into equal consecutive parts; each part position
has a codebook that starts as that part of the rows with the smallest ids and is refined by rounds of assignment and means.

An assignment goes through the dimensions of a part in descending order of the codebook's variance, for a block of rows and
entries at once. The entry nearest in the first dimension gives a complete distance to start from. An entry is dropped
from a row as soon as its accumulated distance strictly exceeds the row's best complete distance so far, so ties survive to the
end and go to the lower index. All arithmetic is in 64-bit integers, so the result does not depend on the order of anything.

Scale: each round is one pass over the rows without a shuffle of vectors; a task sends one row for each entry of each codebook
(parts x entries, fixed), which are summed up on Spark. The driver holds the codebooks alone.

Defined results: vectors that are null, hold a null or a non-finite component are dropped; so are vectors of another length than the
most frequent one that the parts divide (the longer of two as frequent), and those with a component so large that squared
distances would not fit 64 bits (beyond 2 million for parts of four). Ties of the id in the first codebook go by the vector; null ids come last. Repeated
rows are rows of their own; fewer rows than entries give a smaller codebook; an empty table gives an empty table and an empty
codebook. Other columns are kept; ``code`` and ``error`` are written over.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import Scratch, map_rows, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
ROWS = 2048  # whose distances to a codebook are held at once
ABREAST = 16  # entries that are scanned together; the best distance is brought up to date after each such block


def largest(width: int) -> int:
    """The largest integer component with which squared distances over ``width`` components fit 63 bits."""
    return 1 << ((62 - (width - 1).bit_length()) // 2 - 1)


def _sound(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def integers(df: DataFrame, vector: str, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(the rows with a usable vector, as array<long> in its place; their length, 0 if there are none)."""
    sound = df.where(_sound(F.col(vector)))
    length = sound.groupBy(F.size(vector).alias("d")).count().where(F.col("d") % parts == 0).orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return df.where("false").withColumn(vector, F.array().cast("array<long>")), 0
    x = sound.where(F.size(vector) == length["d"]).withColumn(vector, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))
    bound = largest(length["d"] // parts)
    return x.where(F.forall(vector, lambda c: F.abs(c) <= bound)), length["d"]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of every row of x; ties to the lower index."""
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    first = (x[:, :1] - book[:, 0]) ** 2
    code = first.argmin(axis=1)
    best = ((x - book[code]) ** 2).sum(axis=1)
    for lo in range(0, len(book), ABREAST):
        row, entry = np.nonzero(first[:, lo : lo + ABREAST] <= best[:, None])
        entry += lo
        far = first[row, entry]
        for d in range(1, x.shape[1]):
            far = far + (x[row, d] - book[entry, d]) ** 2
            near = far <= best[row]
            row, entry, far = row[near], entry[near], far[near]
        at = np.flatnonzero(np.diff(row, prepend=-1))  # rows ascend, and the entries of each
        if not len(at):
            continue
        least = np.minimum.reduceat(far, at)
        hit = np.flatnonzero(far == np.repeat(least, np.diff(at, append=len(row))))
        hit = hit[np.diff(row[hit], prepend=-1) != 0]  # of equals the lowest entry
        rows, entries = row[hit], entry[hit]
        better = (least < best[rows]) | ((least == best[rows]) & (entries < code[rows]))
        code[rows[better]], best[rows[better]] = entries[better], least[better]
    return code, best


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _coded(x: np.ndarray, books: np.ndarray):
    """Yields (part, its integers, codes, distances) by blocks of rows."""
    width = books.shape[2]
    for part, book in enumerate(books):
        for lo in range(0, len(x), ROWS):
            piece = x[lo : lo + ROWS, part * width : (part + 1) * width]
            yield part, slice(lo, lo + ROWS), piece, *nearest(piece, book)


def _sums(books: np.ndarray, vector: str):
    def run(batches):
        import pyarrow as pa

        parts, entries, width = books.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for part, _, piece, code, _ in _coded(_matrix(batch.column(vector)), books):
                count[part] += np.bincount(code, minlength=entries)
                np.add.at(total[part], code, piece)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry]), "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    return run


def codebooks(rows: DataFrame, length: int, vector: str, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of shape (parts, entries, width); ``rows`` as integers() gives them."""
    width = length // parts
    start = [r[vector] for r in rows.orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(entries).collect()]
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        sums = rows.select(vector).mapInArrow(_sums(books, vector), "part int, entry int, n long, total array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)])
        for r in sums.collect():  # a row for each entry of each codebook at most
            books[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return books


def assign(rows: DataFrame, books: np.ndarray, vector: str) -> DataFrame:
    """``rows`` with code (a byte for each part, so 256 entries at most) and error, without the vector."""
    rows = rows.drop("code", "error")
    rest = [c for c in rows.columns if c != vector]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            if n:
                for part, at, _, code, distance in _coded(_matrix(batch.column(vector)), books):
                    codes[at, part] = code
                    error[at] += distance
            kept = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=[*rest, "code", "error"])

    return map_rows(rows, run, without=vector, code=T.BinaryType(), error=T.LongType())


def encode(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(``df`` without its vectors, with code and error; the codebooks)."""
    if entries > 256:
        raise ValueError("an entry number is a byte: 256 entries at most")
    rows, length = integers(df, vector, parts, scale)
    if not length:
        books = np.zeros((parts, 0, 0), np.int64)
        return rows.drop(vector, "code", "error").withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")}), books
    books = codebooks(rows, length, vector, key, parts, entries, rounds)
    return assign(rows, books, vector), books


def decode(code: bytes, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return books[np.arange(len(books)), np.frombuffer(code, np.uint8)].reshape(-1) / scale


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    coded, books = encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = scratch.save(coded, "coded")
    # written, so that Spark knows its size: few labels are broadcast and leave the rows where they are
    labels = scratch.save(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), split AS (
  SELECT r, p, v[CAST(p * (len(v) // {parts}) + 1 AS BIGINT) : CAST((p + 1) * (len(v) // {parts}) AS BIGINT)] AS x
  FROM kept, (SELECT unnest(range({parts})) AS p)
), book0 AS (
  SELECT p, r - 1 AS e, x AS c FROM split WHERE r <= {entries}
)"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""
, far{k} AS (
  SELECT r, s.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
  FROM split s JOIN book{k} b ON s.p = b.p
), near{k} AS (
  SELECT r, p, min(struct_pack(d := CAST(d AS BIGINT), e := e)) AS m FROM far{k} GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""
, mean{k} AS (
  SELECT p, e, list(f ORDER BY i) AS c
  FROM (SELECT p, n.m.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS f
        FROM near{k} n JOIN split s USING (r, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM split) + 1)) AS i)
        GROUP BY ALL)
  GROUP BY p, e
), book{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e
)""")
    steps.append(f"""
, coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', n.m.e), '' ORDER BY p) AS code, CAST(sum(n.m.d) AS BIGINT) AS error
  FROM near{rounds} n JOIN kept USING (r) GROUP BY r, vec_id, label
), named AS (
  SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM book{rounds}, (SELECT unnest(range(1, (SELECT max(len(c)) FROM book{rounds}) + 1)) AS i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, named
""")
    return "".join(steps)


SQL = _sql()
