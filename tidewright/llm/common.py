"""What the operators share: scratch tables, prefix sums, vectorised words and shingles.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Texts travel to Python as UTF-8
binary, and whole batches are hashed at once with numpy: no loop over words.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20  # of text that is hashed at once; a longer text is a chunk of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(df: DataFrame, run, without: str | None = None, **more: T.DataType) -> DataFrame:
    """``df`` with more columns by ``run``, which takes record batches and yields them, ``without`` one column, with these at the end.

    mapInArrow() itself takes no column whose name holds a backtick or a dot; here any name does.
    """
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
    kept = [(c, f) for c, f in zip(plain, df.schema) if f.name != without]

    def renamed(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([*[c for c, _ in kept], *more])

    fields = [*[T.StructField(c, f.dataType) for c, f in kept], *[T.StructField(c, t) for c, t in more.items()]]
    out = df.toDF(*plain).mapInArrow(renamed, T.StructType(fields))
    return out.toDF(*[f.name for _, f in kept], *more)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Scratch:
    """Tables in the shared folder that spark.checkpoint.dir names.

    A table cuts lineage: what is read again survives the loss of any executor. On a local
    master without that setting a temporary folder is used; on a cluster it must be set. A folder with a ``name`` is found
    again by a run that starts anew. Tables that a returned frame reads stay until remove() or clear().
    """

    opened: list = []  # of this process, in order

    def __init__(self, spark: SparkSession, name: str | None = None):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="scratch-")
        self.spark, self.base, self.tables = spark, f"{base}/{name or uuid.uuid4().hex}", {}
        Scratch.opened.append(self)

    #: What is written needs no shuffle files any more; what goes to Python is bounded by bytes, however long its texts are.
    SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

    @contextmanager
    def settings(self):
        before = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
        try:
            for k, v in self.SETTINGS.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with self.settings():
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """One row for each ``key``, written in buckets of it: joins on the key do not shuffle this table again."""
        n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's most
        one, known = df.repartition(n, key).dropDuplicates([key]), f"scratch_{uuid.uuid4().hex}"
        with self.settings():
            one.write.bucketBy(n, key).sortBy(key).option("path", f"{self.base}/{name}").format("parquet").saveAsTable(known)
        self.tables[name] = known
        return self.spark.table(known)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, name: str) -> bool:
        """Whether the table was written to its end."""
        path, files = self._path(f"{name}/_SUCCESS")
        return files.exists(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no returned frame reads."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path, files = self._path(name)
            files.delete(path, True)

    def remove(self) -> None:
        """Deletes the folder with all its tables."""
        self.drop(*self.tables, "")
        if self in Scratch.opened:
            Scratch.opened.remove(self)


def clear(since: int = 0) -> None:
    """Deletes the scratch folders that this process opened, but for the first ``since`` of them."""
    for one in Scratch.opened[since:]:
        one.remove()


def prefix_sums(df: DataFrame, key: str, value: str, out: str, by: list[str] | None = None, width: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over smaller ``key`` (a long, unique within ``by``).

    Two levels, so that one task holds ``width`` rows or one row for each ``width`` of them.
    """
    by = by or []
    chunk = F.floor(F.col(key) / F.lit(width)).cast("long")
    df = df.withColumn("_chunk", chunk)
    totals = df.groupBy(*by, "_chunk").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inner = Window.partitionBy(*by, "_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(totals, [*by, "_chunk"]).withColumn(out, (F.col("_base") + F.col("_inner")).cast("long")).drop("_chunk", "_base", "_inner")


# ---------------------------------------------------------------- vectorised text

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        _POWERS[int(base)] = known
    return known[:n]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums P of values * base ** i; window_hash() turns two of them into a hash."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], wherever it lies."""
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column; null texts are empty."""
    import pyarrow as pa

    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of whole texts of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def spans_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word of these texts, and the rolling() of their lower-cased bytes.

    ``bounds`` are the texts' offsets in ``data``, which holds no more than them.
    """
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at, last = bounds[:-1][bounds[:-1] < len(data)], bounds[1:][bounds[1:] > 0] - 1
    begins[at], ends[last] = inside[at], inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # of texts that share an offset, all but the last are empty: the last one owns the word
    return start, end, np.searchsorted(bounds, start, side="right") - 1, rolling(_BYTE[_LOWER[data]])


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of these texts; where each text's words begin and, one on, end."""
    start, end, text, prefix = spans_of(data, bounds)
    return window_hash(prefix, start, end), np.searchsorted(text, np.arange(len(bounds)))


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; shorter than k: of the whole; no words: none."""
    n = len(words)
    if n == 0:
        return words[:0]
    if n < k:
        k = n
    out = words[: n - k + 1].copy()
    for j in range(1, k):
        out = out * _BASE + words[j : n - k + 1 + j]
    return mix(out + U(k))


def documents_words(batch, name: str = "text"):
    """Yields (row of the batch, hashes of its words) for every row."""
    data, offsets = texts_of(batch.column(name))
    for lo, hi in chunks(offsets):
        bounds = offsets[lo : hi + 1] - offsets[lo]
        words, first = words_of(data[offsets[lo] : offsets[hi]], bounds)
        for i in range(hi - lo):
            yield lo + i, words[first[i] : first[i + 1]]
