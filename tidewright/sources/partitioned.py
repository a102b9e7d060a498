"""A table in folders of consecutive keys: a change rewrites the folders of the keys that it names, a lookup reads parts of one.

Files are sorted by key, so a lookup by key skips row groups by their bounds; columns given as ``looked_up`` get a Bloom
filter in each row group, so a lookup by these skips most row groups too. One writer. A change is staged first, then put in place by
dynamic partition overwrite; folders of other keys are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.staging import staged, unstage

PART = "_part"


class PartitionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", width: int = 100_000, looked_up: tuple[str, ...] = (), options: dict | None = None):
        """``width``: keys of a folder. ``options``: further ones of the Parquet writer, as parquet.block.size."""
        self.spark, self.path, self.key, self.width = spark, path.rstrip("/"), key, width
        self.options = dict(options or {})
        for c in looked_up:
            self.options[f"parquet.bloom.filter.enabled#{c}"] = "true"
            self.options[f"parquet.bloom.filter.expected.ndv#{c}"] = str(min(width, 1 << 20))

    def _part(self, key: Column) -> Column:
        return F.floor(key / self.width).cast("long")

    def _write(self, df: DataFrame, dynamic: bool) -> None:
        rows = df.withColumn(PART, self._part(F.col(self.key)))
        rows = rows.repartitionByRange(PART, self.key).sortWithinPartitions(PART, self.key)
        mode = "dynamic" if dynamic else "static"
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).options(**self.options).partitionBy(PART).parquet(self.path)

    def create(self, df: DataFrame) -> PartitionedTable:
        self._write(df, False)
        return self

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop(PART)

    def lookup(self, keys: list[int] | None = None, **values) -> DataFrame:
        """Rows with one of these keys (in their folders alone), or with these values."""
        x = self._all()
        if keys is not None:
            x = x.where(F.col(PART).isin(*{k // self.width for k in keys}) & F.col(self.key).isin(*keys))
        for c, v in values.items():
            x = x.where(F.col(c) == v)
        return x.drop(PART)

    def change(self, keys: list[int] | DataFrame, apply: Callable[[DataFrame], DataFrame]) -> int:
        """Puts ``apply(rows)`` in place of the rows in the folders of these keys, and says how many folders that is.

        ``keys`` as a frame has one column; only its distinct folders come to the driver.
        """
        if isinstance(keys, DataFrame):
            parts = {r[0] for r in keys.select(self._part(F.col(keys.columns[0]))).distinct().collect() if r[0] is not None}
        else:
            parts = {k // self.width for k in keys}
        if not parts:
            return 0
        new = staged(apply(self._all().where(F.col(PART).isin(*parts)).drop(PART)))
        left = {r[0] for r in new.select(self._part(F.col(self.key))).distinct().collect()}
        if left - parts:
            raise ValueError(f"a change may not move rows to other folders: {sorted(left - parts)[:5]}")
        if left:
            self._write(new, True)
        for part in parts - left:  # the overwrite does not see a folder that has no rows any more
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={part}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        unstage(new)
        return len(parts)
