"""Versions of a set of tables: written aside, then made current by one rename. A table is one part, or several that appends left."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    """Tables below ``root`` on any file system of Spark. Readers see one version; unchanged tables are shared."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict[str, list[str]], dict[str, int]]:
        found = self._fs.globStatus(self._path("_versions/*.json")) or []
        names = sorted(s.getPath().getName() for s in found)
        if not names:
            return 0, {}, {}
        text = json.loads(self.spark.read.text(f"{self.root}/_versions/{names[-1]}", wholetext=True).first()["value"])
        return int(names[-1].split(".")[0]), text["tables"], text["marks"]

    def _current(self) -> tuple[int, dict[str, list[str]]]:
        return self._state()[:2]

    def read(self) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts]) for name, parts in self._current()[1].items()}

    def marks(self) -> dict[str, int]:
        """The number of the last batch that each named stream has published."""
        return self._state()[2]

    def publish(self, tables: dict[str, DataFrame], append: bool = False, mark: tuple[str, int] | None = None) -> int:
        """All of these tables change together; a failure before the rename changes nothing. ``append``: their rows come on top.

        ``mark`` names a stream and the number of its batch: a batch that was published before is not published again.
        """
        version, paths, marks = self._state()
        if mark and marks.get(mark[0], -1) >= mark[1]:
            return version
        name_of_part = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{name_of_part}")
            paths[name] = [*(paths.get(name, []) if append else []), f"{name}/{name_of_part}"]
        self._fs.mkdirs(self._path("_versions"))
        draft, final = self._path(f"_versions/{name_of_part}.draft"), self._path(f"_versions/{version + 1:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"tables": paths, "marks": marks | (dict([mark]) if mark else {})}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError("another writer published first")
        return version + 1

    def append(self, tables: dict[str, DataFrame], mark: tuple[str, int] | None = None) -> int:
        """Writes these rows alone; those of the current version stay where they are."""
        return self.publish(tables, append=True, mark=mark)

    def compact(self, most: int = 1) -> int:
        """Rewrites the tables that are in more than ``most`` parts as one."""
        many = {name for name, parts in self._current()[1].items() if len(parts) > most}
        return self.publish({name: df for name, df in self.read().items() if name in many})

    def backup(self, to: str) -> None:
        """The current version's tables, copied."""
        for name, df in self.read().items():
            df.write.parquet(f"{to}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, stamp: str) -> None:
    """Below a folder named by the time of the fetch."""
    df.write.mode("overwrite").json(f"{path}/ingested={stamp}")


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
