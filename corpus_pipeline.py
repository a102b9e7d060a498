"""The corpus pipeline: five stages, each over all that the one before it kept.

Junk goes, one document of each near-duplicate group stays, documents that hold benchmark items go,
sources are mixed to their target weights, and the mix is shuffled into shards.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, quality, set_join, sharding, source_mix
from tidewright.llm.common import Scratch

_left: list[Scratch] = []  # what stages have opened


def _sweep(spark: SparkSession) -> None:
    while _left:
        one = _left.pop()
        if one.spark is spark:  # a session that ended took its tables along, or left them to its folder
            one.remove()


def _apart(stage):
    """A stage that first deletes what the ones before it left: its ``docs`` are written, so nothing reads that any more."""

    def one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _sweep(spark)
        before = len(Scratch.opened)
        out = stage(spark, docs, sf_dir)
        _left.extend(Scratch.opened[before:])
        return out

    return one


STAGES = [
    ("quality", _apart(quality.stage)),
    ("near_duplicates", _apart(set_join.stage)),
    ("decontaminate", _apart(decontaminate.stage)),
    ("mix", _apart(source_mix.stage)),
    ("shard", _apart(sharding.stage)),
]

#: The classifier's fit cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


#: The tables that the stages read.
TABLES = ("documents", "labels", "benchmark")


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of what a run depends on: the folder, every input file with its size and time, the stages in their order."""
    files = []
    for table in TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while found.hasNext():
            one = found.next()
            files.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    text = json.dumps([str(sf_dir), sorted(files), [stage for stage, _ in STAGES]])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The stages over ``documents``, each result written as Parquet and read again.

    What a stage needed besides is deleted when its result is written, and with it the result of the stage before.
    Under a ``name`` a run that broke off goes on after the last stage whose result was written, if that was of the same
    input files and stages; what other runs left under the name is not read.
    """
    scratch = Scratch(spark, f"{name}-{fingerprint(spark, sf_dir)}" if name else None)
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), 0
    for i, (stage, _) in enumerate(STAGES):
        if name and scratch.done(stage):
            docs, first = spark.read.parquet(f"{scratch.base}/{stage}"), i + 1
    for i, (stage, apply) in list(enumerate(STAGES))[first:]:
        docs = scratch.save(apply(spark, docs, sf_dir), stage)
        if i:
            scratch.drop(STAGES[i - 1][0])
    _sweep(spark)
    return docs
