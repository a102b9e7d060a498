"""The pipeline against its stages' own rules, on the smallest tables."""

import os
import tempfile
import uuid

import duckdb
import pytest

import corpus_pipeline
from tidewright.llm import registry
from tidewright.llm.common import Scratch
from tests.llm.test_operators import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch, docs = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, SF), name)
        seen[name] = docs
        assert docs.columns[: len(columns)] == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"].select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d, q in labels.items() if q == 0) <= 0.1 * len(labels)
    rows = [(r["doc_id"], r["text"]) for r in seen["quality"].collect()]
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == {least for _, _, least in components(rows, 5, 80)}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in seen["decontaminate"].collect()}
    for r in seen["near_duplicates"].collect():
        text = " ".join(r["text"].lower().split())
        assert r["doc_id"] in clean or any(i[:40] in text or i[-40:] in text for i in items)
        assert not (r["doc_id"] in clean and any(i in text for i in items))
    assert seen["shard"].count() == seen["mix"].count()
    assert abs(seen["mix"].count() - seen["decontaminate"].count()) < seen["decontaminate"].count()


def test_pipeline_resumes(spark, monkeypatch):
    """A run that breaks off goes on after the last stage written; nothing but that result is kept."""
    ran, whole = [], list(corpus_pipeline.STAGES)

    def marked(name, stage, fails):
        def one(spark, docs, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError("lost")
            return stage(spark, docs, sf_dir)

        return one

    quick = [("near", lambda s, d, p: d.dropDuplicates(["text"])), whole[2], ("last", whole[4][1])]
    own = f"resume-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp()
    monkeypatch.setattr(Scratch, "__init__", lambda self, spark, name=None, at=Scratch.__init__: (at(self, spark, name), setattr(self, "base", f"{folder}/{name}") if name else None)[0])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, marked(n, f, n == "last")) for n, f in quick])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, own)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, marked(n, f, False)) for n, f in quick])
    rows = corpus_pipeline.run(spark, SF, own).count()
    assert ran == ["near", "decontaminate", "last", "last"] and rows > 0
    assert os.listdir(f"{folder}/{own}-{corpus_pipeline.fingerprint(spark, SF)}") == ["last"]


def test_a_name_keeps_inputs_apart(spark, monkeypatch, tmp_path):
    """Another input, or the same folder with other files, under the name of an earlier run gives its own rows."""
    monkeypatch.setattr(Scratch, "__init__", lambda self, spark, name=None, at=Scratch.__init__: (at(self, spark, name), setattr(self, "base", f"{tmp_path}/{name}") if name else None)[0])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, p: d.where("doc_id % 2 = 0")), ("two", lambda s, d, p: d)])
    for n in (10, 20):
        for name in corpus_pipeline.TABLES:
            spark.range(n).withColumnRenamed("id", "doc_id").write.mode("overwrite").parquet(str(tmp_path / "in" / f"{name}.parquet"))
        first = corpus_pipeline.run(spark, str(tmp_path / "in"), "nightly")
        assert first.count() == n // 2 == corpus_pipeline.run(spark, str(tmp_path / "in"), "nightly").count()


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-2:] == ["shard", "slot"]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name])
    columns = [want.columns.index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[i] for i in columns)) for r in want.fetchall())
