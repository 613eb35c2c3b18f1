"""The pipeline's stages against the operators one by one, on a small corpus."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from docaudit.llm import decontaminate, mixing, secrets, toxicity
from docaudit.llm.queries import ORACLES, QUERIES

from .test_likeness import kept_by_force

SF = "/root/testdata/sf0.001"


def test_each_dealt_operator_has_one_query():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert "pipeline" in entry.queries() and set(QUERIES) < set(entry.queries()) and set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert kept == {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()}
        elif name == "near_duplicates":
            assert kept == kept_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        elif name == "decontamination":
            assert kept == {r.doc_id for r in decontaminate.contamination(docs, bench).filter("not contaminated").collect()}
        elif name == "secrets":
            assert out.count() == docs.count()
            assert secrets.find_secrets(out).agg({"n_hex": "sum"}).first()[0] == 0
        else:
            rates = {r.doc_id: r.rate for r in mixing.mixture(docs, labels).collect() if r.rate > 0}
            assert kept == set(rates)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        docs = out
    assert 0 < docs.count() < before
    assert set(columns) | {"rate", "expected_tokens"} == set(docs.columns)


def test_stages_with_clashing_names_and_without_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    plain = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    named = docs.withColumns({c: F.lit("?") for c in ("kept_id", "hit_key", "rate_key", "key", "k", "root", "first", "score", "held_out", "n")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, named, SF)
        assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in plain[name].select("doc_id").collect()}, name
        assert set(named.columns) <= set(got.columns)
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
