"""The pipeline against the operators' plain versions, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from teleskein.llm import bpe, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.assess(docs, labels).collect() if r["kept"]}
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.stored(stage(spark, tables[-1], SF), f"test-{name}"))
    rules, lines, single, mix, tokens = ({(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()} if "text" in t.columns else t for t in tables[1:])
    assert all(t.columns == columns for t in tables[1:5])
    assert {d for d, _ in rules} == kept
    assert {d for d, _ in lines} == kept and sum(len(t or "") for _, t in lines) <= sum(len(t or "") for _, t in rules)
    classes = {c for _, c, _, _ in brute.jaccard_classes(sorted(lines))}
    assert {d for d, _ in single} == classes
    before = dict(single)
    for d, t in mix:
        assert before[d].startswith(t)
    rows = tokens.collect()
    assert len(rows) == tables[4].count()
    codec = bpe.Codec(bpe.Vocabulary(bpe.default_path()))
    want = Counter((r["doc_id"], tuple(codec.encode(r["text"] or ""))) for r in tables[4].collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want


def test_run_reads_documents(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "source", "ids", "n_tokens"]


def test_empty_and_odd_tables(spark):
    for rows in ([], brute.odd_rows()):
        table = spark.createDataFrame(rows, brute.ODD_SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            table = corpus_pipeline.stored(stage(spark, table, SF), f"odd-{name}")
        assert table.columns == ["doc_id", "source", "ids", "n_tokens"]
