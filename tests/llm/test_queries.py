"""The registered queries of the subpackage, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from conftest import SF_SMALL
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from compare import connect, differences
from veilframe.llm.queries import QUERIES, SQL


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(spark, connect(SF_SMALL), SF_SMALL, name) is None


def test_edited_text(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    order = sorted(rows, reverse=True)
    out = {r.doc_id: r for r in contract.queries()["op10_document_fingerprints"](spark, SF_SMALL).collect()}
    for i, d in enumerate(order):
        text, after = rows[d], rows[order[(i + 1) % len(order)]]
        half = len(text) // 2
        want = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert (out[d].n_chars, out[d].edited_sha256) == (len(text), want)


def test_pipeline_stages(spark):
    first = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs, library = first, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in first.collect()}
    for name, f in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = f(spark, docs, SF_SMALL)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before
        if name != "bpe_encoding":
            assert docs.columns == first.columns
        if name == "simhash_near_dedup":
            seen: dict = {}
            for d in sorted(before):
                seen.setdefault(texts[d], d)
            assert set(after) <= set(seen.values())
        if name == "source_mixing":
            assert set(after) == before
    for r in docs.collect():
        assert r.ids == ",".join(map(str, library.encode(texts[r.doc_id], add_special_tokens=False).ids))
        assert r.decoded == texts[r.doc_id]


def test_run_takes_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
