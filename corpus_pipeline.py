"""A corpus pipeline: drop toxic documents, keep known languages, drop near-duplicates, mix
sources to target weights, and encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; between stages
the rows are a Parquet table in the shared folder.  All but the last return the columns of
``documents``.  Models are trained on the labelled rows of the tables in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from veilframe.llm import langid, toxicity
from veilframe.llm.bpe import encode_texts
from veilframe.llm.common import held_out, read
from veilframe.llm.mixing import mixture
from veilframe.llm.simhash_dedup import drop_near_duplicates
from veilframe.sources.stage import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", "text")
    return toxicity.reject_toxic(docs, "text", model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is recognised."""
    labelled = read(spark, sf_dir, "documents").filter(~held_out("doc_id", 4, 2))
    return langid.reject_unknown(docs, "text", langid.train(labelled, "text", "lang", "doc_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints within two bits link, the one with the smallest id."""
    return drop_near_duplicates(docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; documents of small sources more than once."""
    return mixture(docs, keep=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every use of a document."""
    out = encode_texts(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_copies),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]
#: Trained models, XXH64 and BPE have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
