"""From raw documents to training text: five stages, each written and read by the next.

Every stage takes (spark, docs, sf_dir) and decides about all rows it is given. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleskein.llm import bpe, jaccard, line_dedup, mixing, quality
from teleskein.llm.common import source, stored


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go."""
    return quality.filtered(docs, source(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go, but for their first occurrence."""
    return _counted(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of alike texts stays, that with the smallest id."""
    return jaccard.one_of_each_class(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each epoch in which their source's budget reaches them."""
    return _counted(mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids of the text and their number."""
    ids = bpe.encoded(docs.select("doc_id", "source", "text"), bpe.default_path())
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicates),
    ("source_mixing", source_mix),
    ("bpe", encode),
]

# Token ids of a vocabulary file and a forest's verdict are not expressible in SQL;
# tests/llm/test_pipeline.py holds the rows against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
