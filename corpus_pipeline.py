"""The corpus pipeline: language, near-duplicates, benchmark passages, mixing, sharding.

Every stage takes tables with documents' columns and any others, of any type and name, which stay as they are. Null and empty
texts and texts without a letter go in the first stage; repeated rows and rows of null ids are rows like all others until
the second one, which keeps one of each group; very long texts are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mrflow.llm import decontaminate, langid, mixing, sharding, simhash
from mrflow.llm.common import free_names, id_crc, keep, load
from mrflow.sources import scratch

#: A text whose best language is less likely than this is rejected. Scores are calibrated, and few short texts are below.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language is not clear. Learns from the labelled three quarters; without labels only texts without a letter can be rejected."""
    model = langid.fit(docs.filter(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2))
    found = langid.identify(docs, model, into="language")
    names = free_names(docs.columns, ["language"])
    stays = langid.confident(F.col("language"), LEAST_SCORE) if model.langs else F.coalesce(F.col(f"`{names.get('text', 'text')}`"), F.lit("")).rlike(r"\p{L}")
    return found.filter(stays).select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, the one with the smallest id: shingles of five words, a Jaccard similarity of 0.8 at least, confirmed for every link."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark. A benchmark without texts drops none."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks for; a null source is a source."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle all rows into 16 shards: adds shard and slot. Columns with these names stay with an underscore added."""
    return sharding.shards(docs, weight=sharding.size_of(F.col("text")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("mixture", mixture), ("shards", shards)]

#: The stages learn models and compare near copies, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's tables are deleted when the next one has its input, those of the last one with the driver's run."""
    docs, start = load(spark, sf_dir, "documents"), scratch.mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name)
            scratch.clear(spark, start, but=1)
    return docs
