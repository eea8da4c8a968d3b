"""A training corpus from raw documents: filter, deduplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of `documents`; the last returns what the token files need. A stage works on all
that the one before kept, as written to and read from Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, lines, mixing, neardup, toxicity
from tessera.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity models reject."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted; a document that loses all its words so goes."""
    done = lines.dedup_lines(docs).filter((F.col("__n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = done.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
    return changed.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return neardup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents left out, taken once or taken twice."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text (little-endian unsigned 32-bit), their count and digests of them and of the bytes decoded from them."""
    return bpe.digests(bpe.encode_texts(docs), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", ordinary),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("mixing sources", mixed),
    ("byte-level BPE", encoded),
]

#: The models of the first stage are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
