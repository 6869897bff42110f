"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

language ID -> exact dedup -> n-gram Jaccard join -> benchmark decontamination -> BPE encoding and decoding.
Each stage works on all that the stage before it kept, whole texts of any length, with the operator's production parameters.

Cases, beside those of the operators: rows without a doc_id are kept or dropped by their text like any other; repeated rows
are copies, of which one stays; of tied copies that with the smallest doc_id stays. Empty tables pass all stages as empty
tables. Further columns, those named as an operator's own too, go through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontamination, exact_dedup, language_id, ngram_join
from gridloom.llm.common import shared_path


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """The documents with columns of these names renamed, so that an operator can add its own, and the columns that bring all back."""
    clash = {c: f"_stage_{c}" for c in docs.columns if c.lower() in {*names}}
    return docs.withColumnsRenamed(clash), [F.col(clash.get(c, c)).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too) go, and those that look like none of the learned languages: other scripts, random letters.

    The margin that decides does not depend on a text's length, so clean short texts stay. A document without lang gets the
    predicted one. With nothing to learn from, every document goes.
    """
    learned = docs.filter(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id")))
    rows, back = set_aside(docs, ["lang_pred", "score", "margin"])
    judged = language_id.identify(rows, language_id.train(learned))
    judged = judged.filter((F.col("lang_pred") != "und") & (F.col("margin") >= language_id.MIN_MARGIN))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, one document stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return ngram_join.near_deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    rows, back = set_aside(docs, decontamination.OUTPUT)
    found = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("n_hit = 0").select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Training a classifier and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
