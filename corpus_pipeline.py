"""From raw documents to token ids: quality, near-duplicates, secrets, mixture, tokens.

Each stage works on all that the stage before it kept, is written as Parquet and
read again. Null texts count as empty; a row without id is a document like others
(it is kept by the classifier, and comes last in its group of near-duplicates).
Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolode.llm import bpe, mixing, partenum, quality, secrets
from geolode.llm.common import dropped, files, table, written

#: Columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it learns from the labels' training rows."""
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one of least id; documents that share an id but no text stay apart."""
    return partenum.deduplicated(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces reported secrets by a mark; ``n_chars`` follows the text."""
    from pyspark.sql import functions as F

    clean = secrets.redacted(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture of its source says; repeats are rows of their own."""
    docs = docs.select(*COLUMNS)
    _, plan, n = mixing.mix_plan(docs, mixing.cycled_weights)
    return mixing.mixed(docs, plan, n)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text with digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_distinct", near_distinct),
    ("secrets", without_secrets),
    ("mixture", mixed_sources),
    ("tokens", token_ids),
]

#: Classifier and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again, and what led to it removed."""
    docs = table(spark, sf_dir, "documents")
    before = files()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            dropped(spark, [f for f in files()[:-1] if f not in before])
    return docs
