"""A training-data pipeline over ``documents``: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.bpe import encode_decode
from skirmish.llm.common import bounded_batches, delete_folder, shared_folder, table
from skirmish.llm.decontamination import decontaminated
from skirmish.llm.jaccard_join import one_of_each, similarity_classes
from skirmish.llm.language import keep_identified, train
from skirmish.llm.queries import tokenizer_path
from skirmish.llm.secret_scan import redacted

#: A document in none of the learnt languages shares few of their n-grams.
LEAST_LANGUAGE_SCORE = 0.2


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """All stages run in the same executors one after the other, so each bounds what it sends to the workers."""

    @wraps(f)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return f(spark, docs, sf_dir)

    return bounded


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that name a language; drops those without letters (``und``) and
    those that hardly share an n-gram with any language."""
    return keep_identified(docs, train(docs), LEAST_LANGUAGE_SCORE)


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that links connect (5-word shingles, similarity 0.8 or more) the
    one with the smallest id stays; documents without words are no class."""
    return one_of_each(docs, similarity_classes(docs, percent=80, size=5))


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which ten consecutive words of a benchmark item stand."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind in brackets; n_chars follows the text."""
    return redacted(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@stage
def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The identifiers of each text and the digest of what they decode to."""
    return encode_decode(docs, tokenizer_path(), ids=True, decoded=False)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_round_trip", bpe_round_trip),
]

#: Language identification learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again; what a stage
    wrote goes when the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", ""
    for k, (name, step) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete_folder(spark, before)
        before = path
    return docs


