"""The corpus pipeline: five stages, each on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.  Nulls, empty tables, repeated rows and columns
of other names are handled as each operator's docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm import byte_bpe, quality_classifier
from civicflow.llm.components import shared_folder
from civicflow.llm.minhash_dedup import Near, without_near_duplicates
from civicflow.llm.queries import MIX, byte_ranks, quality_labels
from civicflow.llm.repetition_rules import Limits, rules
from civicflow.llm.source_mixing import mixed

#: No SQL can express the classifier, the stages' models or the tokens; the stages are tested by brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.7 or more; the model learns from the labelled rows of docs."""
    settings = quality_classifier.Settings()
    model = quality_classifier.fit(docs, quality_labels(spark, sf_dir), settings)
    return docs.where(quality_classifier.scorer(model, docs)(F.col("text")) >= settings.threshold)


def little_repetition(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the limits on repeated substrings."""
    return docs.where(rules(spark, Limits())(F.col("text"))["kept"])


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8."""
    return without_near_duplicates(docs, Near(width=5, percent=80))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the production mix; one that is read in two epochs comes twice."""
    return mixed(docs, MIX)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, then its digest, the number of tokens, the ids, the digest of what they decode to,
    and whether that is the text.

    Columns of docs of these names (text_sha256, n_tokens, ids, decoded_sha256, decodes) give way.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn("text_sha256", digest)
    out = byte_bpe.encode(marked, byte_ranks(), public_tokenizers.PATTERN, decoded="decoded_sha256")
    return out.withColumn("decodes", F.col("decoded_sha256") == F.col("text_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("quality rules", little_repetition),
    ("MinHash near-dedup", no_near_duplicates),
    ("mixing sources to target weights", target_mix),
    ("byte-level BPE encoding and decoding", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what stands between two of them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
