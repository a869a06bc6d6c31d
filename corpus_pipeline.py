"""A corpus pipeline of five stages, each one of the operators of ``causeway.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as
Parquet and reads again for the next one.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, mixing, pii, simhash, toxicity
from causeway.llm._base import materialize, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The mixture wants this share of the tokens that reach it, one epoch at most, so that no document repeats.
MIX_SHARE, MIX_SEED = 0.9, 17
#: Weights of the tree's levels that differ from 1.
MIX_WEIGHTS = {"domain": {"domain0": 1.0, "domain1": 3.0, "domain2": 2.0, "domain3": 2.0}, "lang": {"en": 4.0, "de": 2.0}}
#: Documents whose sets of five-word shingles have this Jaccard similarity are near-duplicates.
SIMILARITY = 0.8


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on what reaches this stage, rejects."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by word shingles, that of the smallest id."""
    return simhash.deduplicate(docs, similarity=SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced; ``n_chars`` follows the text."""
    found = pii.redact(docs, pii.fit(docs))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets of the domain-language-source tree take."""
    taken = mixing.mix(docs, MIX_WEIGHTS, share=MIX_SHARE, epochs=1, seed=MIX_SEED)
    taken = materialize(taken.select(F.col("doc_id").alias("__id")).distinct(), "taken")
    return docs.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs


#: Learning and components are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None
