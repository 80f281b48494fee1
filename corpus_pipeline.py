"""Corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; every stage but the
last returns the columns of ``documents``. The last returns a row for each kept document, or copy of one, with its
shard and its place in the shard.

Cases, beside those of the operators: a null text counts as an empty one in every stage; all empty texts are one group of
near-duplicates, of which the smallest doc_id stays; rows of a null doc_id are kept or not as any other, and of equal texts
those with a doc_id stay; repeated rows are near-duplicates; an empty table gives an empty result; extra columns pass through
all stages but the last, whatever their names.
"""

from __future__ import annotations

from burrow.llm import decontaminate, mixing, quality, sharding, simhash
from burrow.llm.common import stored, table
from burrow.llm.queries import MIXTURE, training_labels
from pyspark.sql import DataFrame, SparkSession


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score below 0.3 go."""
    return quality.keep_good(docs, training_labels(spark, sf_dir), 0.3)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, 5, 0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies within benchmark windows go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the domains' expected tokens match the mixture."""
    return mixing.mix(docs, mixing.domains_of(training_labels(spark, sf_dir)), MIXTURE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of the mixture of sources."""
    return sharding.interleaved_shards(docs, 8)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_to_targets", mix_to_targets),
    ("shard", shard),
]
#: No SQL form: the classifiers, the fingerprints and the fitted rates have none; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
