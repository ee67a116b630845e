"""The corpus pipeline: five stages from raw documents to a mixed training set.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last one, mixing, returns a row for
each copy taken and counts them in ``copy``. ``run`` applies the stages to
documents and writes each result to the shared folder, where the next reads it.
"""

from pyspark.sql import DataFrame, SparkSession

from coterie.llm.common import read, stored
from coterie.llm.decontaminate import drop_contaminated
from coterie.llm.exact_dedup import drop_exact_copies
from coterie.llm.language_id import keep_identified, learn
from coterie.llm.mixing import mix
from coterie.llm.near_dedup import drop_near_copies


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are of a known language; texts without letters or with no leading language go."""
    return keep_identified(docs, learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that bring every source to its target weight."""
    return mix(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources)]

#: No SQL: a trained CRF and minhash signatures decide; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
