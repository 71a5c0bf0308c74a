"""From raw documents to a weighted mixture: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, the last one a row for each document with its copies in the mixture. An empty
table passes through every stage as an empty one; rows with null or empty text, repeated
rows and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.decontaminate import without_leaks
from quillgraph.llm.mixing import mixed
from quillgraph.llm.near_copies import distinct_documents
from quillgraph.llm.quality_knn import HELD_OUT, good_documents, quality_space
from quillgraph.llm.suffix_dedup import without_repeats
from quillgraph.scratch import discard, materialize, noted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_documents(docs, quality_space(docs, labels, train=f"not ({HELD_OUT})"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that of smallest doc_id.

    The operator in its form for a similarity of sets: SimHash fingerprints alone leave
    most such pairs apart (see ``near_copies``).
    """
    return distinct_documents(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long byte strings that a document of smaller doc_id also holds."""
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's copies in the mixture of sources."""
    return mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontaminate", decontaminate), ("mix", mix)]

#: No stage but the last is SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with noted() as held:
            done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs, *(x for x in held if x is not done))
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
