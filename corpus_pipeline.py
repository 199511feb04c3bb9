"""From raw documents to packed training sequences: quality, exact and near copies, mixture, packing.

Every stage takes the rows that the one before it kept, with columns ``doc_id`` and ``text`` and any others, and gives the same columns,
the last one pieces of sequences.  A null text counts as empty; an empty table gives an empty one; extra columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, neardup, packing, quality
from tessera.llm.common import fresh_dir
from tessera.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on all labelled rows among them that aren't held out, rejects go.

    Every row is judged by its own text: equal texts fare alike, an empty one by the bias; without labels all scores are 0.5 and all rows stay.
    """
    return quality.keep_good(docs, quality.fit_all(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z and a-z are the same) stays: that with the smallest id.

    Rows that repeat id and text leave one, any of them; of null ids one stays where the group has no other.
    """
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (0.8 of shingles of five words) stays: that with the smallest id.

    Empty texts and null ids have no near copies and stay; rows that share an id but not a text are judged apart.
    """
    return neardup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the target weights ask for: not at all, once or repeated, under its own id.

    Domains are learned from all labelled rows that aren't held out.  Without labels every row stays once; targets out of reach give the rates nearest to them, with a warning.
    """
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fit=mixing.fit_all_domains)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences: every token of every row in exactly one; an empty text is its end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixture), ("packing", packed)]
#: A stage's decisions come from fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each written as Parquet into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
