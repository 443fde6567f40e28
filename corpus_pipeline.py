"""From documents to token files: quality, near duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Between stages the documents are written as Parquet in the shared folder and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.llm.curriculum import mix_documents
from casewright.llm.decontaminate import leaks, without_leaks
from casewright.llm.importance import importance_sample, kept_documents
from casewright.llm.jaccard_join import first_of_groups
from casewright.llm.queries import table, token_digest, tokenizer_path
from casewright.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps."""
    return kept_documents(docs, importance_sample(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at 75 percent."""
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row with the whole text for each pass over a document."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; place, length and checksum of every document read back from them."""
    return token_digest(spark, docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]

#: Hashing, models and tokens are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), name.split()[0].lower())
    return docs
