"""A corpus for language-model training out of `documents`: rules, classifier, near duplicates, packing.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import ngram_jaccard, packing, quality_knn, quality_rules
from quillspark.llm.common import stored, table
from quillspark.llm.tokens import default_path


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality_rules.keep_good(docs)


def pass_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled texts vote down go. It learns from the labelled rows of all documents that aren't held out."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike to 0.8 or more in their five-word shingles, directly or through others, one stays."""
    return ngram_jaccard.keep_one(docs, ngram_jaccard.Alike(k=5, percent=80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, in sequences of at most 2,048."""
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality rules", pass_rules), ("quality classifier", pass_classifier), ("n-gram Jaccard join", drop_near_duplicates), ("packing", pack)]

#: EM, an SVD and a tokenizer have no SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
