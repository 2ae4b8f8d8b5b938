"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing to target weights, token-ID output.

The near-dedup stage links documents by op 1's fingerprints, checked for the similarity of their shingle sets, and then by an
exact join of the sets those whose fingerprints lie further apart, as README says why.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns one row for each document (and copy) of
the token files: doc_id, start, n_tokens, ids_crc32.

Rows, in every stage and in run(): texts may be null, empty or very long, and doc_ids null or repeated. A null or letterless
text has no language and goes in the first stage. Of documents alike the one with the smallest doc_id stays, rows without a
doc_id stay all; rows with one doc_id are alike whatever their texts. Repeated rows are scored and drawn each. Further
columns, whatever their names, are kept as they are up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnframe.llm.common import table, written
from turnframe.llm.decontaminate import decontaminated
from turnframe.llm.langid import accepted
from turnframe.llm.mixing import drawn
from turnframe.llm.simhash import one_of_each
from turnframe.llm.tokenfile import op8_tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or of no clear language."""
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; groups are chains of five-word Jaccard similarities of 0.8 or more."""
    return one_of_each(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says; toxic ones go."""
    return drawn(docs, table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded, written in the file format and read back."""
    return op8_tokens(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: SQL has neither the fingerprints' hash nor the tokenizer: tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
