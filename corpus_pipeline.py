"""From raw documents to packed sequences: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each stage's rows as Parquet in the
shared folder and gives them to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import neardup, packing, quality, secrets
from driftline.llm.common import Scratch, owned, table
from driftline.llm.encode import public
from driftline.llm.queries import PACKED


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fit on the labels) accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Rows that repeat a kept id with the same words are copies too, so
    one of them stays; rows with a null id are in no group and all stay."""
    return neardup.deduplicated(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's span replaced."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places in sequences of 4096 tokens."""
    scratch = Scratch(spark, "packing")
    return packing.pack(scratch.keep(packing.pieces(docs, public(PACKED)), "pieces"), scratch)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("secrets", no_secrets), ("packing", packed)]

#: SQL can't express the learned scores or the tokens; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, last = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with owned() as made:
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        for own in made:  # what the stage's rows were read from
            own.remove()
        if last:
            scratch.drop(last)
        last = name
    return docs
