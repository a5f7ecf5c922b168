"""A training-data pipeline: classify, de-duplicate, pseudonymise, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of `documents`. Rows are told apart by their file and place in it, as ids
may be null or repeat; so `docs` must be a table of Parquet files as it is read.
Null and empty texts, long ones, repeated rows and empty tables are as the
operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import classifier, mixing, packing, pii, simhash
from textloom.llm.common import place_in_file, store, table
from textloom.llm.queries import EXAMPLE_KEY, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    return classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprints or by runs of five words alike by 0.8, that of the least id."""
    return simhash.deduplicate(docs, row=place_in_file(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their private values replaced; n_chars is that of the new text.

    The key is the session's `spark.textloom.key`. Without one the published example is
    taken, with which anyone can undo the pseudonyms: for tests only.
    """
    hidden = pii.hide(docs, spark.conf.get("spark.textloom.key", EXAMPLE_KEY))
    return hidden.selectExpr(*[f"cast(length(text) as bigint) as {c}" if c == "n_chars" else f"`{c}`" for c in hidden.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them."""
    return mixing.apply_mix(docs, row=place_in_file(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows."""
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("private data", private_data),
    ("mixture", mixture),
    ("packing", packed),
]

#: No stage but the third can be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
