"""A training corpus from documents: five stages, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of docs. The last
returns the mix: one row per document that is taken, with how often.

Other columns are carried as they are, whatever their names. An empty table gives an empty one with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm import bagminhash, decontaminate, langid, mixing, toxicity
from maskloom.llm.runtime import checkpoint_folder, held_out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts, texts without a letter and of unknown n-grams only are rejected.

    Learned from rows with text and lang. Repeated rows fare alike; of languages equally near the first by code point is told,
    which rejects none.
    """
    return langid.known_language(docs, langid.learn(docs.where(~held_out())))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by a model of the labelled ones among them.

    Null and empty texts stay. Repeated rows fare alike; of several labels of an id the larger holds. Without labels of both
    kinds all stay.
    """
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least id.

    Null and empty texts and rows of null id are classes of their own, so they stay. Of rows equal in id and text one stays,
    the first by all columns; of an id with several texts each is judged by its text.
    """
    return bagminhash.one_of_each(docs, bagminhash.classes(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any run of 13 words of a benchmark item, and of which shorter items hit less than a twentieth.

    Null texts have no word and stay; items of null text have no window. Repeated rows fare alike, and so do repeated items.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with repeats and taken words.

    A null text has size 0; a null source is a source, the last; repeated rows are drawn one by one, and reruns agree.
    """
    return mixing.mixed(docs).where("repeats > 0")


STAGES = [("language", language), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mix)]

#: Models, signatures and the cube method have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder. Between stages the rows are written where all executors can read them."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
