"""Names that a model gives: batches of text go to a recognizer, its answer's lines come back as names and exceptions.

A recognizer is any callable from batches of (doc_id, chunk, text) to answers; the one here takes them from a stored table,
so nothing is sent anywhere. Line grammar (ours): ``CLASS<tab>name``, ``EXCEPT<tab>name<tab>anchor``, a last line ``END``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of names and their labels.
CLASSES = (("PERSON", "人名"), ("PER", "人名"), ("LOCATION", "地址"), ("LOC", "地址"), ("ORGANIZATION", "公司"), ("ORG", "公司"))

Recognizer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def chunks(rows: DataFrame, size: int = 6000, overlap: int = 50, text: str = "text") -> DataFrame:
    """Rows with ``chunk`` and ``c``: overlapping windows that cover the whole text; an empty text is one empty chunk."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int"), F.lit(1))
    d = rows.where(F.col(text).isNotNull()).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return d.withColumn("c", F.substr(text, F.col("chunk") * step + 1, F.lit(size)))


def for_model(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Blocks worth asking about: not numbers and amounts alone. Fixed rules still see all."""
    return blocks.where(~F.rlike(text, F.lit(r"^[\s0-9.,%¥$元万亿+-]*$")))


def retrying(recognizer: Recognizer, attempts: int = 3, wait: float = 1.0, recoverable: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> Recognizer:
    """A recognizer that asks again after a recoverable error, with twice the wait each time, and lets the rest go on.

    A batch that still fails, or fails for another reason, is asked chunk by chunk; a chunk that fails on its own gets a
    null answer, which ``parsed`` reports as an issue.
    """

    def tried(batch: pd.DataFrame) -> pd.DataFrame:
        for i in range(attempts):
            try:
                return pd.concat(list(recognizer(iter([batch]))), ignore_index=True)
            except recoverable:
                if i == attempts - 1:
                    raise
                time.sleep(wait * 2**i)
        raise ValueError("no attempts")

    def guarded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            try:
                yield tried(batch)
            except Exception:  # noqa: BLE001  whatever a recognizer raises, the others go on
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1].reset_index(drop=True)
                    blank = one[["doc_id", "chunk"]].assign(answer=None)
                    try:
                        yield blank if len(batch) == 1 else tried(one)
                    except Exception:  # noqa: BLE001
                        yield blank

    return guarded


def asked_once(batches: DataFrame, recognizer: Recognizer, path: str) -> DataFrame:
    """``asked``, its answers kept in a table at path: chunks that have one there are not asked again, null ones are."""
    spark = batches.sparkSession
    try:
        had = spark.read.parquet(path).where("answer IS NOT NULL").select("doc_id", "chunk").distinct()
        batches = batches.join(had, ["doc_id", "chunk"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    asked(batches, recognizer).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("doc_id", "chunk").agg(F.max("answer").alias("answer"))


def relations_of(batches: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, chunk, surface, other): of a document's relations(doc_id, surface, other) those that a chunk needs.

    A chunk carries a relation if either of its names occurs in it; repeated relations count once.
    """
    r = relations.select("doc_id", "surface", "other").distinct()
    named = (F.length("surface") > 0) & F.contains("c", F.col("surface")) | (F.length("other") > 0) & F.contains("c", F.col("other"))
    return batches.select("doc_id", "chunk", "c").join(r, "doc_id").where(named).select("doc_id", "chunk", "surface", "other")


def asked(batches: DataFrame, recognizer: Recognizer) -> DataFrame:
    """(doc_id, chunk, answer) of batches(doc_id, chunk, c). ``retrying`` makes a recognizer that bears errors."""
    return batches.select("doc_id", "chunk", "c").mapInPandas(recognizer, "doc_id long, chunk int, answer string")


def stored(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """The offline recognizer: answers(doc_id, chunk, answer) of a table; null where it has none."""
    return batches.select("doc_id", "chunk").join(answers, ["doc_id", "chunk"], "left")


def parsed(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """names(doc_id, surface, label), exceptions(doc_id, surface, anchor), issues. What is valid of a cut answer is kept."""
    lines = answers.select("doc_id", "chunk", F.posexplode_outer(F.split("answer", "\n")).alias("i", "line")).withColumn("f", F.split("line", "\t"))
    label = F.lit(None).cast("string")
    for name, of in CLASSES:
        label = F.when(F.get("f", F.lit(0)) == name, of).otherwise(label)
    lines = lines.withColumn("label", label)
    name = F.trim(F.get("f", F.lit(1)))
    names = lines.where(F.col("label").isNotNull() & (F.size("f") == 2) & (name != "")).select("doc_id", name.alias("surface"), "label").distinct()
    exceptions = lines.where((F.get("f", F.lit(0)) == "EXCEPT") & (F.size("f") == 3)).select("doc_id", name.alias("surface"), F.get("f", F.lit(2)).alias("anchor")).distinct()
    ended = answers.groupBy("doc_id", "chunk").agg(F.max(F.coalesce(F.rlike("answer", F.lit(r"(^|\n)END\s*$")), F.lit(False))).alias("ended"))
    cut = ended.where("not ended").select("doc_id", F.lit("model").alias("stage"), F.lit("warning").alias("severity"), F.concat(F.lit("blank or cut answer for chunk "), F.col("chunk").cast("string")).alias("message"))
    bad = lines.where(F.col("label").isNull() & ~F.get("f", F.lit(0)).isin("EXCEPT", "END", "") & F.col("line").isNotNull()).select("doc_id", F.lit("model").alias("stage"), F.lit("warning").alias("severity"), F.concat(F.lit("line not understood: "), F.col("i").cast("string")).alias("message"))
    return names, exceptions, cut.unionByName(bad)


def in_text(names: DataFrame, documents: DataFrame) -> DataFrame:
    """Names that occur in their document's text."""
    return names.join(documents.select("doc_id", F.col("text").alias("__text")), "doc_id").where(F.contains("__text", F.col("surface"))).drop("__text")


def attached(documents: DataFrame, names: DataFrame) -> DataFrame:
    """documents with ``named``, what masking takes."""
    per = names.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("surface", "label"))).alias("named"))
    return documents.join(per, "doc_id", "left")
