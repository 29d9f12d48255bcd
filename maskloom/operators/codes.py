"""Codes over exploded spans: numbers, suffixes, and the mapping tables they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.spans import suffix


def numbered(spans: DataFrame) -> DataFrame:
    """(doc_id, label, surface, first, n) of spans(doc_id, label, surface, start): numbers per file and label, by first position."""
    first = spans.groupBy("doc_id", "label", "surface").agg(F.min("start").alias("first"))
    return first.withColumn("n", F.dense_rank().over(Window.partitionBy("doc_id", "label").orderBy("first")))


def collided(rows: DataFrame, keys: list[str], original: str, made: str, order: str) -> DataFrame:
    """(keys, original, code): equal originals share a code, different ones of one coarse form are told apart by suffix."""
    first = rows.groupBy(*keys, original, made).agg(F.min(order).alias("first"))
    k = F.row_number().over(Window.partitionBy(*keys, made).orderBy("first")) - 1
    return first.withColumn("code", F.concat(F.col(made), suffix(k))).drop("first")


def mapping_json(codes: DataFrame) -> DataFrame:
    """(doc_id, mapping): version 2, one JSON text a document, of codes(doc_id, code, surface, label)."""
    entry = F.struct(F.col("code"), F.col("surface"), F.col("label"))
    return codes.groupBy("doc_id").agg(F.to_json(F.struct(F.lit(2).alias("version"), F.array_sort(F.collect_list(entry)).alias("entries"))).alias("mapping"))


def mapping_read(files: DataFrame, text: str = "mapping") -> DataFrame:
    """(doc_id, version, code, surface) of mapping files: version 2 entries, or the flat map of version 1; others give no row."""
    v2 = F.from_json(text, "version int, entries array<struct<code:string,surface:string,label:string>>")
    flat = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("code"), e["value"].alias("surface")))
    entries = F.when(v2["version"] == 2, F.transform(v2["entries"], lambda e: F.struct(e["code"].alias("code"), e["surface"].alias("surface")))).otherwise(flat)
    version = F.when(v2["version"] == 2, 2).otherwise(1)
    return files.select("doc_id", version.alias("version"), F.explode(entries).alias("e")).select("doc_id", "version", "e.code", "e.surface")


def ambiguous(mapping: DataFrame) -> DataFrame:
    """Codes that stand for several originals: nothing restores them."""
    return mapping.groupBy("doc_id", "code").agg(F.count("surface").alias("originals")).where("originals > 1")


def counters(mapping: DataFrame) -> DataFrame:
    """(doc_id, label, last): the greatest number of each label, by the codes' exact form."""
    n = F.regexp_extract("code", r"^\[([^\[\]0-9]+)([0-9]+)\]", 2).try_cast("int")
    return mapping.select("doc_id", F.regexp_extract("code", r"^\[([^\[\]0-9]+)([0-9]+)\]", 1).alias("label"), n.alias("n")).where("n is not null").groupBy("doc_id", "label").agg(F.max("n").alias("last"))
