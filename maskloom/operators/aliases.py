"""Upkeep of a document's aliases: which candidates count, to whom a declaration belongs, and what moves where.

All joins and windows are within a document (``doc_id``); nothing is learned from one document for another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.plans.masking import ORG_LABEL


def without_dirty(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (doc_id, surface, ...) but those that hold a shorter name of their document's known ones (doc_id, surface).

    Such a match took words of its context with it. A candidate that is itself known stays; null surfaces stay.
    """
    k = known.select(F.col("doc_id").alias("__doc"), F.col("surface").alias("__known")).where(F.length("__known") > 0).distinct()
    inside = (F.col("doc_id") == F.col("__doc")) & F.contains("surface", F.col("__known")) & (F.length("surface") > F.length("__known"))
    return candidates.join(k, inside, "left_anti")


def declared_to(hits: DataFrame) -> DataFrame:
    """(doc_id, alias, full): to which name each declaration belongs, hits being (doc_id, start, surface, label, alias).

    A row with ``alias`` declares it for the hit before it in the document, and only if that one is an organization. A
    declaration that is repeated counts once; of several for one alias the first holds. The first hit of a document has none
    before it, so what it declares is dropped. Hits that begin at the same place are taken in the order of their surfaces.
    """
    w = Window.partitionBy("doc_id").orderBy("start", "surface")
    before = hits.withColumn("__label", F.lag("label").over(w)).withColumn("__full", F.lag("surface").over(w))
    bound = before.where(F.col("alias").isNotNull() & (F.col("__label") == ORG_LABEL))
    first = bound.groupBy("doc_id", "alias").agg(F.min(F.struct("start", "__full")).alias("__first"))
    return first.select("doc_id", "alias", F.col("__first.__full").alias("full"))


def moved(names: DataFrame, moves: DataFrame) -> DataFrame:
    """names (doc_id, surface, org_id) where an organization that turned out to be another's alias hands its variants over.

    moves: (doc_id, old, new), one level: what moves to ``new`` stays there even if ``new`` moves too. Of several moves of
    one organization that to the least id holds; repeated moves change nothing.
    """
    one = moves.groupBy("doc_id", F.col("old").alias("org_id")).agg(F.min("new").alias("__new"))
    return names.join(one, ["doc_id", "org_id"], "left").withColumn("org_id", F.coalesce("__new", "org_id")).drop("__new").select(names.columns)


def registered(names: DataFrame, more: DataFrame) -> DataFrame:
    """names and those of more whose surface the document doesn't have yet; of several for one surface that of the least org_id."""
    new = more.groupBy("doc_id", "surface").agg(F.min("org_id").alias("org_id")).join(names.select("doc_id", "surface").distinct(), ["doc_id", "surface"], "left_anti")
    return names.select("doc_id", "surface", "org_id").unionByName(new)
