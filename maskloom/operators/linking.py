"""Joins and windows that link spans, blocks, cells and exceptions. All of them are within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, of: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the right row of its keys that has the greatest ``of`` not above ``at``; null without one.

    Both sides are sorted together within the keys and the last right row is carried on: one shuffle, no range join.
    """
    row = F.struct(*values)
    r = right.select(*keys, F.col(of).cast("long").alias("__t"), F.lit(0).alias("__s"), row.alias("__r"))
    columns = [c for c in left.columns if c not in keys]
    whole = left.select(*keys, F.col(at).cast("long").alias("__t"), F.lit(1).alias("__s"), F.struct(*columns).alias("__l"))
    w = Window.partitionBy(*keys).orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = whole.unionByName(r, allowMissingColumns=True).withColumn("__r", F.last("__r", ignorenulls=True).over(w))
    return both.where("__s = 1").select(*keys, "__l.*", "__r.*")


def runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Islands of consecutive equal values: keys, island (from 1), value, first, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).groupBy(*keys, "island", value).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def to_blocks(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Offsets in the newline-joined text of a document, as block and offset there. offsets: (doc_id, o); blocks: (doc_id, block, len).

    The block is the last one that begins at or before the offset: an as-of join on the running sum of lengths.
    """
    w = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    based = blocks.withColumn("base", F.coalesce(F.sum(F.col("len") + 1).over(w), F.lit(0)))
    return asof(offsets, based, ["doc_id"], "o", "base", ["block", "base"]).withColumn("in_block", F.col("o") - F.col("base"))


def without_exceptions(spans: DataFrame, exceptions: DataFrame, on: list[str]) -> DataFrame:
    """Spans that no exception names at their place; other occurrences of the same word stay."""
    return spans.join(exceptions.select(*on).distinct(), on, "left_anti")


def unlocated(exceptions: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Exceptions that name no span: to be reported."""
    return exceptions.join(spans.select(*on).distinct(), on, "left_anti")


#: What a column's header says of its cells.
HINTS = (("账号", "账号|账户|卡号"), ("证件", "身份证|证件号"), ("金额", "金额|价款|合计"))


def with_headers(cells: DataFrame, headers: DataFrame, on: list[str]) -> DataFrame:
    """Cells with ``hint``, what their own column's header says; null if nothing.

    A header is read once, not once a cell. Headers that are few, as a table's columns are, should come with ``F.broadcast``:
    a shuffle by column has no more tasks than there are columns.
    """
    hint = F.lit(None).cast("string")
    for name, pattern in HINTS:
        hint = F.when(F.rlike("header", F.lit(pattern)), name).otherwise(hint)
    return cells.drop("hint").join(headers.withColumn("hint", hint), on, "left")


def within_budget(counts: DataFrame, name: str, n: str, budget: int) -> DataFrame:
    """The most frequent names that fit a prompt's budget of characters, one more for each. A report of bounded size.

    Only names that can fit are ranked: no more than ``budget`` of the most frequent, as each takes two characters at least.
    """
    head = counts.orderBy(F.desc(n), name).limit(budget)
    w = Window.orderBy(F.desc(n), name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return head.withColumn("used", F.sum(F.length(name) + 1).over(w)).where(F.col("used") <= budget)
