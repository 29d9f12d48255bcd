"""Mixing sources to target sizes by cube-method sampling.

Each source has a target number of words; target over source size is how often each of its documents is taken on average.
The whole part is taken for all, the fraction is an inclusion probability. The cube method moves the probabilities of a
source along vectors that change neither the sum of probabilities (documents) nor that of probabilities times sizes (words),
until each is 0 or 1 but for two at most. A source is worked on in blocks of about ``block`` documents, chosen by hash; what
a block leaves open, two documents, goes to the next level's blocks, until a source is one block. There some documents, the
smallest and those of about twice the mean size, are kept out of the flight, and landed with the two that it leaves: of all
outcomes of these the one nearest in words and documents is taken. In a source of a few documents no outcome may be near; there
some of them may be taken twice.

A document is its (id, source, size); equal ones are counted before the shuffle and told apart by a running number, so no
key gathers an unbounded group. Choices come from a generator seeded by source, level and block: reruns agree. Null or
empty texts have size 0; a null source is one, the last; a null id is an id. Only three columns are looked at.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.runtime import cut

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, rank, weight, source_size, target) of (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating. Targets share ``share`` of all sizes by weight, none above
    ``most`` times its size; an excess is shared again by weight. So a target is min(most * size, level * weight): the level is
    found among the sources in order of size over weight, as the first that its source reaches.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        w = F.when((F.col("rank") - 1) % len(weights) == i, x).otherwise(w)
    x = ranked.withColumn("weight", w.cast("double")).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    x = x.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return x.select("source", "rank", "weight", "source_size", F.least("cap", F.coalesce(reached, F.lit(0.0)) * F.col("weight")).alias("target"))


def flight(p: list[float], z: list[float], rng: random.Random) -> list[int]:
    """Moves p in place to 0 and 1, keeping sum(p) and sum(p * z); the indexes left open, two at most."""
    queue = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    queue.reverse()
    hand: list[int] = []
    while True:
        while len(hand) < 3 and queue:
            hand.append(queue.pop())
        if len(hand) == 3:
            a, b, c = (z[i] for i in hand)
            u = (c - b, a - c, b - a)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            scale = max(map(abs, u))
            u = tuple(x / scale for x in u)
        elif len(hand) == 2 and z[hand[0]] == z[hand[1]]:
            u = (1.0, -1.0)
        else:
            return hand
        up = down = float("inf")
        for i, x in zip(hand, u, strict=True):
            if x > 0:
                up, down = min(up, (1.0 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1.0 - p[i]) / -x)
        step = up if rng.random() * (up + down) < down else -down
        rest = []
        for i, x in zip(hand, u, strict=True):
            v = p[i] + step * x
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            if 0.0 < p[i] < 1.0:
                rest.append(i)
        hand = rest


def land(p: list[float], z: list[float], left: list[int], twice: bool = False) -> None:
    """Rounds what is left to the outcome nearest in words, counted in mean documents, and in documents at a sixteenth.

    twice: where that is more than a twentieth of the words away and nine documents at most are left, some may be taken twice.
    """
    if not left:
        return
    sizes, mean = np.array([z[i] for i in left]), max(1.0, float(np.mean(z)))
    goal = sum(a * b for a, b in zip(p, z, strict=True))
    for choices in (2, 3):
        outcomes = np.arange(choices ** len(left))[:, None] // choices ** np.arange(len(left)) % choices
        shift = outcomes - np.array([p[i] for i in left])
        off = np.abs(shift @ sizes)
        best = int(np.argmin(off / mean + np.abs(shift.sum(axis=1)) / 16))
        if not twice or len(left) > 9 or off[best] <= goal / 20:
            break
    for j, i in enumerate(left):
        p[i] = float(outcomes[best, j])


def _block(table: pa.Table, level: int, seed: int, hold: int = 14) -> pa.Table:
    ids = table.column("id").to_pylist()
    size, nth = table.column("size").to_pylist(), table.column("nth").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, size[i], nth[i]))
    table = table.take(pa.array(order, pa.int64()))
    p, z = table.column("p").to_pylist(), [float(x) for x in table.column("size").to_pylist()]
    rank, block, blocks = (table.column(c)[0].as_py() for c in ("rank", "block", "blocks"))
    rng = random.Random(f"{seed}/{rank}/{level}/{block}")
    mixed = list(range(len(p)))
    rng.shuffle(mixed)
    q, y = [p[i] for i in mixed], [z[i] for i in mixed]
    last = blocks == 1
    mean = sum(y) / len(y)
    fit = sorted((i for i, (a, b) in enumerate(zip(q, y, strict=True)) if 0.0 < a < 1.0 and 0 < b <= 2 * mean), key=y.__getitem__) if last else []
    kept = fit if len(fit) <= hold else fit[: hold // 2] + fit[-(hold // 2) :]
    out_of_it = set(kept)
    flown = [i for i in range(len(q)) if i not in out_of_it]
    moving, own = [q[i] for i in flown], [y[i] for i in flown]
    left = [flown[i] for i in flight(moving, own, rng)]
    for i, v in zip(flown, moving, strict=True):
        q[i] = v
    if last:
        land(q, y, left + kept, not table.column("base")[0].as_py())
    out = np.empty(len(p))
    out[mixed] = q
    return table.select(["id", "size", "nth", "rank", "base"]).append_column("p", pa.array(out))


def _worker(level: int, seed: int):
    def f(table: pa.Table) -> pa.Table:
        return _block(table, level, seed)

    return f


def sizes_of(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(id, source, size, n): documents by (id, source, size), and how many rows each is."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), size.alias("size")).groupBy("id", "source", "size").agg(F.count("*").alias("n"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = 8192, seed: int = 0, small: int = 100_000) -> DataFrame:
    """One row per row of docs: its id, source, size, source_size, target, repeats and taken = repeats * size."""
    units = cut(sizes_of(docs, doc_id, text, source))
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    goal = targets(by_source.select("source", "source_size"), share=share, most=most, weights=weights)
    goal = cut(goal.join(by_source.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    goal = goal.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    few = F.broadcast if goal.count() <= small else lambda x: x
    x = units.withColumnRenamed("source", "s").join(few(goal), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    # One row for each of equal rows, 4096 at a time.
    x = x.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(4096)))).withColumn("nth", F.explode(F.sequence(F.col("lot"), F.least(F.col("lot") + 4095, F.col("n") - 1))))
    x = x.select("id", "size", "nth", "rank", F.floor("ratio").cast("int").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"), F.ceil(F.col("rows") / block).alias("blocks"))
    state = f"id {units.schema['id'].dataType.simpleString()}, size long, nth long, rank int, base int, p double"
    done: DataFrame | None = None
    level = 0
    while True:
        x = x.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "id", "size", "nth"), F.col("blocks")))
        out = cut(x.groupBy("rank", "block").applyInArrow(_worker(level, seed), state))
        settled = out.where("p <= 0 or p >= 1")
        done = settled if done is None else done.unionByName(settled)
        still = out.where("p > 0 and p < 1")
        if still.isEmpty():
            break
        level += 1
        count = still.groupBy("rank").agg(F.ceil(F.count("*") / block).alias("blocks"))
        x = still.join(few(count), "rank").select("id", "size", "nth", "rank", "base", "p", "blocks")
    repeats = (F.floor("ratio") + F.col("p")).cast("long")
    out = done.join(few(goal.select("rank", "source", "source_size", "target", "ratio")), "rank")
    return out.select(F.col("id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))
