"""Near-duplicates by BagMinHash signatures of weighted shingles.

A text is the bag of its runs of five words (all its words, if it has fewer), each weighing as often as it occurs. Weights
are discretised to whole levels. The levels of an element are cut into dyadic intervals (0, 1], (1, 2], (2, 4], (4, 8] ...,
each with a Poisson process whose rate is its length; a point goes down the interval to one level, a half at each bit of its hash
(a dyadic interval's length is a power of two, so the low bits are the level), and counts for a text within whose weight the level is. Every point also has one of m slots, and a slot keeps the
first point of all. Two texts keep the same point of a slot with probability equal to their weighted Jaccard similarity.
Points are made in order of time only up to a horizon at which all slots are filled, so a text of n shingles costs about
n + m log m points.

Signatures are cut into bands. Equal bags are one node. In a bucket each node is verified against the bucket's pivot by exact
multiset overlap, so a group becomes a star. Where a bucket still holds several components, all pairs of different ones
are found that sizes and prefixes of rare elements don't exclude (see ``_rest``), and verified. So every pair that shares a
bucket and is similar enough ends in one class, without the pairs of a group being listed.

Rows of null doc_id, and null or empty texts and those without a word, are classes of their own. Repeated rows share their
class. Of an id with several texts each row has its text's class. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.graph import components
from maskloom.llm.runtime import cut, fresh, over_texts, packed, release
from maskloom.llm.words import U, grams, inside, mix, words

_STEP, _SLOT, _LEVEL, _AGAIN = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _times(n: int) -> np.uint64:
    return U(int(_STEP) * n & (1 << 64) - 1)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each text, repeats kept, and each text's bounds."""
    got = words(texts)
    n = np.diff(got.bounds)
    all_k = grams(got.hashes, k)
    kept = all_k[inside(got.bounds, k, len(all_k))]
    bounds = np.concatenate(([0], np.cumsum(np.where(n >= k, n - k + 1, 0))))
    parts = [kept[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for d in np.flatnonzero((n > 0) & (n < k)).tolist():
        parts[d] = grams(got.hashes[got.bounds[d] : got.bounds[d + 1]], int(n[d]))
    parts = [np.sort(p) for p in parts]
    return (np.concatenate(parts) if parts else kept), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def signatures(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Of each text with shingles (sorted, with repeats) the identities of the first points of its m slots."""
    docs = len(bounds) - 1
    sig = np.zeros((docs, m), np.uint64)
    if not len(h):
        return sig
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    weight = np.diff(np.append(starts, len(h)))
    element, owner = h[starts], doc[starts]
    seeds, owners, lows, weights = [mix(element + _STEP)], [owner], [np.zeros(len(owner), np.int64)], [weight]
    low = 1
    while (more := weight > low).any():  # the interval (low, 2 low]
        seeds.append(mix(element[more] + _times(low + 1)))
        owners.append(owner[more])
        lows.append(np.full(int(more.sum()), low))
        weights.append(weight[more])
        low *= 2
    seed, own, lo, w = (np.concatenate(x) for x in (seeds, owners, lows, weights))
    rate = np.maximum(lo, 1).astype(float)
    total = np.diff(bounds).astype(float)
    todo, horizon = total > 0, m * (np.log(m) + 8) / np.maximum(total, 1)
    while todo.any():
        use = todo[own]
        got = _points(seed[use], own[use], lo[use], w[use], rate[use], horizon, m)
        sig[todo] = 0
        where, t, who = got
        least = np.full(docs * m, np.inf)
        np.minimum.at(least, where, t)
        won = t == least[where]
        sig.reshape(-1)[where[won]] = who[won]
        todo &= np.isinf(least.reshape(docs, m)).any(axis=1)
        horizon = horizon * 2
    return sig


def _points(seed, own, lo, w, rate, horizon, m):
    t, r, out = np.zeros(len(seed)), 0, []
    while len(seed):
        state = mix(seed + _times(r + 1))
        t = t - np.log(((state >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate
        live = t <= horizon[own]
        if not live.all():
            seed, own, lo, w, rate, t, state = (x[live] for x in (seed, own, lo, w, rate, t, state))
        level = lo + 1 + (mix(state ^ _LEVEL) % np.maximum(lo, 1).astype(np.uint64)).astype(np.int64)
        hit = level <= w
        slot = (mix(state ^ _SLOT) % U(m)).astype(np.int64)
        out.append(((own * m + slot)[hit], t[hit], state[hit]))
        r += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many slots; the band's number is part of it."""
    bands = sig.shape[1] // rows
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _AGAIN), (len(sig), bands)).copy()
    for i in range(rows):
        key = mix(key ^ sig[:, i::rows][:, :bands])
    return key.view(np.int64)


def _digests(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    return [hashlib.md5(h[a:b].tobytes()).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def signed(docs: DataFrame, k: int, m: int, rows: int) -> DataFrame:
    """(id, text_hash, node, bands) of docs(id, text, text_hash); node is null where there is no word or no id."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, bounds = shingles(batch.column("text"), k)
        keys = band_keys(signatures(h, bounds, m), rows)
        ids = batch.column("id")
        node = [None if x is None or not ok else x for x, ok in zip(_digests(h, bounds), ids.is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([ids, batch.column("text_hash"), pa.array(node, pa.binary()), _lists(keys.reshape(-1), np.arange(len(keys) + 1) * keys.shape[1])], ["id", "text_hash", "node", "bands"])

    return over_texts(docs, f, f"id {docs.schema['id'].dataType.simpleString()}, text_hash long, node binary, bands array<long>")


def bags(docs: DataFrame, k: int) -> DataFrame:
    """(node, bag, low, n) of docs(text): shingles as levels, so that a bag is a set of n (shingle, occurrence) hashes.

    low has the distinct values of the hashes' last 16 bits: a bag's outline, with which most pairs can be excluded.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, bounds = shingles(batch.column("text"), k)
        nth = np.arange(len(h))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[bounds[:-1][bounds[:-1] < len(h)]] = True
        nth = nth - np.maximum.accumulate(np.where(new, nth, 0)) if len(h) else nth
        levels = np.where(nth == 0, h, mix(h + nth.astype(np.uint64) * _LEVEL))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        outline = np.unique((doc.astype(np.uint64) << U(16)) | (levels & U(0xFFFF)))
        cuts = np.searchsorted(outline >> U(16), np.arange(len(bounds)))
        low = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((outline & U(0xFFFF)).astype(np.uint16).view(np.int16)))
        return pa.RecordBatch.from_arrays([pa.array(_digests(h, bounds), pa.binary()), _lists(levels.view(np.int64), bounds), low, pa.array(np.diff(bounds), pa.int32())], ["node", "bag", "low", "n"])

    return over_texts(docs, f, "node binary, bag array<long>, low array<short>, n int")


def overlap(pairs: DataFrame, of: DataFrame, least: float = 0.0, few: int = 200_000) -> DataFrame:
    """(a, b, j) of the pairs whose weighted Jaccard similarity j reaches least, exact.

    Outlines go first. Elements that share an outline value count once in it, so an overlap is at most the outlines' and what
    one side has lost by that; pairs that this excludes need no bags. Up to ``few`` pairs are broadcast to the bags.
    """
    x = pairs.join(of.select(F.col("node").alias("b"), F.col("low").alias("low_b"), F.col("n").alias("nb")), "b").join(of.select(F.col("node").alias("a"), F.col("low").alias("low_a"), F.col("n").alias("na")), "a")
    most = F.size(F.array_intersect("low_a", "low_b")) + F.least(F.col("na") - F.size("low_a"), F.col("nb") - F.size("low_b"))
    left = packed(x.where(most >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9).select("a", "b"))
    n = left.count()
    small = F.broadcast if n <= few else lambda d: d
    side = lambda c, bag: of.select(F.col("node").alias(c), F.col("bag").alias(bag)).join(small(left), c)
    y = side("a", "bag_a").join(side("b", "bag_b"), ["a", "b"])
    y = y.select("a", "b", F.size(F.array_intersect("bag_a", "bag_b")).alias("i"), (F.size("bag_a") + F.size("bag_b")).alias("n"))
    return y.select("a", "b", (F.col("i") / (F.col("n") - F.col("i"))).alias("j")).where(F.col("j") >= least).coalesce(n // 20_000 + 1)


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 4) -> DataFrame:
    """One row per document: its id and class_id, the least id of its class; text_hash, and is_head, whether it heads its class.

    A class is headed by its least id and, of several texts that this id has in it, by that of the least hash.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sig = cut(signed(base.withColumn("text_hash", F.xxhash64("text")), k, bands * rows, rows))
    nodes = packed(sig.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.first("bands").alias("bands")).select("node", F.col("first.id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), "bands"), 10_000)
    member = _members(nodes)
    wanted = nodes.join(member.select("node").distinct(), "node", "left_semi").select("rep")
    texts = base.join(wanted, F.col("id") == F.col("rep")).select("text")
    of = packed(bags(texts, k).dropDuplicates(["node"]), 5_000)
    del texts, wanted
    release(base.sparkSession)
    links = packed(_similar(_to_pivots(member), of, similarity))
    comp = components(links)
    release(base.sparkSession)
    open_nodes = _open(member, comp)
    if not open_nodes.isEmpty():
        links = links.unionByName(packed(_similar(packed(_rest(open_nodes, of, similarity)), of, similarity)))
        release(base.sparkSession)
        comp = components(links)
    named = nodes.select("node", "rep", "rep_hash").join(comp, "node", "left").select("node", F.struct("rep", "rep_hash").alias("first"), F.coalesce("comp", "node").alias("comp"))
    heads = cut(named.groupBy("comp").agg(F.min("first").alias("head")))
    of_node = named.join(heads, "comp").select("node", "head")
    out = sig.select("id", "text_hash", "node").join(of_node, "node", "left")
    is_head = F.coalesce((F.col("id") == F.col("head.rep")) & (F.col("text_hash") == F.col("head.rep_hash")), F.lit(True))  # rows without a node head their own
    return out.select(F.col("id").alias(doc_id), F.coalesce("head.rep", "id").alias("class_id"), "text_hash", is_head.alias("is_head"))


def _similar(pairs: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    return overlap(pairs, of, similarity).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, c) of the buckets that hold c > 1 nodes.

    The counts are a table of their own before the join, so that Spark can split a hot bucket's rows over tasks.
    """
    each = nodes.select("node", F.explode("bands").alias("key"))
    return packed(each.join(cut(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")), "key"))


def _to_pivots(member: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket with the bucket's pivot, the node that meets most others in all its buckets.

    A text that many were made of has the common bands of them all, so it is the pivot of all their buckets.
    """
    popular = member.groupBy("node").agg(F.sum("c").alias("met"))
    pivots = cut(member.join(popular, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("p")).select("key", F.col("p.node").alias("a")))
    return member.join(pivots, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _open(member: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, c, s, probe) of the nodes of buckets that hold several components: the component, its size, and whether one of
    these buckets holds a larger one (of equal sizes the greater name counts as larger)."""
    sized = comp.join(cut(comp.groupBy("comp").agg(F.count("*").alias("s"))), "comp")
    m = packed(member.select("key", "node").join(sized, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("c"), F.coalesce("s", F.lit(1)).alias("s")))
    several = cut(m.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("s", "c")).alias("top")).where("lo <> hi").select("key", "top"))
    each = m.join(several, "key").select("node", "c", "s", (F.struct("s", "c") < F.col("top")).alias("probe"))
    return packed(each.groupBy("node").agg(F.first("c").alias("c"), F.first("s").alias("s"), F.max("probe").alias("probe")))


def _rest(open_nodes: DataFrame, of: DataFrame, t: float, zone: float = 1.05) -> DataFrame:
    """(a, b): all pairs of two components that can reach similarity t, by prefixes of elements in the order of their counts.

    J(x, y) >= t needs an overlap of o = ceil(t / (1 + t) (|x| + |y|)). With the elements of all nodes in one order, the
    first that x and y share stands at |x| - o and |y| - o at most, so they meet in these prefixes. Elements of one node alone
    come first in the order; they fill a prefix and meet nobody. Of those that share prefix elements, the last of them at
    places i and j, the overlap is at most their number and what follows in the shorter rest. x is in the smaller component
    and looks in zones of fitting sizes, for the prefix of that zone only.
    """
    x = open_nodes.withColumn("nid", F.xxhash64("node"))  # short rows for the large shuffles here
    element = x.join(of.select("node", "bag"), "node").select("nid", F.explode("bag").alias("e"))
    counts = cut(element.groupBy("e").agg(F.count("*").cast("int").alias("m")).where("m > 1"))
    shared = element.join(counts, "e").groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("m", "e"))).alias("shared"))
    least = lambda n: F.ceil(n * t - 1e-9)
    own = F.col("n") - F.size("shared")  # elements of this node alone
    first = x.join(of.select("node", "n"), "node").join(shared, "nid").withColumn("own", own).where(F.col("own") <= F.col("n") - least(F.col("n")))
    first = packed(first.select("node", "nid", F.xxhash64("c").alias("c"), "s", "probe", "n", "own", F.expr(f"slice(shared.e, 1, cast(n - ceil(n * {t} - 1e-9) as int) + 1 - own)").alias("prefix")))
    zone_of = lambda n: F.floor(F.log(n) / F.log(F.lit(zone))).cast("int")
    y = first.select(F.posexplode("prefix").alias("j", "e"), "own", F.col("nid").alias("y"), F.col("c").alias("cy"), F.col("s").alias("sy"), F.col("n").alias("ny"), zone_of(F.col("n")).alias("zone")).withColumn("j", F.col("own") + F.col("j")).drop("own")
    need = lambda both: F.ceil(both * (t / (1 + t)) - 1e-9)
    lowest = F.greatest(least(F.col("nx")), F.floor(F.pow(F.lit(zone), F.col("zone"))) - 1)  # the least size that may be in a zone
    probe = first.where("probe").select("own", "prefix", F.col("nid").alias("x"), F.col("c").alias("cx"), F.col("s").alias("sx"), F.col("n").alias("nx"), F.explode(F.sequence(zone_of(least(F.col("n"))), zone_of(F.floor(F.col("n") / t + 1e-9)))).alias("zone"))
    probe = probe.withColumn("to", F.col("nx") - need(F.col("nx") + lowest) - F.col("own") + 1).where("to > 0")
    probe = probe.select(F.posexplode(F.expr("slice(prefix, 1, cast(to as int))")).alias("i", "e"), "own", "x", "cx", "sx", "nx", "zone").withColumn("i", F.col("own") + F.col("i")).drop("own")
    o = need(F.col("nx") + F.col("ny"))
    fits = (F.least("nx", "ny") >= F.greatest("nx", "ny") * t - 1e-9) & (F.col("i") <= F.col("nx") - o) & (F.col("j") <= F.col("ny") - o)
    smaller = (F.col("sx") < F.col("sy")) | ((F.col("sx") == F.col("sy")) & (F.col("cx") < F.col("cy")))
    met = probe.alias("p").join(y.alias("q"), (F.col("p.e") == F.col("q.e")) & (F.col("p.zone") == F.col("q.zone")) & smaller & fits)
    met = met.groupBy("x", "y").agg(F.count("*").alias("both"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    met = packed(met.where(F.col("both") + F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) - 1 >= o).select("x", "y"))
    name = first.select("nid", "node")
    return met.join(name.select(F.col("nid").alias("x"), F.col("node").alias("a")), "x").join(name.select(F.col("nid").alias("y"), F.col("node").alias("b")), "y").select("a", "b")


def one_of_each(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that head their classes, by id and text, with all their columns.

    Of rows equal in both one stays, the first by all columns written as JSON. Rows of null id stay.
    """
    own, digest, rows_of, whole_row = fresh(docs, "id_of_it", "hash_of_it", "rows_of_it", "whole_of_it")
    heads = found.where(F.col("is_head") & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(own), F.col("text_hash").alias(digest)).agg(F.count("*").alias(rows_of))
    rows = docs.join(heads, (docs[doc_id] == F.col(own)) & (F.xxhash64(docs[text]) == F.col(digest)))
    single = rows.where(F.col(rows_of) == 1).select(*docs.columns)
    whole = F.struct(*docs.columns)
    several = rows.where(F.col(rows_of) > 1).groupBy(own, digest).agg(F.min_by(whole, F.to_json(whole)).alias(whole_row)).select(f"{whole_row}.*")
    return single.unionByName(several).unionByName(docs.where(F.col(doc_id).isNull()))
