"""Benchmark decontamination by winnowing.

Both sides keep the rightmost minimum hash of k words in each window of w such hashes. A span of k + w - 1 words that a
document shares with an item holds a whole window, and the same hash is kept for it on both sides; so every shared span
of that length meets in the join of fingerprints. Each meeting is extended: the windows of ``span`` words around it are
compared with the items' own, all diagonals at once, so that a text that repeats one word meets an item that does so in
time linear in both. Items of fewer words are one window: all runs of that many words are looked up.

The documents are passed once, whole, in a narrow pass, if the items' word hashes fit a block of a checked size. Else there is
one pass for each block; it keeps only what is hit, by the text's digest, and its block is dropped before the next one is
made. An item larger than a piece is cut into pieces that overlap by a window less one word. So driver and executors hold one
block at a time, however large benchmark and items are.

Null or empty texts have no words and no hit; repeated rows get equal values; ties of hashes go to the rightmost. An item of
null id hits and counts as one item, but has no id to list. With no items nothing is contaminated. Columns of the input other
than the two named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.runtime import cut, fresh, over_texts, slices
from maskloom.llm.words import grams, grams_at, inside, words


def winnow(h: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the rightmost minima of all windows of w hashes of k words, inside each text."""
    g = grams(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return g[:0], np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, w):
        other = g[j : j + n]
        lower = other <= least
        np.copyto(least, other, where=lower)
        at[lower] = j
    starts = np.flatnonzero(inside(bounds, k + w - 1, n))
    kept = np.zeros(len(g), bool)
    kept[starts + at[starts]] = True
    positions = np.flatnonzero(kept)
    return g[positions], positions


class Windows(NamedTuple):
    """The windows of n words of a block's items: distinct hashes in order, where one stands, and which items have it."""

    hashes: np.ndarray
    at: np.ndarray  # into the block's words
    bounds: np.ndarray  # of each hash's items
    items: np.ndarray


def _windows(h: np.ndarray, bounds: np.ndarray, which: np.ndarray, n: int) -> Windows:
    """Windows of the items whose numbers are which, each of n words or more."""
    g = grams(h, n)
    ok = np.flatnonzero(inside(bounds, n, len(g)))
    item = np.searchsorted(bounds, ok, side="right") - 1
    mine = np.isin(item, which)
    ok, item = ok[mine], item[mine]
    order = np.lexsort((item, g[ok]))
    ok, item = ok[order], item[order]
    new = np.ones(len(ok), bool)
    new[1:] = g[ok[1:]] != g[ok[:-1]]
    distinct = new.copy()
    distinct[1:] |= item[1:] != item[:-1]
    kept = np.flatnonzero(distinct)
    starts = np.flatnonzero(new[kept])
    return Windows(g[ok[new]], ok[new], np.append(starts, len(kept)), item[kept])


class Items:
    """Fingerprints and windows of a block of items, given as ids and word hashes."""

    def __init__(self, rows: list[tuple[str | None, np.ndarray]], k: int, w: int, span: int):
        self.k, self.w, self.span = k, w, span
        self.ids = [i for i, _ in rows]
        sizes = np.array([len(x) for _, x in rows], np.int64)
        self.words = np.concatenate([x for _, x in rows]) if rows else np.zeros(0, np.uint64)
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.prints = np.unique(winnow(self.words, bounds, k, w)[0])
        self.whole = _windows(self.words, bounds, np.flatnonzero(sizes >= span), span)
        self.short = {n: _windows(self.words, bounds, np.flatnonzero(sizes == n), n) for n in np.unique(sizes[(sizes > 0) & (sizes < span)]).tolist()}

    @staticmethod
    def near(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the h that are in the sorted table, and where in it; a bit map of the top bits goes first."""
        if not len(table) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.zeros(1 << 20, bool)
        bits[table >> np.uint64(44)] = True
        maybe = np.flatnonzero(bits[h >> np.uint64(44)])
        i = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
        same = table[i] == h[maybe]
        return maybe[same], i[same]

    def _mark(self, of: Windows, n: int, h: np.ndarray, bounds: np.ndarray, starts: np.ndarray, g: np.ndarray, change: np.ndarray, found: dict[int, set[int]]) -> None:
        """Counts up in change[a] and down in change[b] for each run [a, b) from starts that is a window; g are the hashes of starts."""
        hit, i = self.near(of.hashes, g)
        same = np.ones(len(hit), bool)
        for j in range(n):  # word by word: equal hashes of windows are not enough
            same &= h[starts[hit] + j] == self.words[of.at[i] + j]
        at, i = starts[hit[same]], i[same]
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        if len(at):
            doc = np.searchsorted(bounds, at, side="right") - 1
            for d, j in np.unique(np.stack([doc, i], axis=1), axis=0).tolist():
                found.setdefault(d, set()).update(of.items[of.bounds[j] : of.bounds[j + 1]].tolist())

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
        """Which words are hit, which of them by windows of span words, and the items of each text that has hits."""
        found: dict[int, set[int]] = {}
        whole, short = np.zeros(len(h) + 1, np.int64), np.zeros(len(h) + 1, np.int64)
        g, p = winnow(h, bounds, self.k, self.w)
        p = p[self.near(self.prints, g)[0]]
        if len(p):
            first = bounds[np.searchsorted(bounds, p, side="right") - 1]
            end = bounds[np.searchsorted(bounds, p, side="right")]
            starts = np.unique(np.concatenate([np.where((p - j >= first) & (p - j + self.span <= end), p - j, -1) for j in range(self.span - self.k + 1)]))
            starts = starts[starts >= 0]
            run = grams_at(h, starts, self.span)
            self._mark(self.whole, self.span, h, bounds, starts, run, whole, found)
        for n, table in self.short.items():
            s = grams(h, n)
            starts = np.flatnonzero(inside(bounds, n, len(s)))
            self._mark(table, n, h, bounds, starts, s[starts], short, found)
        of_whole = np.cumsum(whole[:-1]) > 0
        return of_whole | (np.cumsum(short[:-1]) > 0), of_whole, found


def pieces(items: DataFrame, item_id: str, text: str, span: int, most: int = 500_000) -> DataFrame:
    """(i, part, h): word hashes of each item's distinct texts, in pieces of at most so many words that share span - 1 with the next."""
    base = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "t"):
                got = words(one.column("t"))
                ids, rows = one.column("i").to_pylist(), []
                for i, a, b in zip(ids, got.bounds[:-1].tolist(), got.bounds[1:].tolist(), strict=True):
                    own, at = got.hashes[a:b], 0
                    while len(own):
                        rows.append((i, at, own[at : at + most].view(np.int64)))
                        if at + most >= len(own):
                            break
                        at += most - span + 1
                for i, at, own in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([at], pa.int64()), pa.array([own], pa.list_(pa.int64()))], ["i", "part", "h"])

    return cut(base.mapInArrow(run, "i string, part long, h array<long>"))


def blocks(items: DataFrame, item_id: str, text: str, k: int, w: int, span: int, block_bytes: int) -> tuple[int, Iterator]:
    """The number of blocks, and one broadcast after the other, each of about block_bytes of word hashes at most; the size is
    checked before anything is fetched."""
    spark = items.sparkSession
    of = pieces(items, item_id, text, span, max(4 * span, min(500_000, block_bytes // 16)))
    total = of.agg(F.coalesce(F.sum(F.size("h") * 8 + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // max(1, block_bytes // 2)))
    part = F.pmod(F.xxhash64("i", "part", F.element_at("h", 1)), F.lit(n))

    def each() -> Iterator:
        for b in range(n):
            table = of.where(part == b).sort("i", "part", "h").toArrow()
            flat = table.column("h").combine_chunks()
            ends = np.concatenate(([0], np.cumsum(np.array(flat.value_lengths(), np.int64)))) if len(flat) else np.zeros(1, np.int64)
            values = np.array(flat.flatten(), np.int64).view(np.uint64) if len(flat) else np.zeros(0, np.uint64)
            rows = [(i, values[x:y]) for i, x, y in zip(table.column("i").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield spark.sparkContext.broadcast(Items(rows, k, w, span))

    return n, each()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _of_blocks(base: DataFrame, each: Iterator) -> DataFrame:
    """(key, whole, hit, items) of the texts that are hit: the places of words hit, whether by a window of span words, and the items."""
    parts = []
    for b, x in enumerate(each):
        found = over_texts(base, lambda batch, x=x: _kept(batch, x.value), "key binary, whole boolean, hit array<long>, items array<string>")
        parts.append(cut(found.groupBy("key").agg(*(F.first(c).alias(c) for c in ("whole", "hit", "items"))).withColumn("block", F.lit(b))))
        x.destroy()
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return cut(every.groupBy("key").agg(F.max("whole").alias("whole"), joined("hit"), joined("items")))


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, w: int = 9, span: int = 13, share: int = 20, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words > 0).

    items_sha256 is the digest of the ids of items with an occurring window, as strings in order, comma-joined.
    """
    if k + w - 1 > span:
        raise ValueError("windows of w hashes of k words reach beyond the span")
    n, each = blocks(items, item_id, item_text, k, w, span, block_bytes)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    if n == 1:
        x = next(each)
        return over_texts(base, lambda b: _finish(b, x.value, share), f"id {id_type}, {_RESULT}").withColumnRenamed("id", doc_id)
    hits = _of_blocks(base.select("text"), each)
    counted = over_texts(base, _counted, f"id {id_type}, key binary, n_words long")
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    names = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    out = counted.join(hits, "key", "left")
    return out.select(F.col("id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, w: int = 9, span: int = 13, share: int = 20, whole: bool = False, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns.

    whole: also those go that hold any window of ``span`` words of an item, however long they are.
    """
    n, each = blocks(items, item_id, item_text, k, w, span, block_bytes)
    if n > 1:
        (own,) = fresh(docs, "key_of_it")
        hits = _of_blocks(docs.select(F.col(text).alias("text")), each)
        counted = over_texts(docs.select(F.col(text).alias("text")), _counted, "key binary, n_words long").join(hits, "key")
        bad = cut(counted.where((F.size("hit") * share >= F.col("n_words")) | (F.lit(whole) & F.col("whole"))).select(F.col("key").alias(own)).distinct())
        return docs.join(bad, F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))) == F.col(own), "left_anti")
    x = next(each)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = words(batch.column(text))
        hit, of_whole, _ = x.value.hits(got.hashes, got.bounds)
        n_hit, n_whole = _sums(hit, got.bounds), _sums(of_whole, got.bounds)
        return batch.filter(pa.array(~((n_hit > 0) & (share * n_hit >= np.diff(got.bounds)) | whole & (n_whole > 0))))

    return over_texts(docs, keep, docs.schema, text)


def _sums(on: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(on)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _names(found: dict[int, set[int]], d: int, ids: list[str | None]) -> list[str | None]:
    return sorted({ids[i] for i in found.get(d, ())}, key=lambda x: (x is None, x or ""))


def _finish(batch: pa.RecordBatch, items: Items, share: int) -> pa.RecordBatch:
    got = words(batch.column("text"))
    hit, _, found = items.hits(got.hashes, got.bounds)
    n, n_hit = np.diff(got.bounds), _sums(hit, got.bounds)
    names = [_names(found, d, items.ids) for d in range(len(n))]
    digests = [hashlib.sha256(",".join(x for x in own if x is not None).encode()).hexdigest() for own in names]
    contaminated = (n_hit > 0) & (share * n_hit >= n)
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digests, pa.string()), pa.array(contaminated)],
        ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _keys(batch: pa.RecordBatch) -> list[bytes]:
    return [hashlib.md5((x or "").encode()).digest() for x in batch.column("text").to_pylist()]


def _kept(batch: pa.RecordBatch, items: Items) -> pa.RecordBatch:
    """What a block hits, for the texts that it hits only."""
    got = words(batch.column("text"))
    hit, of_whole, found = items.hits(got.hashes, got.bounds)
    which = sorted(found)
    part = batch.take(pa.array(which, pa.int64()))
    places = [np.flatnonzero(hit[got.bounds[d] : got.bounds[d + 1]]) for d in which]
    n_whole = _sums(of_whole, got.bounds)[which] if which else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [pa.array(_keys(part), pa.binary()), pa.array(n_whole > 0), pa.array(places, pa.list_(pa.int64())), pa.array([_names(found, d, items.ids) for d in which], pa.list_(pa.string()))],
        ["key", "whole", "hit", "items"],
    )


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = pa.array(np.diff(words(batch.column("text")).bounds), pa.int64())
    out = [pa.array(_keys(batch), pa.binary()), n]
    return pa.RecordBatch.from_arrays([batch.column("id"), *out], ["id", "key", "n_words"]) if "id" in batch.schema.names else pa.RecordBatch.from_arrays(out, ["key", "n_words"])
