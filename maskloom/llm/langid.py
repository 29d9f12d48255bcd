"""Language identification by rank-order profiles.

Text is lower-cased and every run of characters that are no letters becomes one blank. The n-grams of 1 to 3 characters of
a text (none that is only a blank) are ranked by frequency, ties by character code. A language's profile is the ranking
of the n-grams counted over all its training texts. The out-of-place distance of a text to a profile sums, over the
text's first ``top`` n-grams, how far each is from its rank in the profile; one that isn't there counts as ``top``. The
nearest profile's language is predicted, the first by name on ties. Its score is how much nearer it is than the runner-up,
0.5 + 0.5 * (1 - d1 / d2), within 0.5 to 1; 0 if no profile has any of the text's n-grams.

Counting is a narrow pass, summed within each task, with one sum over (language, n-gram); the profiles, languages x top
rows, go to the driver, and more than ``most_languages`` languages are an error. Null texts and texts without a letter are
``und`` with score 0, as is everything when there is nothing to learn from. Repeated rows get equal values and count as
often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.runtime import cut, over_texts, slices

_BYTES = 1 << 19  # of text counted at once; sorting its n-grams takes some 75 bytes a character
_ROWS = 1 << 16  # of counts in a batch

_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower case, if it is a letter, or else 0. Where the lower case has several characters the letter itself stands."""
    if not _table:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _table.append(t)
    return _table[0]


def cleaned(text: str | None) -> np.ndarray:
    """Code points of the letters, lower-cased, with 32 for each run of others, one before and one after; empty if no letter is there."""
    if not text:
        return np.zeros(0, np.int64)
    a = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not a.any():
        return np.zeros(0, np.int64)
    a = np.concatenate(([0], a, [0]))
    kept = (a != 0) | np.concatenate(([True], a[:-1] != 0))
    return np.where(a[kept] == 0, 32, a[kept]).astype(np.int64)


def grams(a: np.ndarray) -> np.ndarray:
    """Keys of all n-grams of 1 to 3 characters: 21 bits a character, the first ones 0 in shorter n-grams."""
    one = a[a != 32]
    two = (a[:-1] << 21) | a[1:]
    three = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    return np.concatenate((one, two, three))


def ranked(a: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by key."""
    g = np.sort(grams(a))
    new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    count = np.diff(np.append(new, len(g)))
    keys = g[new]
    if len(keys) > top:  # all that may be among the first, still in order of keys
        least = np.partition(count, len(count) - top)[len(count) - top]
        keys, count = keys[count >= least], count[count >= least]
    return keys[np.argsort(-count, kind="stable")[:top]]


class Profiles(NamedTuple):
    names: list[str]
    keys: np.ndarray  # sorted
    ranks: np.ndarray  # languages x keys; top where a language lacks the key
    top: int


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[new], np.add.reduceat(n, new)


def counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, from columns text and lang without nulls: lang, g, n.

    Held over all batches of a task, so that it gives each (lang, g) once; past ``most`` of them it gives what it holds and begins
    anew.
    """
    held: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for x, got in held.items():
            k, n = summed(*got)
            for at in range(0, len(k), _ROWS):
                part = k[at : at + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(x, pa.string()), len(part)), pa.array(part, pa.int64()), pa.array(n[at : at + _ROWS], pa.int64())], ["lang", "g", "n"])
        held.clear()

    for batch in batches:
        for part in slices(batch, "text", _BYTES):
            by: dict[str, list[np.ndarray]] = {}
            for t, x in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                a = cleaned(t)
                if len(a):
                    by.setdefault(x, []).append(grams(a))
            for x, g in by.items():
                k, n = np.unique(np.concatenate(g), return_counts=True)
                keys, ns = held.setdefault(x, ([], []))
                keys.append(k)
                ns.append(n)
                size += len(k)
            if size > 2 * most:
                held |= {x: ([k], [n]) for x, got in held.items() for k, n in [summed(*got)]}
                size = sum(len(keys[0]) for keys, _ in held.values())
                if size > most:
                    yield from given()
                    size = 0
    yield from given()


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = 300, most_languages: int = 4096) -> Profiles:
    """Profiles from all rows given with a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    totals = cut(rows.mapInArrow(counts, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")))
    if totals.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    got = totals.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).collect()
    names = sorted({r["lang"] for r in got})
    keys = np.unique(np.array([r["g"] for r in got], np.int64))
    ranks = np.full((len(names), len(keys)), top, np.int32)
    at = {x: i for i, x in enumerate(names)}
    for r in got:
        ranks[at[r["lang"]], np.searchsorted(keys, r["g"])] = r["r"] - 1
    return Profiles(names, keys, ranks, top)


def nearest(text: str | None, p: Profiles) -> tuple[str, float]:
    a = cleaned(text)
    if not len(a) or not p.names:
        return "und", 0.0
    own = ranked(a, p.top)
    i = np.minimum(np.searchsorted(p.keys, own), len(p.keys) - 1)
    known = p.keys[i] == own
    ranks = p.ranks[:, i[known]]
    d = np.where(ranks == p.top, p.top, np.abs(ranks - np.flatnonzero(known))).sum(axis=1) + p.top * int((~known).sum())
    best = int(np.argmin(d))
    d1 = int(d[best])
    d2 = int(np.min(np.delete(d, best))) if len(d) > 1 else p.top * len(own)
    margin = 0.5 + 0.5 * (1 - d1 / d2) if d2 else 0.5
    return p.names[best], round(margin, 6) if d1 < p.top * len(own) else 0.0


def predicted(docs: DataFrame, p: Profiles, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [nearest(t, p) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["id", "lang_pred", "score"])

    return over_texts(base, f, f"id {base.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", doc_id)


def known_language(docs: DataFrame, p: Profiles, *, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of docs with a predicted language and a score above ``least``, with all their columns."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [nearest(t, p) for t in batch.column(text).to_pylist()]
        return batch.filter(pa.array([x != "und" and s > least for x, s in got], pa.bool_()))

    return over_texts(docs, f, docs.schema, text)
