"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words and their first 7, 6, 5 and 4 bytes; a word is scored as the longest of these that has a score. A
token's score is the log of its odds of being in a toxic against another labelled text, the counts of texts smoothed by
a Dirichlet prior that is shaped as the pooled counts; a text counts once, and equal texts count as one. Tokens whose counts differ from chance by a root
likelihood ratio of a cut and whose score is s_min at least keep it; all others share one slightly negative score, low
enough for a negative mean over clean texts. A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a text. With
lambda, the positive root of sum p exp(lambda s) = 1 over the tokens of clean texts, and K, matched to the segments seen
in clean texts, a segment of score S in a text of n tokens is as likely by chance as p = 1 - exp(-K n exp(-lambda S))
(the extreme-value law). The cut is z_min or a weaker one, if that separates the labels of rows not used for the counts
better, as where few texts are labelled and no token passes z_min. The text's score is alpha / (alpha + p), p that of its best segment, so it is 0.5 at p = alpha;
alpha is the p that separates labels best on rows not used for the counts.

Training reads a sample of labelled rows: all of them up to ``most_labels``, else about so many by hash. Scoring is one
narrow pass over whole texts. Null or empty texts have no token and p = 1. Labels other than 0 and 1, and null ids, are
left out of training; of several labels for one id the larger holds. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.runtime import bounded_sample, cut, fold, over_texts
from maskloom.llm.words import words


#: Bytes of a word's leading parts, the longest first.
PARTS = (7, 6, 5, 4)


class Model(NamedTuple):
    tokens: np.ndarray  # sorted hashes
    scores: np.ndarray
    default: float
    lam: float
    k: float
    alpha: float
    cut: float  # segments of a larger p aren't significant


NONE = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0, 0.0, 0.0)


def segments(at: list[int], score: list[float], n: int, default: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n tokens, of which those listed have scores of their own.

    A run of other tokens counts as one item of a negative score, so the scan is linear in the listed tokens.
    """
    out: list[list[float]] = []  # start, end, sum before it, sum at its end
    total, last = 0.0, 0
    for i, s in zip(at, score, strict=True):
        total += default * (i - last)
        last = i + 1
        if s <= 0:
            total += s
            continue
        new = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(int(a), int(b), right - left) for a, b, left, right in out]


def looked_up(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the h that are in the sorted table, and where in it."""
    if not len(table) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.zeros(1 << 22, bool)
    bits[table >> np.uint64(42)] = True
    maybe = np.flatnonzero(bits[h >> np.uint64(42)])
    i = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
    same = table[i] == h[maybe]
    return maybe[same], i[same]


def scan(texts: pa.Array, m: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Numbers of tokens and maximal segments of each text."""
    got = words(texts, PARTS)
    return np.diff(got.bounds), _scanned(got, m)


def _scanned(got, m: Model) -> list[list[tuple[int, int, float]]]:
    own = np.full(got.hashes.shape[1], -1)
    for row in got.hashes[::-1]:
        where, of = looked_up(m.tokens, row)
        own[where] = of
    at = np.flatnonzero(own >= 0)
    which = own[at]
    cuts = np.searchsorted(at, got.bounds)
    found: list[list[tuple[int, int, float]]] = [[] for _ in range(len(got.bounds) - 1)]
    scores = m.scores[which]
    for d in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[d], cuts[d + 1]
        found[d] = segments((at[a:b] - got.bounds[d]).tolist(), scores[a:b].tolist(), int(got.bounds[d + 1] - got.bounds[d]), m.default)
    return found


def p_value(n: int, s: float, m: Model) -> float:
    return -math.expm1(-min(700.0, m.k * max(n, 1) * math.exp(-min(700.0, m.lam * s)))) if s > 0 else 1.0


def _training(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """fold, label and text of labelled rows with crc32(doc_id) mod 5 not 0; the labels are few enough to broadcast."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).select("id", "y", fold("id").alias("fold")).where("fold <> 0")
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(bounded_sample(known, most, "id")), "id").select("fold", "y", "text")


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each token: toxic and other texts with it, and its occurrences in these."""
    got = words(batch.column("text"), PARTS)
    y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.tile(np.repeat(np.arange(len(y)), np.diff(got.bounds)), len(got.hashes))
    h = got.hashes.ravel()
    real = h != 0
    h, doc = h[real], doc[real]
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x, starts) if len(starts) else x for x in ((first & (y[doc] == 1)).astype(np.int64), (first & (y[doc] == 0)).astype(np.int64), (y[doc] == 1).astype(np.int64), (y[doc] == 0).astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), *(pa.array(x, pa.int64()) for x in sums)], ["h", "t", "o", "ft", "fo"])


def root(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, for a negative mean and some positive score."""
    lo, hi = 0.0, 1.0
    f = lambda x: float(np.sum(p * np.exp(np.minimum(x * scores, 600)))) - 1
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    lo = hi / 2 if hi > 1 else 1e-6
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_labels: int = 200_000, prior: float = 10.0, z_min: float = 4.5, weaker: tuple[float, ...] = (4.0, 3.5, 3.0, 2.5, 2.0), s_min: float = 1.5, drift: float = 0.05) -> Model:
    """Counts on folds 1 to 3, calibration on fold 4, which also chooses among z_min and weaker cuts.

    What comes to the driver is bounded by most_labels: the tokens of that many texts that pass the weakest cut, as three
    numbers each, and the segments' scores of the texts of fold 4."""
    train = _training(docs, labels, doc_id, text, label, most_labels)
    part = train.where("fold < 4").withColumn("x", F.xxhash64("text")).dropDuplicates(["y", "x"]).select("y", "text")
    counts = over_texts(part, _counts, "h long, t long, o long, ft long, fo long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("t", "o", "ft", "fo")))
    counts = cut(counts.where("t + o >= 2"))
    sizes = {r["y"]: r["n"] for r in part.groupBy("y").agg(F.count("*").alias("n")).collect()}
    nt, no = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not nt or not no:
        return NONE
    a = F.lit(prior) * (F.col("t") + F.col("o")) / (nt + no)
    odds = lambda c, n: F.log((F.col(c) + a) / (n + prior - F.col(c) - a + 0.5))
    part_of = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (nt + no) / ((F.col("t") + F.col("o")) * n))).otherwise(0.0)
    g = F.sqrt(F.greatest(2 * (part_of("t", nt) + part_of("o", no)), F.lit(0.0)))
    scored = counts.select("*", (odds("t", nt) - odds("o", no)).alias("s"), g.alias("z"))
    cuts = sorted({z_min, *weaker}, reverse=True)
    kept = scored.where((F.col("z") >= cuts[-1]) & (F.abs(F.col("s")) >= s_min)).select("h", "s", "z", "ft", "fo").toArrow()
    kept = kept.take(np.lexsort((kept.column("h").to_numpy(), -kept.column("z").to_numpy())))
    up, z = kept.column("s").to_numpy() > 0, kept.column("z").to_numpy()
    if not up.any():
        return NONE
    all_t, all_o = (float(x or 0) + 1 for x in counts.agg(F.sum("ft"), F.sum("fo")).first())
    sizes_of = [int((z >= at).sum()) for at in cuts]
    models = [_model(kept.slice(0, n), all_t, all_o, drift) for n in dict.fromkeys(sizes_of) if up[:n].any()]

    def seen(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = words(batch.column("text"), PARTS)
        n = np.tile(np.diff(got.bounds), len(models))
        found = [[x[2] for x in f] for m in models for f in _scanned(got, m)]
        y = pa.concat_arrays([batch.column("y")] * len(models))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(models)), batch.num_rows), pa.int32()), y, pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["m", "y", "n", "s"])

    rows = over_texts(train.where("fold = 4").select("y", "text"), seen, "m int, y int, n long, s array<double>").toArrow()
    tried = [_calibrated(m, rows.filter(pa.compute.equal(rows.column("m"), i))) for i, m in enumerate(models)]
    return max(tried, key=lambda x: x[0])[1]  # the first of equals


def _model(kept: pa.Table, all_t: float, all_o: float, drift: float) -> Model:
    """Tokens, scores, default and lambda of rows (h, s, ft, fo), some of a positive s."""
    h = kept.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, s, ft, fo = h[order], *(kept.column(c).to_numpy().astype(float)[order] for c in ("s", "ft", "fo"))
    up = s > 0
    default = min(math.log((1 - ft[up].sum() / all_t) / (1 - fo[up].sum() / all_o)), -drift)
    own = (fo + 0.5) / (all_o + 0.5 * len(fo))  # half an occurrence for tokens that no clean text has
    p = np.append(own, max(0.0, 1 - own.sum()))
    # The extreme-value law needs a negative mean score over clean texts; what the listed tokens add is taken from the others.
    default = min(default, -(drift + max(0.0, float((own * s).sum()))) / max(0.1, 1 - own.sum()))
    return NONE._replace(tokens=h, scores=s, default=default, lam=root(np.append(s, default), p))


def _calibrated(m: Model, rows: pa.Table) -> tuple[float, Model]:
    """The best F1 over rows(y, n, s), s the segments' scores, and the model with the K and alpha that give it."""
    y, n = (rows.column(c).to_numpy() for c in ("y", "n"))
    every = rows.column("s").combine_chunks()
    lengths = np.array(pa.compute.list_value_length(every))
    flat = np.array(every.flatten(), float)
    of = np.repeat(np.arange(len(y)), lengths)
    scores = np.sort(m.lam * flat[y[of] == 0])[::-1]
    floor = float(scores[len(scores) // 2]) if len(scores) else 3.0
    m = m._replace(k=max(0.5, int((scores >= floor).sum())) / max(1.0, float(n[y == 0].sum())) * math.exp(floor))
    top = np.zeros(len(y))
    np.maximum.at(top, of, flat)
    ps = sorted((p_value(int(a), float(b), m), int(c)) for a, b, c in zip(n, top, y, strict=True))
    pos = sum(c for _, c in ps)
    best, alpha, hit = -1.0, 0.01, 0
    for i, (p0, c) in enumerate(ps):
        hit += c
        if p0 < 1 and (i + 1 == len(ps) or ps[i + 1][0] > p0):
            f1 = 2 * hit / (i + 1 + pos) if pos else 0.0
            if f1 > best:
                after = ps[i + 1][0] if i + 1 < len(ps) else 1.0
                best, alpha = f1, math.sqrt(max(p0, 1e-300) * max(after, 1e-300))
    return best, m._replace(alpha=min(max(alpha, 1e-12), 0.5), cut=min(max(alpha, 1e-12), 0.5))


def score(n: int, found: list[tuple[int, int, float]], m: Model) -> float:
    if not m.alpha:
        return 0.0
    p = p_value(n, max((x[2] for x in found), default=0.0), m)
    return m.alpha / (m.alpha + p)


def scored(docs: DataFrame, m: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, score, predicted, n_tokens and the significant passages as token spans, best first."""
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found = scan(batch.column("text"), m)
        s = [score(int(a), b, m) for a, b in zip(n, found, strict=True)]
        spans: list[list[dict[str, Any]]] = [[{"start": x, "end": y, "score": z} for x, y, z in sorted(b, key=lambda q: (-q[2], q[0])) if p_value(int(a), z, m) <= m.cut] for a, b in zip(n, found, strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(n, pa.int64()), pa.array(spans, kind)], ["id", "score", "predicted", "n_tokens", "passages"])

    schema = f"id {base.schema['id'].dataType.simpleString()}, score double, predicted int, n_tokens long, passages array<struct<start:int,end:int,score:double>>"
    return over_texts(base, f, schema).withColumnRenamed("id", doc_id)


def clean(docs: DataFrame, m: Model, *, text: str = "text") -> DataFrame:
    """The rows of docs that score under 0.5, with all their columns."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found = scan(batch.column(text), m)
        return batch.filter(pa.array([score(int(a), b, m) < 0.5 for a, b in zip(n, found, strict=True)], pa.bool_()))

    return over_texts(docs, f, docs.schema, text)
