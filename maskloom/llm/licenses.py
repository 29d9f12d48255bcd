"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Words are runs of ASCII letters and digits, in lower case; a shingle is ``k`` words. Templates of about equal length share a
class of windows: windows of w shingles, one every s, such that each run of as many shingles as the longest template of the
class has lies whole in one window. A window's signature has one MinHash for each of ``bands`` hash functions, each a band of
its own. A template of n shingles of which a share c is in the window has a Jaccard similarity of at least
c n / (w + (1 - c) n), so a copy with c >= 0.8 is missed with probability (1 - that) ** bands at most; ``plan`` takes as many
bands as keep this under ``miss``. A retrieved window is verified by the share of the template's shingles that it holds.

All steps are DataFrame functions. Windows never leave their row's task; only the verified ones are shuffled, to sum them
up by document and template. Templates are a stated list; their band table is broadcast if it has ``most_bands`` rows at
most, and joined otherwise. Null, empty and short texts have no window and no row; repeated rows are counted together.
"""

from __future__ import annotations

import functools
import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: short license notices, by identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)

WORD = r"[a-z0-9]+"


class Windows(NamedTuple):
    size: int  # shingles of a window
    step: int
    bands: int
    templates: list[tuple[str, list[str]]]  # name, words


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def plan(templates, k: int = 5, share: float = 0.8, miss: float = 1e-2, ratio: float = 2.5) -> list[Windows]:
    """Classes of templates whose numbers of shingles lie within ``ratio``, with their windows and bands."""
    sized = sorted((max(1, len(w := words_of(text)) - k + 1), name, w) for name, text in templates if words_of(text))
    classes: list[list] = []
    for x in sized:
        if classes and x[0] <= ratio * classes[-1][0][0]:
            classes[-1].append(x)
        else:
            classes.append([x])
    out = []
    for c in classes:
        least, most = c[0][0], c[-1][0]
        step = max(1, least)
        size = most + step - 1
        need = math.ceil(share * least)
        j = need / (size + least - need)
        bands = math.ceil(math.log(miss) / math.log(1 - j)) if j < 1 else 1
        out.append(Windows(size, step, bands, [(name, w) for _, name, w in c]))
    return out


def hashes(words: Column, k: int) -> Column:
    """The hashes of all shingles in turn; of fewer than k words that of all of them, of none nothing."""
    n = F.size(words)
    short = F.when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(short)


def signature(h: Column, band: Column, size: int) -> Column:
    """The MinHash of a window of ``size`` shingles under the band's hash function."""
    each = [F.xxhash64(F.get(h, F.lit(i)), band) for i in range(size)]
    return F.least(*each) if size > 1 else each[0]


def windows(h: Column, filled: Column, w: Windows, kind: int) -> Column:
    """struct(kind, first, h) of each window over the shingles h, of which filled is h with more of its last."""
    n = F.size(h)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - w.size + w.step, F.lit(1)), F.lit(w.step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("first"), F.array(*(F.get(filled, s + (i - 1)) for i in range(w.size))).alias("h")))


def retrieved(base: DataFrame, classes: list[Windows], table: DataFrame, small: bool) -> DataFrame:
    """(id, first, h, license_id, t): windows of base(id, h) that share a band with a template of their class.

    A text's last window is filled up with its last shingle, which changes no minimum and no overlap. The classes are cut
    from one pass over the shingles. A row computes one band: the code of more would be too large a method to be compiled.
    For the same reason classes of large windows are given one at a time.
    """
    most = max(w.size for w in classes)
    filled = base.select("id", "h", F.concat("h", F.array_repeat(F.get("h", F.size("h") - 1), most - 1)).alias("f"))
    every = F.concat(*(windows(F.col("h"), F.col("f"), w, i) for i, w in enumerate(classes)))
    x = filled.select("id", F.explode(every).alias("w")).select("id", "w.kind", "w.first", "w.h")
    x = x.withColumn("band", F.explode(F.get(F.lit([list(range(w.bands)) for w in classes]), F.col("kind"))))
    sig = signature(F.col("h"), F.col("band"), classes[-1].size)
    for i, w in reversed(list(enumerate(classes[:-1]))):
        sig = F.when(F.col("kind") == i, signature(F.col("h"), F.col("band"), w.size)).otherwise(sig)
    return x.withColumn("sig", sig).join(F.broadcast(table) if small else table, ["kind", "band", "sig"]).select("id", "first", "h", "license_id", "t", "kind")


def found(docs: DataFrame, templates=TEMPLATES, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, share: float = 0.8, miss: float = 1e-2, most_bands: int = 100_000) -> DataFrame:
    """One row per document and license: id, license_id, containment (the best of a window), first_word (of the first such window), windows (that hold it)."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    base = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), words.alias("words")).select("id", hashes(F.col("words"), k).alias("h"))
    classes = plan(templates, k, share, miss)
    if not classes:
        return spark.createDataFrame([], f"{doc_id} {base.schema['id'].dataType.simpleString()}, license_id string, containment double, first_word long, windows long")
    small = sum(len(w.templates) * w.bands for w in classes) <= most_bands
    narrow = [w for w in classes if w.size <= 8]
    passes = ([narrow] if narrow else []) + [[w] for w in classes if w.size > 8]
    x = functools.reduce(DataFrame.unionByName, (retrieved(base, p, bands_of(spark, p, k), small) for p in passes))
    x = x.select("id", "first", "license_id", (F.size(F.array_intersect("h", "t")) / F.size("t")).alias("containment")).where(F.col("containment") >= share)
    each = x.groupBy("id", "license_id", "first").agg(F.max("containment").alias("containment"))
    best = each.groupBy("id", "license_id").agg(F.max("containment").alias("containment"), (F.min("first") - 1).cast("long").alias("first_word"), F.count("*").alias("windows"))
    return best.withColumnRenamed("id", doc_id)


def bands_of(spark: SparkSession, classes: list[Windows], k: int) -> DataFrame:
    """(kind, band, sig, license_id, t) of the templates, t their shingle hashes."""
    rows = spark.createDataFrame([(i, w.bands, name, words) for i, w in enumerate(classes) for name, words in w.templates], "kind int, bands int, license_id string, ws array<string>")
    t = rows.select("kind", "bands", "license_id", F.array_distinct(hashes(F.col("ws"), k)).alias("t"))
    t = t.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    return t.withColumn("sig", F.array_min(F.transform("t", lambda x: F.xxhash64(x, F.col("band"))))).select("kind", "band", "sig", "license_id", "t")


def sql(templates=TEMPLATES, k: int = 5, share: float = 0.8) -> str:
    """DuckDB SQL for the query's rows: every window of every class against every template."""
    parts = []
    for w in plan(templates, k, share):
        ts = ", ".join(f"('{name}', {[' '.join(x[i : i + k]) for i in range(max(1, len(x) - k + 1))]})" for name, x in w.templates)
        parts.append(f"""
SELECT doc_id, license_id, first, len(list_intersect(h, t)) / CAST(len(list_distinct(t)) AS DOUBLE) AS c
FROM (SELECT doc_id, first, list_distinct(h[first : first + {w.size - 1}]) AS h FROM (SELECT doc_id, h, unnest(range(1, greatest(len(h) - {w.size} + {w.step}, 1) + 1, {w.step})) AS first FROM d WHERE len(h) > 0)) AS x,
  (VALUES {ts}) AS t(license_id, t)
WHERE list_has_any(h, t)""")
    every = sorted({" ".join(x[i : i + k]) for _, t in templates for x in [words_of(t)] for i in range(max(1, len(x) - k + 1))})
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS h FROM a),
d AS (SELECT * FROM b WHERE list_has_any(h, {every})),
m AS (SELECT doc_id, license_id, first, max(c) AS c FROM ({" UNION ALL ".join(parts)}) WHERE c >= {share} GROUP BY doc_id, license_id, first)
SELECT doc_id, license_id, max(c) AS containment, min(first) - 1 AS first_word, count(*) AS windows FROM m GROUP BY doc_id, license_id
"""
