"""The ten operators on small tables, against plain versions; nulls, empties, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import subprocess
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskloom.llm import bagminhash, chat, decontaminate, flac, langid, licenses, media, mixing, revisits, toxicity, urls
from maskloom.llm.words import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, score double")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGES = [None, "", " \n", "!!!", "É", "x" * 300_000, "a b c d", "the " * 3000]


# --- words ------------------------------------------------------------------------------------------------------------


def test_words_match_the_pattern():
    rng = random.Random(1)
    texts = [*EDGES, "Ab1É_日本-x\x7fq", *("".join(rng.choice("aZ9 é日.\n") for _ in range(rng.randrange(60))) for _ in range(300))]
    got = words(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        own = split(t)
        h = got.hashes[got.bounds[i] : got.bounds[i + 1]].tolist()
        assert len(own) == len(h)
        for w, x in zip(own, h, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- op1 --------------------------------------------------------------------------------------------------------------


def test_flac_round_trip_and_checks():
    rng = np.random.default_rng(0)
    wave = (100 * np.sin(np.arange(5000) / 9)).astype(np.int8).tobytes()
    payloads = [bytes(64), bytes(range(256)), rng.integers(0, 256, 2048).astype(np.uint8).tobytes(), b"\x80\x7f" * 800, wave, b"the quick brown fox " * 500, b"\x05" * 4096]
    made = flac.streams(payloads)
    assert [x.tobytes() for x in flac.samples(made)] == payloads
    assert [flac.streams([p])[0] for p in payloads] == made  # the same alone as among others
    assert len(made[4]) < 0.7 * len(wave)
    assert flac.seek(made[4], 1500, 1700).astype(np.int8).tobytes() == wave[1500:3200]
    info = flac.opened(made[4])
    assert (flac._plain(made[4][info.first : info.first + int(info.points["offset"][1])], 8).astype(np.int8).tobytes()) == wave[: flac.BLOCK]
    for at in (-3, -400):
        bad = bytearray(made[4])
        bad[at] ^= 8
        with pytest.raises(flac.CorruptFrame):
            flac.samples([bytes(bad)])


def _bits(*fields):
    s = "".join(format(v & ((1 << w) - 1), f"0{w}b") for v, w in fields)
    return s + "0" * (-len(s) % 8)


def test_flac_reads_what_the_writer_does_not_make():
    """Partitions, escapes, wasted bits, constants and a fixed predictor of order 2."""

    def frame(size, body):
        head = flac._header(0, size)
        raw = head + int(body, 2).to_bytes(len(body) // 8, "big")
        state = 0
        for b in raw:
            state ^= b << 8
            for _ in range(8):
                state = (state << 1 ^ 0x8005 if state & 0x8000 else state << 1) & 0xFFFF
        return raw + state.to_bytes(2, "big")

    constant = frame(16, _bits((0, 8), (-5, 8)))
    # order 2, two partitions: k = 1 with six residuals of 0, then escaped with 3 raw bits
    order2 = frame(16, _bits((0b0_001010_0, 8), (10, 8), (12, 8), (0, 2), (1, 4), (1, 4), *[(0b10, 2)] * 6, (15, 4), (3, 5), *[(-1, 3)] * 8))
    plain = frame(16, _bits((0b0_001010_0, 8), (10, 8), (12, 8), (0, 2), (1, 4), (1, 4), *[(0b10, 2)] * 6, (0, 4), *[(1, 1)] * 8))
    wasted = frame(16, _bits((0b0_000001_1, 8), (1, 2), *[(i - 8, 6) for i in range(16)]))
    got = flac.decoded([constant, order2, plain, wasted])
    assert got[0].tolist() == [-5] * 16
    assert got[2].tolist() == [10 + 2 * i for i in range(16)]
    x = [10, 12]
    for i in range(14):
        x.append(2 * x[-1] - x[-2] - (1 if i >= 6 else 0))
    assert got[1].tolist() == x
    assert got[3].tolist() == [4 * (i - 8) for i in range(16)]


def test_media_columns(spark):
    texts = [*EDGES, "abc", "abc"]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in media.digests(d).collect()}
    for i, t in enumerate(texts):
        p = media.payload(t)
        assert len(p) % 64 == 0 and p.startswith((t or "").encode()) and not p[len((t or "").encode()) :].strip(b"\0")
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(p), hashlib.sha256(p).hexdigest())
    assert tuple(got[len(texts) - 1])[1:] == tuple(got[len(texts) - 2])[1:]
    blocks = media.pcm_blocks(media.stored(d.where("doc_id < 6"))).orderBy("doc_id", "block").collect()
    for i in range(6):
        own = [r for r in blocks if r["doc_id"] == i]
        assert b"".join(bytes(r["pcm"]) for r in own) == media.payload(texts[i])
        assert [r["first_sample"] for r in own] == [flac.BLOCK * k for k in range(len(own))]
    assert media.digests(d.limit(0)).count() == 0


def feature_plainly(pcm):
    x = [b - 256 if b > 127 else b for b in pcm]
    rms = (sum(v * v for v in x) / len(x)) ** 0.5
    return f"peak={max(map(abs, x))};rms={rms:.3f};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))};step={sum(abs(b - a) for a, b in zip(x, x[1:], strict=False)) / max(1, len(x) - 1):.3f}"


def test_media_digests_against_plain_ones(spark):
    rng = random.Random(19)
    texts = [None, "", "é" * 40, prose(rng, 500), "x" * (3 << 20), prose(rng, 400_000)]
    stored = {r["doc_id"]: bytes(r["flac"]) for r in media.stored(docs(spark, texts)).collect()}
    for r in media.digests(docs(spark, texts)).collect():
        p = media.payload(texts[r["doc_id"]])
        assert r["tail_crc32"] == zlib.crc32(p[-64:]) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
        assert r["feature"] == feature_plainly(p)


def test_streams_of_other_makers_and_broken_ones(spark):
    whole = flac.streams([bytes(range(256)) * 20])[0]
    info = flac.opened(whole)
    bare = b"fLaC" + b"\x80" + whole[5:8] + whole[8:42] + whole[info.first :]  # no seek table
    broken = bytearray(whole)
    broken[-100] ^= 1
    stereo = bytearray(whole)
    stereo[8 + 12] |= 2
    rows = [(0, bytearray(whole)), (1, bytearray(bare)), (2, broken), (3, stereo), (4, bytearray(b"RIFF....")), (5, None), (6, bytearray(whole[:50])), (7, bytearray(b"fLaC"))]
    got = media.pcm_blocks(spark.createDataFrame(rows, "doc_id long, flac binary")).collect()
    pcm = lambda i: b"".join(bytes(r["pcm"]) for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["block"]))
    assert pcm(0) == pcm(1) == bytes(range(256)) * 20
    bad = {r["doc_id"]: r["error"] for r in got if r["error"] is not None}
    assert set(bad) == {2, 3, 4, 6, 7} and "mono" in bad[3] and not any(r["doc_id"] == 5 for r in got)


def test_a_long_text_takes_a_few_times_its_size():
    code = "import resource, sys; sys.path.insert(0, '.'); from maskloom.llm import flac, media; base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\np = media.payload('some words of a long text, ' * 400_000)\npcm = flac.samples(flac.streams([p]))[0]; media.feature(pcm); assert pcm.tobytes() == p\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024)"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout
    assert float(said) < 600, said  # 10.8 MB of text


# --- op2 --------------------------------------------------------------------------------------------------------------

CAPTURES = "record_id string, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string"


def test_canonical(spark):
    urls_ = ["http://WWW.A.org:80/x/?b=2&utm_source=f&a=1#t", "https://a.org/x?a=1&b=2", "no url", None, "http://"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls_], "u string").select(revisits.canonical(F.col("u"))).collect()]
    assert got == ["a.org/x?a=1&b=2", "a.org/x?a=1&b=2", None, None, None]


def test_revisits_against_a_scan(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        url = None if i % 97 == 0 else f"http://h.org/{rng.choice('aab')}"
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((f"r{i:03d}", url, None if i % 89 == 0 else rng.randrange(200), kind, rng.choice([None, '"1"', 'W/"1"', '"2"']), rng.choice([None, "m"]), None if i % 5 == 0 else {"ETag": "x", "Content-Length": str(i), "Date": str(i)}, f"d{i}"))
    rows += rows[:50]
    got = Counter((r["record_id"], r["status"], r["refers_to"], tuple(sorted(r["merged"].items())) if r["merged"] is not None else None) for r in revisits.resolved(spark.createDataFrame(rows, CAPTURES), bucket=17).collect())
    want = Counter()
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and None not in (x[1], x[2], r[1], r[2]) and x[1] == r[1] and x[2] < r[2]]
        if not before:
            want[r[0], "no_response", None, None] += 1
            continue
        x = max(before, key=lambda x: (x[2], x[0]))
        if r[4] and x[4]:
            status = "resolved" if r[4].removeprefix("W/") == x[4].removeprefix("W/") else "mismatch"
        elif not r[4] and r[5] and x[5]:
            status = "resolved" if r[5] == x[5] else "mismatch"
        else:
            status = "unchecked"
        merged = {k.lower(): v for k, v in (x[6] or {}).items()} | {k.lower(): v for k, v in (r[6] or {}).items() if k.lower() in revisits.PERMITTED}
        want[r[0], status, x[0], tuple(sorted(merged.items())) if status != "mismatch" else None] += 1
    assert got == want
    assert revisits.resolved(spark.createDataFrame([], CAPTURES)).count() == 0


def test_revisits_with_headers_that_differ_in_case(spark):
    rows = [("a", "http://h.org/x", 1, "response", "1", None, {"Set-Cookie": "b", "set-cookie": "a", "X": "1"}, "d"), ("b", "http://h.org/x", 2, "revisit", "1", None, {"Date": "2", "DATE": "1", "x": "no"}, None)]
    r = revisits.resolved(spark.createDataFrame(rows, CAPTURES)).first()
    assert (r["status"], r["merged"]) == ("resolved", {"set-cookie": "b, a", "x": "1", "date": "1, 2"})


# --- op3 --------------------------------------------------------------------------------------------------------------


def contaminated(texts, items, span=13):
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for i, x in items:
            x = split(x)
            n = min(span, len(x))
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(i)
        found, ids = {str(i) for i in found}, sorted(str(i) for i in found if i is not None)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [32 << 20, 3000])
def test_decontamination_against_all_windows(spark, block_bytes):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([3, 12, 13, 14, 30]))) for i in range(25)] + [(25, None), (26, ""), (27, "one"), (28, "the " * 20), (29, "w1 w2 w3"), (30, "w1 w2 w3"), (None, prose(rng, 20)), (None, "w7")]
    texts = [*EDGES[:-3], "a b c d", "the " * 60, "the " * 19 + "x " + "the " * 14]
    for i in range(60):
        a, x = prose(rng, 40).split(), split(rng.choice(items)[1])
        n = rng.randrange(len(x) + 1)
        texts.append(" ".join([*a[:20], *x[:n], *a[20:]]).upper())
    texts += texts[-3:]
    table = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts)
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(d, table, block_bytes=block_bytes).collect()}
    want = contaminated(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    kept = decontaminate.clean(d, table, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in enumerate(want) if not x[4]]
    assert decontaminate.contamination(d, table.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), table).count() == 0


def test_decontamination_of_repeated_words_is_linear(spark):
    """One word over and over on both sides: all places meet all places, in time linear in both."""
    table = spark.createDataFrame([(1, "the " * 200_000), (2, "the " * 12)], "item_id long, text string")
    d = docs(spark, ["the " * 300_000, "the " * 12, "a " * 100])
    began = time.perf_counter()
    assert [tuple(r)[1:4] for r in decontaminate.contamination(d, table).orderBy("doc_id").collect()] == [(300_000, 300_000, 2), (12, 12, 1), (100, 0, 0)]
    assert time.perf_counter() - began < 60


def test_decontamination_of_items_larger_than_a_block(spark):
    rng = random.Random(56)
    items = [(0, prose(rng, 3000, 50_000)), (1, prose(rng, 40))]
    w = split(items[0][1])
    texts = [" ".join([*prose(rng, 5).split(), *w[at : at + 13 + at % 3], *prose(rng, 5).split()]) for at in range(0, 2900, 37)] + [" ".join(w[100:112]), *EDGES[:4]]
    d, table = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(d, table, block_bytes=4000).collect()}
    assert [got[i] for i in range(len(texts))] == contaminated(texts, items)
    long = docs(spark, [" ".join([*prose(rng, 600).split(), *w[50:63]]), prose(rng, 600), None, "w1 w2"]).withColumn("key_of_it", F.lit(1)).withColumn("key", F.lit(2))
    table = spark.createDataFrame([*items, (2, "w1")], "item_id long, text string")
    for size in (4000, 32 << 20):  # a whole window in a long text: under the share, but not clean if whole ones count
        assert {r[0] for r in decontaminate.clean(long, table, block_bytes=size).collect()} == {0, 1, 2}
        assert {r[0] for r in decontaminate.clean(long, table, whole=True, block_bytes=size).collect()} == {1, 2}


def test_decontamination_of_an_item_cut_at_a_row_border(spark):
    rng = random.Random(55)
    items = [(0, prose(rng, 60)), (1, prose(rng, 40)), (2, "the " * 60)]
    texts = []
    for item, at in ((0, 30), (1, 20), (0, 13), (2, 25), (0, 47)):
        w = split(items[item][1])
        texts += [" ".join([*prose(rng, 9).split(), *w[:at]]), " ".join([*w[at:], *prose(rng, 7).split()])]
    d = docs(spark, texts).coalesce(1)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(texts, items)
    got = {r[0]: tuple(r)[1:] for r in decontaminate.contamination(d, table).collect()}
    assert [got[i] for i in range(len(texts))] == want and all(x[4] for x in want)
    assert decontaminate.clean(d, table).count() == 0


# --- op4 --------------------------------------------------------------------------------------------------------------


def nearest_plainly(text, rows, top=300):
    def grams(t):
        s = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t or "")
        if not s.strip():
            return Counter()
        s = re.sub(" +", " ", f" {s} ")
        return Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n] != " ")

    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    rank = lambda c: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], key(g)))[:top])}
    own = rank(grams(text))
    if not own:
        return "und"
    by = {}
    for t, lang in rows:
        by.setdefault(lang, Counter()).update(grams(t))
    distance = {x: sum(abs(p[g] - i) if g in p else top for g, i in own.items()) for x, c in by.items() for p in [rank(c)]}
    return min(sorted(distance), key=distance.get)


def test_language(spark):
    rng = random.Random(2)
    speak = {"xx": "abcde", "yy": "efghi", "zz": "äöüßk"}
    sample = lambda x, n: " ".join("".join(rng.choice(speak[x]) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(sample(x, 40), x) for x in speak for _ in range(12)]
    profiles = langid.learn(spark.createDataFrame([*rows, (None, "xx"), ("q", None), ("", "yy")], "text string, lang string"))
    texts = [sample(x, n) for x in speak for n in (1, 3, 30)] + ["E", *EDGES]
    for t in texts:
        assert langid.nearest(t, profiles)[0] == nearest_plainly(t, rows)
        assert 0 <= langid.nearest(t, profiles)[1] <= 1
    d = docs(spark, texts)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predicted(d, profiles).collect()}
    assert [got[i] for i in range(len(texts))] == [langid.nearest(t, profiles)[0] for t in texts]
    assert langid.known_language(d, profiles).where("text is null or text = ''").count() == 0
    nothing = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert langid.nearest("abc", nothing) == ("und", 0.0)


def test_language_counts_in_bounded_memory():
    rng = random.Random(3)
    texts = [("".join(rng.choice("abcdefghij ") for _ in range(1 << 18)), x) for x in "xyxyxyxyxyxyxyxy"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts)], ["text", "lang"])
    want = {x: np.unique(np.concatenate([langid.grams(langid.cleaned(t)) for t, y in texts if y == x]), return_counts=True) for x in "xy"}
    want = {(x, g): n for x, (k, c) in want.items() for g, n in zip(k.tolist(), c.tolist())}
    langid.letters()
    tracemalloc.start()
    got = [r for b in langid.counts(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 105e6 with 2 MB of text at once
    assert len(got) == len(want) and {(r["lang"], r["g"]): r["n"] for r in got} == want  # each once, though counted in many runs
    parts = Counter()
    for b in langid.counts(iter([batch]), most=100):
        for r in b.to_pylist():
            parts[r["lang"], r["g"]] += r["n"]
    assert parts == want


# --- op5 --------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    m = urls.fit_rows(urls.LABELLED)
    cases = ["http://x.net/a", "HTTP://Example.NET/en/1?q", "http://sub.example.com/de/1", "https://a.org/fr/#x", "http://net", "http://notexample.com/de/", None, "", "no", "a://b://c/d", "http://casino-win.test/x", "http://h?x/y"]
    d = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, host int")
    want = []
    for u in cases:
        host, path = urls.host_path(u)
        fit = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        b = urls.buckets(host, path)
        z = sum(m.weights[i] + m.bias for i in b)
        want.append((host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if z > 0 else "allow"))
    for few in (1000, 0):
        got = {r[0]: tuple(r)[1:] for r in urls.judged(d, m, few_rules=few).collect()}
        assert [got[i] for i in range(len(cases))] == want
    plan = urls.judged(d, m)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        urls.fit(spark.range(5).select(F.lit("u").alias("url"), F.lit(1).alias("label")), most_labelled=4)
    assert urls.fit_rows([("http://a/", 1)]).bias < 0


def test_urls_not_learned():
    """Five folds by the URL's hash: what is judged is never learned from."""
    fold = lambda u: zlib.crc32(u.encode()) % 5
    assert len({u for u, _ in urls.LABELLED}) == len(urls.LABELLED)
    hit = Counter()
    for k in range(5):
        m = urls.fit_rows([r for r in urls.LABELLED if fold(r[0]) != k])
        for u, y in urls.LABELLED:
            if fold(u) == k:
                b = urls.buckets(*urls.host_path(u))
                hit[y, sum(m.weights[i] + m.bias for i in b) > 0] += 1
    caught, missed, false = hit[1, True], hit[1, False], hit[0, True]
    assert caught >= 0.8 * (caught + missed) and caught >= 0.85 * (caught + false)


# --- op6 --------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(4)
    notes = [t for _, t in licenses.TEMPLATES]
    texts = [*EDGES]
    for i in range(80):
        a = prose(rng, 40).split()
        note = notes[i % len(notes)]
        texts.append(" ".join([*a[: i % 30], note.upper() if i % 2 else note, *a[i % 30 :]]) if i % 4 else " ".join(a))
    d = docs(spark, texts)
    got = {(r["doc_id"], r["license_id"]) for r in licenses.found(d).where("containment = 1").collect()}
    text_words = {i: " ".join(licenses.words_of(t or "")) for i, t in enumerate(texts)}
    assert got == {(i, name) for i, t in text_words.items() for name, x in licenses.TEMPLATES if f" {' '.join(licenses.words_of(x))} " in f" {t} "}
    assert licenses.found(d.limit(0)).count() == 0 and licenses.found(d, ()).count() == 0
    for w in licenses.plan(licenses.TEMPLATES):
        for _, x in w.templates:
            assert len(x) - 4 + w.step - 1 <= w.size


def test_partial_copies_of_licenses(spark):
    """Copies with words changed at an end or inside, against every window of every class; of those that count few are missed."""
    rng = random.Random(14)
    texts = [*EDGES]
    for i in range(700):
        a, note = prose(rng, 60).split(), licenses.words_of(licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1])
        note[rng.choice([0, 1, len(note) // 2, -2, -1])] = "changed"
        texts.append(" ".join([*a[: i % 50], *note, *a[i % 50 :]]))
    want = {}
    for i, t in enumerate(texts):
        x = licenses.words_of(t or "")
        h = [" ".join(x[j : j + 5]) for j in range(len(x) - 4)] or [" ".join(x)] * bool(x)
        for w in licenses.plan(licenses.TEMPLATES):
            for name, words in w.templates:
                t = {" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
                best = max((len(t & set(h[j : j + w.size])) / len(t) for j in range(0, max(len(h) - w.size + w.step, 1), w.step)), default=0)
                if best >= 0.8:
                    want[i, name] = best
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in licenses.found(docs(spark, texts)).collect()}
    assert set(got) <= set(want) and all(abs(c - want[k]) < 1e-9 for k, c in got.items() if k in want)
    assert 0 < min(want.values()) < 1 and len(want) > 100 and len(got) >= 0.97 * len(want)


# --- op7 --------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i if i % 50 else None, prose(rng, rng.randrange(1, 60)) if i % 13 else None, rng.choice(["b", "a", "ä", None, "B", "a", "a"])) for i in range(900)]
    rows += [(7, "same words here", "a")] * 40 + [(8, "", "empty")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(d, block=50).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(mixing.WORDS, t or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s in size if s is not None)) + [None])}
    target, total = {}, 1.5 * sum(size.values())
    while True:
        level = (total - sum(target.values())) / sum(w for s, w in weight.items() if s not in target)
        over = [s for s in weight if s not in target and level * weight[s] > 2 * size[s]]
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
    target = {s: target.get(s, level * weight[s]) for s in weight}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and abs(r["target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 5 for s in size)
    again = mixing.mixed(d.repartition(5), block=50).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mixed(d.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = random.Random(1)
    p, z = [rng.random() for _ in range(200)], [float(rng.randrange(50)) for _ in range(200)]
    before = sum(p), sum(a * b for a, b in zip(p, z, strict=True))
    left = mixing.flight(p, z, random.Random(0))
    assert len(left) <= 2 and sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - before[0]) < 1e-6 and abs(sum(a * b for a, b in zip(p, z, strict=True)) - before[1]) < 1e-5


# --- op8 --------------------------------------------------------------------------------------------------------------


def test_maximal_segments():
    """Ruzzo and Tompa's own definition: the best segment first, then the rest on either side of it."""

    def plainly(s, lo, hi):
        best = max(((sum(s[a:b]), -(b - a), -a, (a, b)) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = best[3]
        return [*plainly(s, lo, a), (a, b), *plainly(s, b, hi)]

    rng = random.Random(9)
    for _ in range(200):
        s = [rng.choice([-1, -1, -1, 2, 3, -2, 5]) for _ in range(rng.randrange(1, 25))]
        listed = [i for i, x in enumerate(s) if x != -1]
        got = toxicity.segments(listed, [float(s[i]) for i in listed], len(s), -1.0)
        assert [(a, b) for a, b, _ in got] == plainly(s, 0, len(s))
        assert all(abs(sum(s[a:b]) - x) < 1e-9 for a, b, x in got)


def test_toxicity_on_rows_not_learned(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randrange(10, 120), 3000).split()
        bad = i % 6 == 0
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["rotten", "vile", "filthy"]))
        rows.append((i, " ".join(w)))
        labels.append((i if i % 71 else None, int(bad) if i % 67 else None))
    rows += [(900 + i, t) for i, t in enumerate(EDGES)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(d, spark.createDataFrame([*labels, (3, 7)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.scored(d, m).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [got[i]["predicted"] == int(i % 6 == 0) for i in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(got[900 + i]["predicted"] == 0 for i in range(5))
    assert {r["doc_id"] for r in toxicity.clean(d, m).collect()} == {i for i, r in got.items() if not r["predicted"]}
    nothing = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(d, nothing).where("score > 0").count() == 0


def test_toxicity_model_against_plain_counts(spark):
    """Tokens, scores and lambda of the model, from counts made plainly; and the law that turns segments into p."""
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, rng.randrange(5, 60), 300).split()
        if i % 5 == 0:
            w += rng.choices(["rotten", "rottenness", "vile"], k=2)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    rows.append((400, rows[5][1]))  # a copy counts once
    labels.append((400, 1))
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    seen, number = {}, {0: 0, 1: 0}
    for (_, text), (_, y) in [(r, y) for r, y in {(r[1], y[1]): (r, y) for r, y in zip(rows, labels, strict=True) if fold(r[0]) in (1, 2, 3)}.values()]:
        number[y] += 1
        every = [(n, w) for w in split(text) for n in (0, *toxicity.PARTS) if not n or len(w) > n for w in [w[:n] if n else w]]
        for e in set(every):
            c = seen.setdefault(e, [0, 0, 0, 0])
            c[1 - y] += 1
        for e in every:
            seen[e][3 - y] += 1
    nt, no = number[1], number[0]
    scored = {}
    for e, (t, o, _, fo) in seen.items():
        if t + o < 2:
            continue
        a = 10.0 * (t + o) / (nt + no)
        s = math.log((t + a) / (nt + 10 - t - a + 0.5)) - math.log((o + a) / (no + 10 - o - a + 0.5))
        part = lambda c, n: c * math.log(c * (nt + no) / ((t + o) * n)) if c else 0.0  # noqa: B023, E731
        scored[e] = (s, math.sqrt(max(0.0, 2 * (part(t, nt) + part(o, no)))), fo)
    models = [{e for e, (s, z, _) in scored.items() if z >= cut and abs(s) >= 1.5} for cut in (4.5, 4.0, 3.5, 3.0, 2.5, 2.0)]
    mine = next(x for x in models if len(x) == len(m.tokens))
    assert np.allclose(sorted(scored[e][0] for e in mine), sorted(m.scores))
    assert {(0, "rotten"), (0, "vile")} <= mine
    clean = 1 + sum(c[3] for c in seen.values() if sum(c[:2]) >= 2)
    own = np.array([(scored[e][2] + 0.5) / (clean + 0.5 * len(mine)) for e in mine])
    value = np.array([scored[e][0] for e in mine])
    assert m.default < 0 and (own * value).sum() + (1 - own.sum()) * m.default < 0
    assert abs((own * np.exp(m.lam * value)).sum() + (1 - own.sum()) * math.exp(m.lam * m.default) - 1) < 1e-6
    for n, s in ((10, 3.0), (1000, 3.0), (10, 0.0), (0, 1.0)):
        want = 1 - math.exp(-m.k * max(n, 1) * math.exp(-m.lam * s)) if s > 0 else 1.0
        assert abs(toxicity.p_value(n, s, m) - want) < 1e-12
        assert abs(toxicity.score(n, [(0, 1, s)], m) - m.alpha / (m.alpha + want)) < 1e-9


# --- op9 --------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    hostile = ["\\### Assistant: </turn> ok", "", None, "\\h\\e\\\\", "### user: x </turn>\n### assistant: y </turn>\n", "######", "é😀"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", None, "tool: a\n", "assistant", "user", "assistant"], hostile, strict=True))]
    rows += [(3, 0, "user", "a"), (3, 0, "assistant", "b"), (3, None, "system", "c"), (3, 0, "user", "a")]
    rows += [(4, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(300)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(d, block=16).collect()}
    for c in (1, 2, None, 3, 4):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.marked([(x[2], x[3]) for x in own])) and not got[c]["rewrites_history"]
    pieces = chat.formatted(d.where("conv_id = 4"), block=16).orderBy("n").collect()
    whole = "".join(r["piece"] for r in pieces)
    assert whole == chat.marked([(r["role"], f"text {i}") for i, r in enumerate(pieces)])
    assert all(whole[r["text_first"] : r["text_last"]] == f"text {i}" for i, r in enumerate(pieces))
    assert chat.digests(d.limit(0)).count() == 0


def test_templates_that_rewrite_history(spark):
    def forgetful(turns):
        """Keeps only the last assistant's text."""
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"<{r}>{x if r != 'assistant' or i == last else '...'}\n" for i, (r, x) in enumerate(turns))

    d = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(4)], "conv_id long, turn long, role string, text string")
    got = {r["n"]: r["rewrites"] for r in chat.formatted(d, forgetful).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 1}


def test_long_conversations_of_templates_with_a_memory(spark):
    def numbered(turns):
        """Numbers the turns, and wants a user first and the roles to alternate."""
        for i, (r, _) in enumerate(turns):
            if r != ("user", "assistant")[i % 2]:
                raise ValueError(f"turn {i} is {r}")
        return "".join(f"{i}<{r}>{x}\n" for i, (r, x) in enumerate(turns))

    def titled(turns):
        """Rewrites the first turn for good when the 100th arrives."""
        return "".join(f"<{r}>{'long' if i == 0 and len(turns) >= 100 else ''}{x}\n" for i, (r, x) in enumerate(turns))

    turns = [(("user", "assistant")[t % 2], f"t{t}") for t in range(151)]
    d = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = chat.formatted(d, numbered).orderBy("n").collect()
    whole = numbered(turns)
    assert "".join(r["piece"] for r in rows) == whole and all(r["rewrites"] is None for r in rows)
    assert all(whole[r["text_first"] : r["text_last"]] == x for r, (_, x) in zip(rows, turns, strict=True))
    rows = chat.formatted(d, titled).orderBy("n").collect()
    assert [(r["n"], r["rewrites"]) for r in rows if r["rewrites"] is not None] == [(99, 0)]
    text = ""
    for i, r in enumerate(rows):
        text = text[: r["start"]] + r["piece"]
        assert text == titled(turns[: i + 1])
    assert "".join(r["piece"] for r in chat.formatted(d, local=True, block=16).orderBy("n").collect()) == chat.marked(turns)


# --- op10 -------------------------------------------------------------------------------------------------------------


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for trial in range(20):
        a = Counter(rng.integers(0, 60, 200).tolist())
        b = Counter(a)
        b.update(rng.integers(0, 60, 80).tolist())
        b.subtract(rng.integers(0, 60, 50).tolist())
        b = +b
        bag = lambda c: np.sort(np.array([int(bagminhash.mix(np.array([k + 1 + 1000 * trial], np.uint64))[0]) for k, n in c.items() for _ in range(n)], np.uint64))
        x, y = bag(a), bag(b)
        s = bagminhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 2048)
        errors.append((s[0] == s[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.006


def classes_plainly(texts, k=5, t=0.8):
    bags = []
    for x in texts:
        w = split(x)
        bags.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)]) if w else None)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= t * sum((bags[i] | bags[j]).values()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    texts = [*EDGES, "", "a b c d", "A b, c d!"]
    base = prose(rng, 150, 5000).split()
    for i in range(120):  # one family whose members lie around the bound
        w = list(base)
        for _ in range(i % 8):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    for _ in range(30):
        texts.append(prose(rng, 60, 5000))
    texts += [texts[-1], texts[-2], "ab " * 200, "ab " * 210]
    d = docs(spark, texts).withColumn("id_of_it", F.lit(1)).withColumn("Hash_of_it", F.lit(2)).withColumn("class_id", F.lit(3)).withColumn("node", F.lit(4))
    found = bagminhash.classes(d)
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == classes_plainly(texts)
    kept = bagminhash.one_of_each(d, found)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    odd = spark.createDataFrame([(None, "x y z x y z"), (1, "x y z x y z"), (1, "x y z x y z"), (2, "x y z x y z"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, ((r[0], r[1]) for r in bagminhash.classes(odd).collect()))) == sorted(map(str, [(None, None), (1, 1), (1, 1), (2, 1), (None, None)]))
    assert Counter(r["doc_id"] for r in bagminhash.one_of_each(odd, bagminhash.classes(odd)).collect()) == Counter([None, None, 1])
    assert bagminhash.classes(d.limit(0)).count() == 0


def components_plainly(texts, k=5, t=0.8):
    """classes_plainly for many texts: overlaps counted by posting lists."""
    bags = [Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in map(split, texts)]
    levels = [{(g, n) for g, c in b.items() for n in range(c)} for b in bags]
    number = {e: i for i, e in enumerate(sorted(set().union(*levels)))}
    held = [np.fromiter(sorted(number[e] for e in x), np.int64) for x in levels]
    member = np.zeros((len(texts), len(number)), np.float32)
    for i, x in enumerate(held):
        member[i, x] = 1
    size = member.sum(axis=1)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        both = member[:i] @ member[i]
        for j in np.flatnonzero(both >= t * (size[:i] + size[i] - both) - 1e-6).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_in_a_large_family_around_the_bound(spark):
    """Copies that are edited by few words, so that edits repeat: replaced, left out, put in and cut short."""
    rng = random.Random(13)
    base = prose(rng, 80, 5000).split()
    texts = []
    for i in range(2000):
        w = list(base)
        for _ in range(i % 4):
            at, how = rng.randrange(len(w)), rng.randrange(5)
            w[at : at + (how != 1)] = [] if how == 0 else [f"new{rng.randrange(5)}"]
        texts.append(" ".join(w[: len(w) - (rng.randrange(25) if i % 10 == 9 else 0)]))
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs(spark, texts)).collect()}
    want = components_plainly(texts)
    assert 100 < len(set(want)) < 1900
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(12)
    a, b, c, e = (prose(rng, 60, 5000) for _ in range(4))
    near = f"{a} end"  # of a
    rows = [(0, a, "x"), (1, near, "x"), (1, b, "x"), (1, c, "x"), (1, c, "w"), (2, c, "x"), (3, e, "x"), (3, f"{e} end", "x"), (4, None, "x"), (4, "", "x"), (None, a, "x")]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string, source string")
        kept = Counter(tuple(r) for r in bagminhash.one_of_each(d, bagminhash.classes(d)).collect())
        thirds = [r for r in kept if r[0] == 3]
        assert len(thirds) == 1 and thirds[0] in rows
        assert kept == Counter([(0, a, "x"), (1, b, "x"), (1, c, "w"), *thirds, (4, None, "x"), (4, "", "x"), (None, a, "x")])
