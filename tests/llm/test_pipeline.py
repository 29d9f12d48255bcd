"""The stages against plain versions, on the smallest folder, and the entry without this subpackage."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import classes_plainly, contaminated, split  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        kept, had = docs.collect(), before.collect()
        if name != "mixing":
            assert docs.columns == before.columns
            ids = {r["doc_id"] for r in kept}
            assert len(ids) == len(kept) and ids <= {r["doc_id"] for r in had}
        rows[name] = (had, kept)
    had, kept = rows["language"]
    assert {r["doc_id"] for r in had} - {r["doc_id"] for r in kept} == {r["doc_id"] for r in had if not any(c.isalpha() for c in r["text"] or "")}
    had, kept = rows["toxicity"]
    gone = {r["doc_id"] for r in had} - {r["doc_id"] for r in kept}
    assert len(gone - toxic) <= 0.2 * len(had)
    had, kept = rows["near-duplicates"]
    had = sorted(had, key=lambda r: r["doc_id"])
    assert {r["doc_id"] for r in kept} == {had[i]["doc_id"] for i in set(classes_plainly([r["text"] for r in had]))}
    had, kept = rows["decontamination"]
    whole = {tuple(x[j : j + 13]) for _, text in items for x in [split(text)] for j in range(len(x) - 12)}
    runs = [any(tuple(w[j : j + 13]) in whole for j in range(len(w) - 12)) for w in (split(r["text"]) for r in had)]
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r, x, run in zip(had, contaminated([r["text"] for r in had], items), runs, strict=True) if not x[4] and not run}
    had, kept = rows["mixing"]
    taken, target = Counter(), {}
    for r in kept:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["repeats"] in (1, 2) and r["taken"] == r["repeats"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 60 for s in target)


def test_known_toxic_documents_are_removed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.toxic(spark, docs, SF).collect()}
    known = {r["doc_id"] for r in docs.collect() if r["doc_id"] in labels}
    toxic = {i for i in known if labels[i] == 1}
    assert len(toxic - kept) >= len(toxic) / 2
    assert len(known - toxic - kept) <= 0.02 * len(known - toxic)


def test_entry_without_the_subpackage():
    repo = Path(corpus_pipeline.__file__).parent
    code = "import sys, importlib.util as u; f = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('maskloom.llm') or n == 'corpus_pipeline' else f(n, *a)\nimport __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True)
