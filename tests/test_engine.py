"""Sources, sinks, joins, the recognizer, the stream, and the registered queries against DuckDB."""

import hashlib
import io
import math
import time
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskloom.functions import rules
from maskloom.functions import spans as sp
from maskloom.operators import aliases, codes, linking, recognizer
from maskloom.options import Options
from maskloom.plans import catalog, masking
from maskloom.sources import files, ooxml, sinks
from maskloom.streaming import masking as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert ours == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)


def test_queries_of_whole_tables(spark):
    run = lambda name: catalog.queries()[name](spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    found = {r["doc_id"]: (r["expected"], r["actual"]) for r in run("writeback_diff_whole").collect()}
    assert any(len(texts[i]) > 40 for i in found)
    assert all(e == digest(texts[i]) and a == (None if i % 97 == 0 else digest(texts[i] + "!")) for i, (e, a) in found.items())
    columns = {r["col"] for r in run("field_hint_join_whole").select("col").distinct().collect()}
    assert columns == {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_linenumber").distinct().collect()} and max(columns) > 4
    names = run("model_answers_whole").groupBy("doc_id").count().collect()
    assert max(r["count"] for r in names) > 1 and any(r["doc_id"] % 3 == 0 for r in names)



def test_entry(spark):
    assert entry.entry(spark).where("not restored_ok").count() == 0


def test_columns_are_no_limit_of_tasks(spark):
    """Headers come to the cells without a shuffle by column, and counts in pieces are those of the whole."""
    of = lambda most: catalog.field_hint_join_whole(spark, SF, most)
    pieces = of(1 << 10)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, of(1 << 30).collect()))


def test_cells_ask_for_their_spans_once(spark):
    """A text's candidates are found once, and a large table's cells are dealt out whatever its files' row groups."""
    plan = catalog.masked_cells_by_header(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    pattern = rules.EMAIL.pattern
    assert sum(x.count(pattern) for x in plan.splitlines() if "regexp_extract_all" in x) == 3  # whether any, hits, gaps


@pytest.mark.parametrize("name", ["masked_ids", "masked_amounts"])
def test_derived_texts_are_dealt_out(spark, monkeypatch, name):
    """A file of one row group isn't one task of masking."""
    whole = catalog.queries()[name](spark, SF)
    monkeypatch.setattr(catalog, "MOST", 64)
    pieces = catalog.queries()[name](spark, SF)
    assert pieces.rdd.getNumPartitions() > max(4, whole.rdd.getNumPartitions())
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, whole.collect()))


def test_many_amounts_of_one_text(spark):
    """Codes are made once a text, also where only the masked text is asked for; half a minute and more if once a span."""
    d = spark.createDataFrame([(1, "，".join(f"{1_000_000 + i * 7919}元" for i in range(2000)))], "doc_id int, text string")
    done = masking.masked(d, Options(mode="regex", amounts=True))
    began = time.perf_counter()
    alone = done.select("masked").first()["masked"]
    assert time.perf_counter() - began < 15
    row = masking.restored(done).select("masked", "text", "restored", F.size("mapping").alias("n")).first()
    assert row["masked"] == alone and row["restored"] == row["text"] and row["n"] == 2000


def test_few_spans_are_numbered_as_many_are(spark, monkeypatch):
    text = "北京宏图科技有限公司（以下简称“宏图”）与宏图、上海大地贸易有限公司、大地、宏图科技，电话13812345678和13912345678，邮箱a@b.cn，13812345678，[电话7]。"
    d = spark.createDataFrame([(i, text[:n]) for i, n in enumerate(range(0, len(text) + 1, 3))] + [(-1, None), (-2, "")], "doc_id int, text string")
    d = d.withColumn("owners", masking.org_surfaces(F.col("text")))
    d = d.withColumn("kept", sp.resolved(masking.spans_of(F.col("text"), Options(mode="regex"), None, F.col("owners")))).cache()
    of = lambda few, owners: (monkeypatch.setattr(masking, "FEW", few), d.select("doc_id", masking.numbered(F.col("kept"), masking.above(F.col("text")), owners).alias("n")).orderBy("doc_id").collect())[1]
    assert d.agg(F.max(F.size("kept"))).first()[0] > 6
    for owners in (None, F.col("owners")):
        assert of(0, owners) == of(6, owners) == of(100, owners)


def test_short_texts_and_whole_checks(spark):
    """Short texts are asked first whether they hold any fixed format; both ways find the same."""
    texts = ["a@b.cn", "+86 10 1234 5678", "11010519491231002X", "11010519491231002x\n", "91350100M000100Y43", "6222020200112230", "账号：123456", "13812345678", "010-12345678", "10.0.0.1", "00:1a:2b:3c:4d:5e",
             "京A12345", "身份证110105194912310021", "税号91350100M000100Y4Z", "123456", "4500000.00", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    long = d.withColumn("text", F.concat("text", F.lit("。" * 40)))
    of = lambda x: [[s.asDict() for s in r["s"]] for r in x.orderBy("doc_id").select(sp.resolved(masking.spans_of(F.col("text"), Options(mode="regex"))).alias("s")).collect()]
    assert of(d) == of(long) and sum(map(bool, of(d))) >= 12


def test_no_python_in_the_text_path(spark):
    plan = catalog.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def _docx(paragraphs):
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ooxml.W[1:-1]}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{ooxml.W[1:-1]}"><w:p><w:r><w:t>页眉</w:t></w:r></w:p></w:hdr>')
    return out.getvalue()


def _xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ooxml.S[1:-1]}"><si><t>账号</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ooxml.S[1:-1]}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>6.2E+18</v></c><c r="C1"/><c r="D1" t="str"><f>IF(A1&gt;1,"甲","乙")</f><v>甲</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_office_files(spark):
    d = spark.createDataFrame([(1, "docx", bytearray(_docx([["电话138", "00138000号"], [""]]))), (2, "xlsx", bytearray(_xlsx()))], "doc_id long, format string, content binary")
    b = ooxml.blocks(d)
    rows = {(r["doc_id"], r["block_id"]): r for r in b.collect()}
    assert [rows[1, i]["text"] for i in (0, 1)] == ["电话13800138000号", "页眉"] and list(rows[1, 0]["nodes"]) == [5, 9]
    cells = [(r["kind"], r["col"], r["text"]) for k, r in sorted(rows.items()) if k[0] == 2]
    assert cells == [("cell", 1, "账号"), ("cell", 28, "6200000000000000000"), ("cached", 4, "甲"), ("constant", 4, "甲"), ("constant", 4, "乙")]
    assert ooxml.cached_issues(b).count() == 1
    new = b.where("doc_id = 1 and block_id = 0").select(ooxml.spread(F.col("nodes"), F.lit(2), F.lit(13), F.lit("[电话1]"), F.col("text")).alias("n")).first()["n"]
    assert new == ["电话[电话1]", "号"]
    content, wrong = ooxml.rewritten("docx", _docx([["电话138", "00138000号"]]), {("word/document.xml", 0): ("电话13800138000号", new)})
    assert not wrong and ooxml.read(1, "docx", content)[0]["text"] == "电话[电话1]号"
    assert ooxml.rewritten("docx", content, {("word/document.xml", 0): ("else", new)})[1] == [("word/document.xml", 0)]


def test_office_files_are_written_again(spark):
    xlsx = _xlsx()
    rows = {(r["row"], r["col"], r["kind"]): r for r in ooxml.read(2, "xlsx", xlsx)}
    at, part = rows[1, 4, "cached"], rows[1, 4, "cached"]["part"]
    formula = ooxml.masked_formula(at["formula"], {"甲": "[公司1]"})
    assert formula == at["formula"].replace('"甲"', '"[公司1]"') and "乙" in formula
    edits = {(part, 1, 4): ("甲", "[公司1]", formula), (part, 1, 1): ("账号", "[词1]", None), (part, 9, 9): ("x", "y", None), (part, 1, 28): ("else", "y", None)}
    content, wrong, were = ooxml.rewritten_cells(xlsx, edits)
    got = {(r["row"], r["col"], r["kind"]): r["text"] for r in ooxml.read(2, "xlsx", content)}
    assert got[1, 4, "cached"] == "[公司1]" and got[1, 1, "cell"] == "[词1]" and got[1, 28, "cell"] == "6200000000000000000"
    assert sorted(wrong) == [(part, 1, 28), (part, 9, 9)] and set(were) == {(part, 1, 4), (part, 1, 1)}
    back, wrong = ooxml.restored_cells(content, were, {k: edits[k][1] for k in were})
    assert not wrong and ooxml.read(2, "xlsx", back) == ooxml.read(2, "xlsx", xlsx)
    assert ooxml.restored_cells(content, were, dict.fromkeys(were, "else"))[1]
    docx = _docx([["电话138", "00138000号"]])
    d = spark.createDataFrame([(1, "docx", bytearray(docx)), (2, "xlsx", bytearray(xlsx)), (3, "docx", bytearray(b"broken"))], "doc_id long, format string, content binary")
    e = spark.createDataFrame([(1, "word/document.xml", 0, None, "电话13800138000号", ["电话[电话1]", "号"], None), (2, part, 1, 1, "账号", ["[词1]"], None), (2, part, 7, 7, "x", ["y"], None)], "doc_id long, part string, row int, col int, expected string, nodes array<string>, formula string")
    done = {r["doc_id"]: r for r in ooxml.files_rewritten(d, e).collect()}
    assert ooxml.read(1, "docx", bytes(done[1]["content"]))[0]["text"] == "电话[电话1]号" and not done[1]["wrong"]
    assert done[2]["wrong"] == [f"{part}:7:7"] and done[3]["content"] is None and done[3]["wrong"]


def test_files_are_written_with_their_mappings(spark, tmp_path):
    d = spark.createDataFrame([(1, "/in/报告.txt", "x@y.org"), (2, "/in/b.md", "nothing"), (3, "/in/c.txt", None)], "doc_id long, path string, text string")
    out = str(tmp_path / "out")
    for turn, (options, backups) in enumerate(((Options(mode="regex"), 0), (Options(mode="regex"), 0))):
        rows = sinks.write_files(masking.masked(d, options), out, "/in").collect()
        assert len(rows) == 4 and all(r["ok"] for r in rows) and sum(r["backup"] is not None for r in rows) == backups, turn
    assert (tmp_path / "out/报告_脱敏.txt").read_text() == "[邮箱1]"
    assert "x@y.org" in (tmp_path / "out/报告_脱敏映射表.json").read_text()
    (tmp_path / "out/b_脱敏.md").write_text("older")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in sinks.write_files(masking.masked(d), out, "/in").collect()}
    assert open(rows["b_脱敏.md"]["backup"]).read() == "older" and (tmp_path / "out/b_脱敏.md").read_text() == "nothing"
    assert not list((tmp_path / "out").glob("*.part"))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.md").write_bytes("中文\n二".encode())
    (tmp_path / "c.docx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    (tmp_path / "d.xls").write_bytes(b"x")
    d = files.checked(files.documents(spark, str(tmp_path)))
    problems = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in d.collect()}
    assert problems == {"a.txt": None, "b.md": None, "c.docx": "legacy content under another extension", "d.xls": "legacy format"}
    assert sorted(r["text"] for r in files.text_blocks(d).collect()) == ["中文", "中文", "二"]
    m = spark.createDataFrame([("/x/报告_脱敏映射表.json", "{}")], "path string, mapping string")
    found, missing = files.with_mapping(spark.createDataFrame([("/x/报告_脱敏.txt",), ("/x/else.txt",)], "path string"), m)
    assert (found.count(), missing.count()) == (1, 1)
    assert files.dictionary(spark, None, "k", ("甲",)).first()["word"] == "甲"


def test_mapping_files(spark):
    d = spark.createDataFrame([(1, '{"version":2,"entries":[{"code":"[公司1]","surface":"甲","label":"公司"}]}'), (2, '{"[公司1]":"乙"}'), (3, "broken")], "doc_id long, mapping string")
    assert sorted(tuple(r) for r in codes.mapping_read(d).collect()) == [(1, 2, "[公司1]", "甲"), (2, 1, "[公司1]", "乙")]
    rows = spark.createDataFrame([(1, "[公司7]①", "甲", "公司"), (1, "[公司7]", "乙", "公司")], "doc_id long, code string, surface string, label string")
    assert codes.mapping_read(codes.mapping_json(rows)).count() == 2
    assert codes.counters(rows).first()["last"] == 7


def test_recognizer(spark):
    docs = spark.createDataFrame([(1, "供应商小麦公司。采购小麦")], "doc_id long, text string")
    a = spark.createDataFrame([(1, 0, "ORG\t小麦\nPER\t张三\nEXCEPT\t小麦\t采购\n???\nEND"), (1, 1, "LOC\t北京")], "doc_id long, chunk int, answer string")
    names, exceptions, issues = recognizer.parsed(a)
    assert {r["surface"] for r in recognizer.in_text(names, docs).collect()} == {"小麦"}
    assert exceptions.first()["anchor"] == "采购" and issues.count() == 2
    spans = spark.createDataFrame([(1, "小麦", "供应商"), (1, "小麦", "采购")], "doc_id long, surface string, anchor string")
    assert linking.without_exceptions(spans, exceptions, ["doc_id", "surface", "anchor"]).count() == 1
    assert linking.unlocated(exceptions.withColumn("surface", F.lit("x")), spans, ["doc_id", "surface", "anchor"]).count() == 1


def test_a_recognizer_that_fails(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def shaky(batches):
        for b in batches:
            mark = calls / "-".join(str(i) for i in b["doc_id"])
            first = not mark.exists()
            mark.touch()
            if 4 in set(b["doc_id"]):
                raise ValueError("can't read this one")
            if first:
                raise TimeoutError("the first time")
            yield b[["doc_id", "chunk"]].assign(answer="PER\tA\nEND")

    batches = spark.createDataFrame([(i, 0, f"text {i}") for i in range(1, 7)], "doc_id long, chunk int, c string").coalesce(1)
    asked = recognizer.retrying(shaky, attempts=2, wait=0.0)
    path = str(tmp_path / "answers")
    answers = recognizer.asked_once(batches, asked, path)
    assert {r["doc_id"] for r in answers.where("answer IS NULL").collect()} == {4} and answers.count() == 6
    _, _, issues = recognizer.parsed(answers)
    assert [r["doc_id"] for r in issues.collect()] == [4]
    before = set(calls.iterdir())
    assert recognizer.asked_once(batches, asked, path).count() == 6
    assert {p.name for p in set(calls.iterdir()) - before} <= {"4"}
    assert recognizer.asked_once(batches.limit(0), asked, str(tmp_path / "none")).count() == 0
    once = recognizer.retrying(shaky, attempts=1, wait=0.0)
    (calls / "9").unlink(missing_ok=True)
    alone = spark.createDataFrame([(9, 0, "x")], "doc_id long, chunk int, c string")
    assert recognizer.asked(alone, once).first()["answer"] is None


def test_aliases(spark):
    hits = spark.createDataFrame(
        [(1, 0, "甲公司", "公司", None), (1, 5, "“甲”", "简称", "甲"), (1, 9, "张三", "人名", None), (1, 12, "“乙”", "简称", "乙"),
         (1, 20, "丙公司", "公司", None), (1, 25, "“甲”", "简称", "甲"), (2, 0, "“丁”", "简称", "丁")],
        "doc_id long, start int, surface string, label string, alias string",
    )
    assert [tuple(r) for r in aliases.declared_to(hits.unionByName(hits)).collect()] == [(1, "甲", "甲公司")]
    names = spark.createDataFrame([(1, "甲", 1), (1, "乙", 2), (2, "甲", 1), (1, None, None)], "doc_id long, surface string, org_id long")
    moves = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 2)], "doc_id long, old long, new long")
    assert sorted(map(tuple, aliases.moved(names, moves).collect()), key=repr) == sorted([(1, "甲", 2), (1, "乙", 3), (2, "甲", 1), (1, None, None)], key=repr)
    more = spark.createDataFrame([(1, "甲", 9), (1, "本所", 8), (1, "本所", 7)], "doc_id long, surface string, org_id long")
    assert {tuple(r) for r in aliases.registered(names, more).collect()} == {tuple(r) for r in names.collect()} | {(1, "本所", 7)}
    candidates = spark.createDataFrame([(1, "关于甲公司"), (1, "甲公司"), (2, "关于甲公司"), (1, None)], "doc_id long, surface string")
    known = spark.createDataFrame([(1, "甲公司"), (1, ""), (1, None)], "doc_id long, surface string")
    assert sorted(map(tuple, aliases.without_dirty(candidates, known).collect()), key=repr) == sorted([(1, "甲公司"), (2, "关于甲公司"), (1, None)], key=repr)
    empty = names.limit(0)
    assert aliases.registered(empty, empty).count() == aliases.moved(empty, moves).count() == aliases.without_dirty(empty, known).count() == 0


def test_relations_of_chunks(spark):
    batches = spark.createDataFrame([(1, 0, "甲与乙"), (1, 1, "乙"), (1, 2, "丙"), (2, 0, "甲")], "doc_id long, chunk int, c string")
    relations = spark.createDataFrame([(1, "甲", "乙"), (1, "甲", "乙"), (1, "", "丁"), (1, None, "丙")], "doc_id long, surface string, other string")
    assert sorted(map(tuple, recognizer.relations_of(batches, relations).collect())) == [(1, 0, "甲", "乙"), (1, 1, "甲", "乙"), (1, 2, None, "丙")]


def test_options_are_saved(tmp_path):
    o = Options(mode="regex", amounts=True, places=True, more_places=("运城",))
    o.save(tmp_path / "o.json")
    assert Options.load(tmp_path / "o.json") == o
    (tmp_path / "p.json").write_text('{"mode": "regex"}')
    assert Options.load(tmp_path / "p.json") == Options(mode="regex")
    (tmp_path / "q.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        Options.load(tmp_path / "q.json")


def test_write_and_verify(spark, tmp_path):
    done = masking.masked(spark.createDataFrame([(1, "x@y.org"), (2, "nothing"), (3, None)], "doc_id long, text string"))
    out = str(tmp_path / "out")
    sinks.write_masked(done, out, str(tmp_path / "in"))
    sinks.write_mappings(done, out, str(tmp_path / "in"))
    assert sinks.verified(spark, out, done).count() == 0
    again = spark.read.json(f"{out}/mappings")
    assert [tuple(r)[2:] for r in codes.mapping_read(again).collect()] == [("[邮箱1]", "x@y.org")]
    with pytest.raises(ValueError):
        sinks.write_masked(done, out, out)


def test_stream_equals_batch(spark, tmp_path):
    q = stream.start(stream.documents(spark, SF), str(tmp_path / "o"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    batch = masking.masked(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), Options(mode="regex"))
    key = lambda d: {(r["doc_id"], r["masked"]) for r in d.select("doc_id", "masked").collect()}
    assert key(spark.read.parquet(str(tmp_path / "o"))) == key(batch)
