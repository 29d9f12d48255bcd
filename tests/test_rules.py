"""Golden cases of rules, spans, codes and masking."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskloom.functions import orgs, rules
from maskloom.functions import spans as sp
from maskloom.options import Options
from maskloom.plans import masking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("amount", "currency", "out"),
    [("14,523,900.00元", "元", "1500万余元"), ("123万美元", "美元", "100万余美元"), ("2,850,000.00元", "元", "300万余元"), ("3,120,000.00元", "元", "300万余元"), ("999,999.99元", "元", None), ("1,500,000元", "元", "200万余元"), ("2,500,000元", "元", "200万余元")],
)
def test_amounts(spark, amount, currency, out):
    assert one(spark, rules.amount_masked(rules.amount_value(F.lit(amount)), F.lit(currency))) == out


def test_dates(spark):
    assert one(spark, rules.year_masked(F.lit("2023年9月15日"))) == "20X3年9月15日"
    assert [s["surface"] for s in one(spark, sp.found(F.lit("2024年3月15日和2024年3月"), rules.MONTH))] == ["2024年3月"]
    assert one(spark, rules.valid_date(F.lit("2023年2月30日"))) is False


def test_checksums(spark):
    assert one(spark, rules.id_checksum_ok(F.lit("11010519491231002X"))) is True
    assert one(spark, rules.id_checksum_ok(F.lit("110105194912310021"))) is False
    assert one(spark, rules.credit_checksum_ok(F.lit("91350100M000100Y43"))) is True
    assert one(spark, rules.credit_checksum_ok(F.lit("91350100M000100Y44"))) is False


def test_spans_next_to_each_other(spark):
    got = one(spark, sp.found(F.lit("电话13800138000,13900139000号"), rules.MOBILE))
    assert [(s["start"], s["surface"]) for s in got] == [(2, "13800138000"), (14, "13900139000")]


@pytest.mark.parametrize(("text", "rule", "hits"), [
    ("1.2.3.4 999.1.1.1", rules.IPV4, ["1.2.3.4"]), ("MAC 00:1a:02:0b:0C:04", rules.MAC, ["00:1a:02:0b:0C:04"]), ("京A12345，北京NATION_1", rules.PLATE, ["京A12345"]),
    ("账号：123456，数量654321", rules.LABELLED_ACCOUNT, ["123456"]), ("010-12345678-123", rules.LANDLINE, ["010-12345678-123"]), ("😀a.b@c.example.com", rules.EMAIL, ["a.b@c.example.com"]),
])
def test_rules(spark, text, rule, hits):
    got = one(spark, sp.found(F.lit(text), rule))
    assert [s["surface"] for s in got] == hits
    assert all(text[s["start"] : s["end"]] == s["surface"] for s in got)


def test_organizations(spark):
    assert one(spark, orgs.peeled(F.lit("闻喜县新佳新能源有限公司"))) == "闻喜新佳"
    assert one(spark, orgs.peeled(F.lit("甲乙丙有限公司"), ())) == "甲乙丙"
    assert one(spark, orgs.full_names(F.lit("关于收购闻喜县新佳新能源有限公司的公告"))) == ["闻喜县新佳新能源有限公司"]
    assert one(spark, orgs.declared(F.lit("以下简称“甲方”"))) == []


def test_places_and_alias_candidates(spark):
    names = ("宏图", "宏", "的宏图", "北京", "公司", "宏图公司", "甲银行", "宏图科技发展实业贸易", None, "运城")
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", orgs.alias_like(F.col("n"), ("运城",)).alias("ok"))
    assert [names[r["i"]] for r in d.orderBy("i").collect() if r["ok"]] == ["宏图", "宏图公司"]
    u = spark.createDataFrame([("黑龙江省宏图",), ("北京",), ("运城市宏图",), ("宏图北京",)], "n string").select(orgs.unplaced(F.col("n"), ("运城",)).alias("u"))
    assert [r["u"] for r in u.collect()] == ["宏图", "北京", "宏图", "宏图北京"]
    text = "运城市宏图科技有限公司与宏图签约"
    for places, masked in ((False, "[公司1]与宏图签约"), (True, "[公司1]与[公司1]①签约")):
        done = masking.restored(masking.masked(spark.createDataFrame([(1, text)], "doc_id long, text string"), Options(mode="regex", places=places, more_places=("运城",)))).first()
        assert (done["masked"], done["restored"]) == (masked, text)


def test_suffixes(spark):
    assert [one(spark, sp.suffix(F.lit(k))) for k in (0, 1, 10, 11)] == ["", "①", "⑩", "(11)"]


def test_overlap(spark):
    span = lambda a, b, p: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("s").alias("surface"), F.lit("L").alias("label"), F.lit("x").alias("source"), F.lit(p).alias("prio"))
    kept = one(spark, sp.resolved(F.array(span(0, 5, 2), span(3, 9, 1), span(9, 12, 3))))
    assert [(s["start"], s["end"]) for s in kept] == [(3, 9), (9, 12)]


TEXTS = [
    "北京甲乙新能源科技有限公司（以下简称“甲乙能源”）与甲乙能源签约，电话13800138000,13900139000，于2023年9月15日和2013年1月。",
    "a@b.com a@b.com x@y.org 1.2.3.4 [邮箱3] 闻喜县新佳新能源有限公司", "", None, "😀 x@y.org 😀", " ".join(f"u{i}@h.org" for i in range(12)),
]


def test_round_trip(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in masking.restored(masking.masked(d)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["restored"] == t
        assert len(set(got[i]["mapping"].values())) == len(got[i]["mapping"])
    assert "13800138000" not in got[0]["masked"] and "甲乙" not in got[0]["masked"]
    assert "（以下简称“[公司1]①”）与[公司1]①签约" in got[0]["masked"]
    assert got[1]["masked"].startswith("[邮箱4] [邮箱4] [邮箱5]") and "[邮箱3]" in got[1]["masked"]


def test_independent_of_other_documents(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "doc_id long, text string")
    whole = {r["doc_id"]: r["masked"] for r in masking.masked(d).collect()}
    alone = {r["doc_id"]: r["masked"] for r in masking.masked(d.orderBy(F.desc("doc_id")).repartition(3)).collect()}
    assert whole == alone


def test_model_names_and_exact_dates(spark):
    d = spark.createDataFrame([(1, "张三于2023年9月15日致电张三丰", [("张三", "人名")])], "doc_id long, text string, named array<struct<surface:string,label:string>>")
    r = masking.restored(masking.masked(d, Options(exact_dates=True), named="named")).first()
    assert r["masked"] == "[人名1]于[日期1]致电[人名1]丰" and r["restored"] == r["text"]
    with pytest.raises(ValueError):
        Options(dates=False, exact_dates=True)


AMOUNTS = [
    ("收14,523,900.00元，付123万美元，另999,999.99元。", "收1500万余元，付100万余美元，另999,999.99元。"),
    ("2,850,000.00元、3,120,000.00元、2,850,000.00元、1,234,567", "300万余元、300万余元①、300万余元、100万余元"),
    ("已有300万余元②与2,850,000元", "已有300万余元②与300万余元③"),
    ("2,850,000元(3)和3,120,000元①", "300万余元①(3)和300万余元②①"),
    ("99999999999999999999999999亿元，账号6222020200112233445元", "[金额1]，账号[账号1]元"),
    ("、".join(f"{3_000_000 + i}元" for i in range(13)), "、".join(["300万余元", *(f"300万余元{x}" for x in "①②③④⑤⑥⑦⑧⑨⑩"), "300万余元(11)", "300万余元(12)"])),
    ("2023年9月15日付300万元", "20X3年9月15日付300万余元"),
    (None, None),
]


def test_amounts_are_masked_and_restored(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(AMOUNTS)], "doc_id long, text string")
    for mode in ("regex", "llm"):
        got = {r["doc_id"]: r for r in masking.restored(masking.masked(d, Options(mode=mode, amounts=True))).collect()}
        assert [got[i]["masked"] for i in range(len(AMOUNTS))] == [m for _, m in AMOUNTS]
        assert [got[i]["restored"] for i in range(len(AMOUNTS))] == [t for t, _ in AMOUNTS]
    assert got[1]["mapping"] == {"300万余元": "2,850,000.00元", "300万余元①": "3,120,000.00元", "100万余元": "1,234,567"}
    assert all(x["stage"] != "amounts" for x in got[0]["issues"])
    off = masking.masked(d.where("doc_id = 0"), Options(mode="regex")).first()
    assert off["masked"] == AMOUNTS[0][0] and any(x["stage"] == "amounts" for x in off["issues"])


def test_restore_takes_the_longest_code(spark):
    m = F.create_map(F.lit("[人名1]"), F.lit("甲"), F.lit("[人名10]"), F.lit("乙"), F.lit("[公司1]"), F.lit("丙"), F.lit("[公司1]①"), F.lit("丁"))
    assert one(spark, sp.restored(F.lit("[人名10][人名1][公司1]①[公司1][未知1]"), m)) == "乙甲丁丙[未知1]"


def test_scalars(spark):
    assert one(spark, rules.formula_constants(F.lit('=IF(A1>1,"甲""公司","乙")'))) == ['甲"公司', "乙"]
    assert one(spark, rules.full_digits(F.lit("6.2E18"))) == "6200000000000000000"
    assert one(spark, rules.api_base(F.lit("http://x:1/v1beta/"))) == "http://x:1/v1beta"
    assert one(spark, rules.address_fragments(F.lit("山西省运城市"))) == ["山西省", "山西省运城市"]


def test_spans_of_long_texts_cost_what_they_are(spark):
    """10,000 distinct hits in one text, and as many overlapping ones, in seconds."""
    text = " ".join(f"user{i}@mail{i % 97}.example.com said 10.{i % 250}.3.{i % 199}" for i in range(5000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    masking.masked(d, Options(mode="regex"))  # the columns are made once
    began = time.perf_counter()
    r = masking.restored(masking.masked(d, Options(mode="regex"))).select(F.size("spans").alias("n"), (F.col("restored") == F.col("text")).alias("same")).first()
    assert (r["n"], r["same"]) == (10_000, True)
    assert time.perf_counter() - began < 60
    spans_ = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.array(*(F.struct((i * 10 + a).cast("int").alias("start"), (i * 10 + b).cast("int").alias("end"), F.lit("x").alias("surface"), F.lit("l").alias("label"), F.lit("s").alias("source"), F.lit(p).alias("prio")) for a, b, p in ((0, 6, 1), (4, 9, 2))))))
    got = spark.range(1).select(sp.resolution(spans_).alias("r")).select(F.size("r.kept").alias("k"), F.size("r.crossed").alias("c")).first()
    assert (got["k"], got["c"]) == (5000, 5000)


def test_running_and_numbering_against_plain_loops(spark):
    rng = random.Random(5)
    for n in (0, 1, 7, 600):
        values = [rng.randrange(-3, 9) for _ in range(n)]
        r = spark.createDataFrame([(values,)], "v array<int>").select(sp.running(F.col("v"), lambda a, x: a + x, F.lit(0)).alias("s"), sp.last_set(F.col("v")).alias("l"), sp.running(F.col("v"), lambda a, x: F.greatest(a, x), F.lit(-100), block=4).alias("m")).first()
        last, want = -1, []
        for v in values:
            last = v if v >= 0 else last
            want.append(last)
        assert r["s"] == [sum(values[: i + 1]) for i in range(n)] and r["l"] == want and r["m"] == [max(values[: i + 1]) for i in range(n)]
    rows = []
    for i in range(40):
        names = [(rng.choice("ab"), rng.choice(["u", "v", "w", "x"])) for _ in range(rng.randrange(12))]
        rows.append((i, [(2 * j, 2 * j + 1, s, label, "t", 1) for j, (label, s) in enumerate(names)]))
    owners = F.array(F.struct(F.lit("v").alias("surface"), F.lit("u").alias("full")), F.struct(F.lit("w").alias("surface"), F.lit("u").alias("full")))
    d = spark.createDataFrame(rows, f"i long, s array<{sp.SPAN}>").select("i", masking.numbered(F.col("s"), F.lit(3), owners).alias("n"))
    for r in d.collect():
        codes, which = [], []
        for _, _, surface, label, _, _ in rows[r["i"]][1]:
            full = {"v": "u", "w": "u"}.get(surface, surface)
            at = next((j for j, c in enumerate(codes) if c[:2] == (label, surface)), None)
            if at is None:
                mine = [c for c in codes if c[0] == label]
                own = [c for c in mine if c[2] == full]
                number = own[0][3] if own else 4 + len({c[3] for c in mine})
                codes.append((label, surface, full, number, 0 if surface == full else 1 + sum(c[4] > 0 for c in own)))
                at = len(codes) - 1
            which.append(at)
        assert [tuple(c) for c in r["n"]["codes"]] == codes and r["n"]["which"] == which


def test_exact_dates_and_fields(spark):
    texts = ["2024年3月15日和2024年3月，2024年2月30日，2024年13月", "身份证号：110105194912310021，编号110105194912310021", "税号：91350100M000100Y4X"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = {r["doc_id"]: r for r in masking.restored(masking.masked(d, Options(mode="regex", exact_dates=True))).collect()}
    assert done[0]["masked"] == "[日期1]和[日期2]，20X4年2月30日，20X4年13月"
    assert done[1]["masked"].startswith("身份证号：[证件1]，编号[") and "证件" not in done[1]["masked"].split("编号")[1]
    assert done[2]["masked"] == "税号：[信用代码1]"
    assert all(r["restored"] == r["text"] for r in done.values())
    cells = spark.createDataFrame([(1, "6222 0000", "账号"), (2, "6222 0000", None), (3, " 14,523,900.00 ", "金额"), (4, "999", "金额"), (5, "甲方", "账号"), (6, None, "账号")], "doc_id long, text string, hint string")
    got = {r["doc_id"]: r["masked"] for r in masking.masked(cells, Options(mode="regex", amounts=True), hint="hint").collect()}
    assert got == {1: "[账号1]", 2: "6222 0000", 3: " 1500万余元 ", 4: "999", 5: "甲方", 6: None}
