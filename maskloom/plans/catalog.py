"""The registered queries of the de-identification engine and their SQL.

English categories are looked for in ``documents`` and ``pages``. The tables hold no Chinese text, so the rules for it run
over texts derived from table keys; the same derivation stands in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.functions import orgs, rules
from maskloom.functions import spans as sp
from maskloom.operators import aliases, codes, linking
from maskloom.options import Options
from maskloom.plans import masking
from maskloom.session import dealt, spread, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document masked by rule and restored."""
    done = masking.restored(masking.masked(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), Options(mode="regex")))
    return done.select("doc_id", F.size("spans").alias("n_spans"), "masked", F.col("restored").eqNullSafe(F.col("text")).alias("restored_ok"))


# --- what the SQL of several queries shares ------------------------------------------------------------------------------

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
#: The categories that the documents hold, as one pattern of the subset that both engines share.
_ANY = rf"{_EMAIL}|{_PHONE}|[0-9]{{16}}|{_IP}"
_ONE = rules.Rule("any", "X", _ANY, 0, 1)

#: The shipped rules' hits in documents, without look-around: maximal runs of digits and of digits with dots, told by length.
_SHIPPED_ANY = rf"{_EMAIL}|\+[0-9]{{1,3}}[ -]?\(?[0-9]{{1,4}}\)?[ -]?[0-9]{{3,4}}[ -]?[0-9]{{4}}|[0-9]+(?:\.[0-9]+)+|[0-9]+"
_SHIPPED = rf"""runs AS (
  SELECT doc_id, text, m[i] AS surface, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{_SHIPPED_ANY}') AS m, string_split_regex(text, '{_SHIPPED_ANY}') AS g FROM documents WHERE text IS NOT NULL))),
kinds AS (
  SELECT *, CASE WHEN contains(surface, '@') THEN '邮箱' WHEN starts_with(surface, '+') THEN '电话'
    WHEN regexp_full_match(surface, '{_IP}') THEN CASE WHEN len(list_filter(string_split(surface, '.'), lambda p: CAST(p AS INT) > 255)) = 0 THEN 'IP' END
    WHEN regexp_full_match(surface, '[0-9]{{16,19}}') THEN '账号' WHEN regexp_full_match(surface, '1[0-9]{{10}}') THEN '电话' END AS label FROM runs),
spans AS (SELECT * FROM kinds WHERE label IS NOT NULL),
firsts AS (SELECT doc_id, label, surface, min(start) AS first FROM spans GROUP BY ALL),
above AS (SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '\[[^\[\]0-9]+([0-9]{{1,6}})\]', 1), lambda x: CAST(x AS INT))), 0) AS n FROM documents WHERE text IS NOT NULL),
shipped AS (SELECT doc_id, label, surface, a.n + dense_rank() OVER (PARTITION BY doc_id, label ORDER BY first) AS n FROM firsts JOIN above a USING (doc_id)),
cuts AS (SELECT s.*, n, coalesce(lag(start + length(surface)) OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM spans s JOIN shipped USING (doc_id, label, surface)),
pieced AS (
  SELECT doc_id, string_agg(substr(text, CAST(prev AS BIGINT) + 1, CAST(start - prev AS BIGINT)) || '[' || label || n || ']', '' ORDER BY start) AS head, max(start + length(surface)) AS last, count(*) AS n_spans
  FROM cuts GROUP BY doc_id),
masks AS (SELECT doc_id, coalesce(n_spans, 0) AS n_spans, regexp_replace(coalesce(head || substr(text, CAST(last AS BIGINT) + 1), text), '([0-9]{{2}})[0-9]([0-9])年', '\1X\2年', 'g') AS masked, text FROM documents LEFT JOIN pieced USING (doc_id))"""


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, masked as a user's are."""
    return masking.masked(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), Options(mode="regex"))


_HITS = f"""hits AS (
  SELECT doc_id, i AS ord, m[i] AS surface,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{_ANY}') AS m, string_split_regex(text, '{_ANY}') AS g FROM documents WHERE text IS NOT NULL)))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.rlike("text", F.lit(_ANY)))
    return d.select("doc_id", F.posexplode(sp.found(F.col("text"), _ONE)).alias("i", "s")).select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), F.col("s.surface").alias("surface"), F.col("s.start").cast("long").alias("start"))


def _counted(name: str, pattern: str, of: str = "documents", text: str = "text", key: str = "doc_id", keep: Callable[[Column], Column] | None = None, keep_sql: str | None = None, rule: rules.Rule | None = None) -> None:
    """A query of the hits of a pattern, or of a shipped rule, per row: how many, how many distinct, the first and the last.

    The SQL has the pattern, without look-around, and a filter in its place.
    """
    java = rule.pattern if rule else pattern

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spread(table(spark, sf_dir, of).select(key, text)).where(F.rlike(text, F.lit(java)))
        hits = F.transform(sp.found(F.col(text), rule), lambda x: x["surface"]) if rule else F.regexp_extract_all(text, F.lit(java), F.lit(0))
        hits = F.filter(hits, keep) if keep else hits
        d = d.select(key, hits.alias("h")).where(F.size("h") > 0)
        return d.select(key, F.size("h").cast("long").alias("n"), F.size(F.array_distinct("h")).cast("long").alias("distinct_n"), F.get("h", F.lit(0)).alias("first_hit"), F.element_at("h", -1).alias("last_hit"))

    f.__name__ = name
    h = f"regexp_extract_all({text}, '{pattern}')"
    h = f"list_filter({h}, lambda x: {keep_sql})" if keep_sql else h
    query(f"SELECT {key}, len(h) AS n, len(list_distinct(h)) AS distinct_n, h[1] AS first_hit, h[-1] AS last_hit FROM (SELECT {key}, {h} AS h FROM {of}) WHERE len(h) > 0")(f)


_LUHN_SQL = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (TRY_CAST(x[i] AS INT) * 2) // 10 + (TRY_CAST(x[i] AS INT) * 2) % 10 ELSE TRY_CAST(x[i] AS INT) END)) % 10 = 0"
_counted("email_hits", _EMAIL, rule=rules.EMAIL)
_counted("phone_hits", r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{4}", rule=rules.INTL_PHONE)
_counted("ipv4_hits", r"[0-9]+(?:\.[0-9]+)+", keep_sql=rf"regexp_full_match(x, '{_IP}') AND len(list_filter(string_split(x, '.'), lambda p: CAST(p AS INT) > 255)) = 0", rule=rules.IPV4)
_counted("card_hits_any", "[0-9]+", keep_sql="length(x) BETWEEN 16 AND 19", rule=rules.CARD)
_counted("card_hits_luhn", "[0-9]+", keep=lambda x: (F.length(x) == 16) & F.call_function("luhn_check", x), keep_sql=f"length(x) = 16 AND {_LUHN_SQL}", rule=rules.CARD)
_counted("token_spans", 'token = "[^"]*"')
_counted("page_email_hits", _EMAIL, of="pages", text="html", key="page_id")


@query(f"SELECT lang, count(*) AS docs, count(*) FILTER (regexp_matches(text, '{_EMAIL}')) AS with_email, count(*) FILTER (regexp_matches(text, '[0-9]{{16}}')) AS with_card, sum(len(regexp_extract_all(text, '{_ANY}')))::BIGINT AS hits FROM documents GROUP BY lang")
def pii_counts_by_lang(spark, sf_dir):
    return _counts_by(spark, sf_dir, "lang")


@query(f"SELECT source, count(*) AS docs, count(*) FILTER (regexp_matches(text, '{_EMAIL}')) AS with_email, count(*) FILTER (regexp_matches(text, '[0-9]{{16}}')) AS with_card, sum(len(regexp_extract_all(text, '{_ANY}')))::BIGINT AS hits FROM documents GROUP BY source")
def pii_counts_by_source(spark, sf_dir):
    return _counts_by(spark, sf_dir, "source")


def _counts_by(spark, sf_dir, key):
    has = lambda p: F.count_if(F.rlike("text", F.lit(p)))
    return table(spark, sf_dir, "documents").groupBy(key).agg(F.count("*").alias("docs"), has(_EMAIL).alias("with_email"), has("[0-9]{16}").alias("with_card"), F.sum(F.regexp_count("text", F.lit(_ANY))).cast("long").alias("hits"))


@query(f"WITH {_SHIPPED} SELECT doc_id, label, surface, start, start + length(surface) AS stop FROM spans")
def span_offsets(spark, sf_dir):
    d = _shipped(spark, sf_dir).select("doc_id", F.explode("spans").alias("s"))
    return d.select("doc_id", F.col("s.label").alias("label"), F.col("s.surface").alias("surface"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"))


@query(f"WITH {_HITS} SELECT h.doc_id, ord, substr(text, start + 1, length(surface)) = surface AS same FROM hits h JOIN documents d USING (doc_id)")
def span_text_check(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.rlike("text", F.lit(_ANY)))
    d = d.select("doc_id", "text", F.posexplode(sp.found(F.col("text"), _ONE)).alias("i", "s"))
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), (F.substr("text", F.col("s.start") + 1, F.length("s.surface")) == F.col("s.surface")).alias("same"))


_NUMBERED = f"""WITH {_HITS},
f AS (SELECT doc_id, surface, min(start) AS first FROM hits GROUP BY doc_id, surface),
c AS (SELECT doc_id, surface, first, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM f)"""


def _numbers(spark, sf_dir):
    spans = _spans(spark, sf_dir).withColumn("label", F.lit("X"))
    return codes.numbered(spans)


@query(f"WITH {_SHIPPED} SELECT doc_id, label, surface, n FROM shipped")
def code_numbers(spark, sf_dir):
    return _shipped(spark, sf_dir).select("doc_id", F.explode("codes").alias("c")).select("doc_id", "c.label", "c.surface", F.col("c.n").cast("long").alias("n"))


@query(f"WITH {_SHIPPED} SELECT doc_id, '[' || label || n || ']' AS code, surface FROM shipped")
def mapping_rows(spark, sf_dir):
    return _shipped(spark, sf_dir).select("doc_id", F.explode("mapping").alias("code", "surface"))


@query(f"{_NUMBERED} SELECT doc_id, surface, n FROM c")
def exploded_numbers(spark, sf_dir):
    """Numbering over exploded spans, the form for long collections of spans."""
    return _numbers(spark, sf_dir).select("doc_id", "surface", F.col("n").cast("long").alias("n"))


@query(f"WITH {_SHIPPED} SELECT doc_id, n_spans, md5(masked) AS masked_md5 FROM masks")
def masked_text_md5(spark, sf_dir):
    return _shipped(spark, sf_dir).select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.md5(F.col("masked").cast("binary")).alias("masked_md5"))


@query(f"WITH {_SHIPPED} SELECT doc_id, md5(masked) AS masked_md5, md5(text) AS restored_md5, true AS same FROM masks")
def restored_equals(spark, sf_dir):
    """What was masked is checked beside what is restored, so that masking nothing would not pass."""
    d = masking.restored(_shipped(spark, sf_dir))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return d.select("doc_id", digest("masked").alias("masked_md5"), digest("restored").alias("restored_md5"), F.col("restored").eqNullSafe(F.col("text")).alias("same"))


@query(f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '{_ANY}')")
def docs_without_hit(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(~F.rlike("text", F.lit(_ANY))).select("doc_id")


@query(f"SELECT source, count(*) FILTER (regexp_matches(text, '{_ANY}')) AS masked, count(*) AS docs, CAST(count(*) FILTER (regexp_matches(text, '{_ANY}')) AS DOUBLE) / count(*) AS share FROM documents GROUP BY source")
def masked_share(spark, sf_dir):
    hit = F.count_if(F.rlike("text", F.lit(_ANY)))
    return table(spark, sf_dir, "documents").groupBy("source").agg(hit.alias("masked"), F.count("*").alias("docs"), (hit / F.count("*")).alias("share"))


_CHUNKS = "SELECT doc_id, i AS chunk, substr(text, i * 5950 + 1, 6000) AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 5950.0) AS BIGINT), 1))) AS i FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, chunk, length(c) AS size, md5(c) AS chunk_md5 FROM ({_CHUNKS})")
def chunks_6000_50(spark, sf_dir):
    from maskloom.operators.recognizer import chunks

    d = chunks(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("c").cast("long").alias("size"), F.md5(F.col("c").cast("binary")).alias("chunk_md5"))


@query(f"WITH {_HITS} SELECT doc_id, surface, count(*) AS n FROM hits GROUP BY doc_id, surface HAVING count(*) > 1")
def dup_surface_per_doc(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("doc_id", "surface").agg(F.count("*").alias("n")).where("n > 1")


_RUNS = """WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM r)
SELECT conv_id, CAST(island AS BIGINT) AS island, role, min(turn) AS first_turn, count(*) AS turns FROM i GROUP BY conv_id, island, role"""


@query(_RUNS)
def runs_of_same_role(spark, sf_dir):
    return linking.runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "island", "role", F.col("first").alias("first_turn"), F.col("n").alias("turns"))


@query("SELECT conv_id, turn, i AS chunk, substr(text, i * 950 + 1, 1000) AS part FROM (SELECT conv_id, turn, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 950.0) AS BIGINT), 1))) AS i FROM conversations WHERE text IS NOT NULL)")
def turn_chunks(spark, sf_dir):
    from maskloom.operators.recognizer import chunks

    d = chunks(table(spark, sf_dir, "conversations"), size=1000, overlap=50)
    return d.select("conv_id", "turn", F.col("chunk").cast("long").alias("chunk"), F.col("c").alias("part"))


@query(f"SELECT quality, count(*) AS docs, count(*) FILTER (regexp_matches(text, '{_ANY}')) AS with_pii FROM labels LEFT JOIN documents USING (doc_id) GROUP BY quality")
def labelled_pii_rate(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.rlike("text", F.lit(_ANY)).alias("hit")), "doc_id", "left")
    return d.groupBy("quality").agg(F.count("*").alias("docs"), F.count_if("hit").alias("with_pii"))


@query(f"SELECT toxic, regexp_matches(text, '{_ANY}') AS pii, count(*) AS docs FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def toxic_pii_crosstab(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.rlike("text", F.lit(_ANY)).alias("pii")), "doc_id")
    return d.groupBy("toxic", "pii").agg(F.count("*").alias("docs"))


_LISTED = f"WITH {_HITS}, s AS (SELECT doc_id, start, start + length(surface) AS stop, length(surface) AS len FROM hits UNION ALL SELECT doc_id, start + 3, start + 10, 7 FROM hits WHERE length(surface) >= 7)"


@query(f"""{_LISTED}, l AS (SELECT doc_id, list(struct_pack(a := start, b := stop) ORDER BY start, len DESC) AS l FROM s GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN x.a >= acc[-1].b THEN list_append(acc, x) ELSE acc END, [struct_pack(a := CAST(-1 AS BIGINT), b := CAST(-1 AS BIGINT))])[2:] AS k FROM l)
SELECT doc_id, len(k) AS kept, k[1].a AS first_start, k[-1].b AS last_end FROM k""")
def overlap_resolve(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(F.rlike("text", F.lit(_ANY))).select("doc_id", sp.found(F.col("text"), _ONE).alias("s"))
    inner = F.transform(F.filter("s", lambda s: s["end"] - s["start"] >= 7), lambda s: s.withField("start", s["start"] + 3).withField("end", s["start"] + 10).withField("prio", F.lit(5)))
    d = d.select("doc_id", sp.resolved(F.concat("s", inner)).alias("k"))
    return d.select("doc_id", F.size("k").cast("long").alias("kept"), F.get("k", F.lit(0))["start"].cast("long").alias("first_start"), F.element_at("k", -1)["end"].cast("long").alias("last_end"))


# --- Chinese rules over derived texts ---------------------------------------------------------------------------------------

_FX_PHONE = "SELECT c_custkey AS doc_id, concat('电话', cast(13000000000 + c_custkey*7919 AS varchar(20)), '，备用', cast(15900000000 + c_custkey AS varchar(20)), '。') AS text FROM customer"
_FX_DATE = "SELECT o_orderkey AS doc_id, concat('签订于', cast(year(o_orderdate) AS varchar(4)), '年', cast(month(o_orderdate) AS varchar(2)), '月', cast(day(o_orderdate) AS varchar(2)), '日，', cast(year(o_orderdate) AS varchar(4)), '年', cast(month(o_orderdate) AS varchar(2)), '月生效') AS text FROM orders"
_FX_AMOUNT = "SELECT o_custkey AS doc_id, o_orderkey AS ord, cast(o_totalprice AS decimal(20,2))*100 AS amount FROM orders"
_FX_PLATE = "SELECT s_suppkey AS doc_id, concat('车牌京A', lpad(cast(s_suppkey*37+10000 AS varchar(5)),5,'0'), '，MAC 00:1a:', lpad(cast(s_suppkey % 100 AS varchar(2)),2,'0'), ':0b:0C:', lpad(cast(s_suppkey*3 % 100 AS varchar(2)),2,'0')) AS text FROM supplier"
_FX_ORG = "SELECT s_suppkey AS doc_id, concat('北京', n_name, '新能源科技有限公司（以下简称“', n_name, '能源”）与', n_name, '能源签约') AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey"
_FX_ID = "SELECT c_custkey AS doc_id, concat('110105', cast(1950 + c_custkey % 60 AS varchar(4)), lpad(cast(1 + c_custkey % 14 AS varchar(2)),2,'0'), lpad(cast(1 + c_custkey % 31 AS varchar(2)),2,'0'), lpad(cast(c_custkey % 1000 AS varchar(3)),3,'0'), substr('10X98765432', CAST(1 + c_custkey % 11 AS INT), 1)) AS id FROM customer"
_FX_ACCOUNT = "SELECT c_custkey AS doc_id, concat('户名甲，账号', CASE WHEN c_custkey % 2 = 0 THEN '：' ELSE '' END, cast(100000 + c_custkey AS varchar(12)), '，数量', cast(200000 + c_custkey AS varchar(12))) AS text FROM customer"
_FX_FORMULA = "SELECT p_partkey AS doc_id, concat('=IF(B', cast(p_size AS varchar(3)), '>3,\"', p_brand, '有限公司\",\"其他\")&SUM(A1:A2)') AS formula FROM part"


def _fx(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table, by the SQL that the other engine runs too. Its tables are those of the folder, under names of their own."""
    for name in ("customer", "orders", "supplier", "nation", "part"):
        if f" {name}" in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(f"fx_{name}")
            sql = sql.replace(f"FROM {name}", f"FROM fx_{name}").replace(f"JOIN {name} ", f"JOIN fx_{name} ")
    return spark.sql(sql.replace('\\"', '"'))


def _of_rule(name: str, fx: str, rule: rules.Rule, pattern: str, keep: str = "true", shape: str = "x") -> None:
    """Hits of a rule in a derived text, against a pattern without look-around and a filter."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _fx(spark, sf_dir, fx).select("doc_id", F.posexplode(sp.found(F.col("text"), rule)).alias("i", "s"))
        return d.select("doc_id", F.col("i").cast("long").alias("ord"), F.col("s.surface").alias("hit"))

    f.__name__ = name
    query(f"SELECT doc_id, i - 1 AS ord, h[i] AS hit FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '{pattern}'), lambda x: {keep}), lambda x: {shape}) AS h FROM ({fx})))")(f)


_of_rule("cn_mobile", _FX_PHONE, rules.MOBILE, "[0-9]+", "length(x) = 11 AND x[1] = '1'")
_of_rule("cn_date_exact", _FX_DATE, rules.DATE, "[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日")
_of_rule("cn_month_form", _FX_DATE, rules.MONTH, "[0-9]{4}年[0-9]{1,2}月(?:[0-9]{1,2}日)?", "NOT ends_with(x, '日')")
_of_rule("plate_hits", _FX_PLATE, rules.PLATE, "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Za-z][A-Za-z0-9]{5,6}")
_of_rule("mac_hits", _FX_PLATE, rules.MAC, "[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}")
_of_rule("labelled_account", _FX_ACCOUNT, rules.LABELLED_ACCOUNT, "账号[:：]?[0-9]{6,30}", shape="regexp_extract(x, '[0-9]+')")


@query(f"SELECT doc_id, regexp_replace(text, '([0-9]{{2}})[0-9]([0-9])年', '\\1X\\2年', 'g') AS masked FROM ({_FX_DATE})")
def cn_date_mask(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_DATE).select("doc_id", rules.year_masked(F.col("text")).alias("masked"))


@query(f"""SELECT doc_id, id, try_strptime(substr(id, 7, 8), '%Y%m%d') IS NOT NULL AS birth_ok,
substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(id[i] AS INT) * ([7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2])[i])) % 11 + 1 AS INT), 1) = id[18] AS checksum_ok FROM ({_FX_ID})""")
def cn_id_checksum(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_ID).select("doc_id", "id", rules.birth_ok(F.col("id")).alias("birth_ok"), rules.id_checksum_ok(F.col("id")).alias("checksum_ok"))


_FUZZY = f"SELECT doc_id, ord, amount, CASE WHEN amount >= 1000000 THEN CAST(CAST(round_even(amount, -6) / 10000 AS BIGINT) AS VARCHAR) || '万余元' END AS fuzzy FROM ({_FX_AMOUNT})"


@query(f"SELECT doc_id, ord, fuzzy FROM ({_FUZZY})")
def amount_fuzzy(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_AMOUNT).select("doc_id", "ord", rules.amount_masked(F.col("amount"), F.lit("元")).alias("fuzzy"))


@query(f"""WITH a AS (SELECT DISTINCT doc_id, amount, fuzzy, min(ord) OVER (PARTITION BY doc_id, amount) AS first FROM ({_FUZZY}) WHERE fuzzy IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fuzzy ORDER BY first) - 1 AS k FROM a)
SELECT doc_id, CAST(amount AS VARCHAR) AS amount, fuzzy || CASE WHEN k = 0 THEN '' WHEN k <= 10 THEN substr('①②③④⑤⑥⑦⑧⑨⑩', k, 1) ELSE '(' || k || ')' END AS code FROM r""")
def amount_collision(spark, sf_dir):
    d = _fx(spark, sf_dir, _FX_AMOUNT).withColumn("fuzzy", rules.amount_masked(F.col("amount"), F.lit("元"))).where("fuzzy is not null")
    return codes.collided(d, ["doc_id"], "amount", "fuzzy", "ord").select("doc_id", F.col("amount").cast("decimal(24,2)").cast("string").alias("amount"), "code")


_FULL_SQL = f"'[\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9_（）()]{{2,30}}?(?:{'|'.join(orgs.FORMS)})'"


@query(f"SELECT doc_id, regexp_extract(text, {_FULL_SQL}) AS org FROM ({_FX_ORG})")
def org_full_names(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_ORG).select("doc_id", F.explode(orgs.full_names(F.col("text"))).alias("org"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(text, {_FULL_SQL}), '(?:{'|'.join(orgs.FORMS)})$', ''), '(?:{'|'.join(orgs.INDUSTRIES)})+$', '') AS alias FROM ({_FX_ORG})")
def org_peeled_alias(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_ORG).select("doc_id", F.explode(orgs.full_names(F.col("text"))).alias("o")).select("doc_id", orgs.peeled(F.col("o")).alias("alias"))


_BLOCKS = f"SELECT doc_id, 0 AS block, text FROM ({_FX_ORG}) UNION ALL SELECT doc_id, 1, '简称“乙方”' FROM ({_FX_ORG})"


@query(f"""WITH o AS (SELECT doc_id, 0 AS block, instr(text, org) - 1 + length(org) AS stop, org FROM (SELECT doc_id, text, regexp_extract(text, {_FULL_SQL}) AS org FROM ({_FX_ORG}))),
a AS (SELECT doc_id, 0 AS block, instr(text, '（以下简称') - 1 AS at, regexp_extract(text, '以下简称“([^”]+)”', 1) AS alias FROM ({_FX_ORG}))
SELECT a.doc_id, a.alias, o.org FROM a ASOF LEFT JOIN o ON a.doc_id = o.doc_id AND a.at >= o.stop""")
def alias_declared_asof(spark, sf_dir):
    d = _fx(spark, sf_dir, _FX_ORG)
    names = d.select("doc_id", "text", F.explode(orgs.full_names(F.col("text"))).alias("org")).select("doc_id", "org", (F.instr("text", F.col("org")) - 1 + F.length("org")).alias("stop"))
    said = d.select("doc_id", (F.instr("text", F.lit("（以下简称")) - 1).alias("at"), F.regexp_extract("text", "以下简称“([^”]+)”", 1).alias("alias"))
    return linking.asof(said, names, ["doc_id"], "at", "stop", ["org"]).select("doc_id", "alias", "org")


@query(f"SELECT s_nationkey AS org, s_suppkey AS alias, '[公司' || s_nationkey || ']' || CASE WHEN k <= 10 THEN substr('①②③④⑤⑥⑦⑧⑨⑩', k, 1) ELSE '(' || k || ')' END AS code FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)")
def alias_code_suffix(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    d = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(w).alias("k"))
    return d.select(F.col("s_nationkey").alias("org"), F.col("s_suppkey").alias("alias"), sp.code(F.lit("公司"), F.col("s_nationkey"), F.col("k")).alias("code"))


@query(f"WITH {_HITS} SELECT h.doc_id, ord, surface FROM hits h ANTI JOIN (SELECT doc_id, min(start) AS start FROM hits GROUP BY doc_id) e USING (doc_id, start)")
def exception_anti(spark, sf_dir):
    s = _spans(spark, sf_dir)
    first = s.groupBy("doc_id").agg(F.min("start").alias("start"))
    return linking.without_exceptions(s, first, ["doc_id", "start"]).select("doc_id", "ord", "surface")


@query("SELECT l_orderkey AS sheet, l_linenumber AS col, count(*) AS cells, sum(CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS account_cells FROM lineitem GROUP BY ALL")
def field_hint_join_whole(spark, sf_dir, most=4 << 20):
    """Every column of the table has a header.

    Counts are summed in two steps, each over pieces of bounded size, so that no task holds more groups in a larger table and
    a column of very many cells is counted in several tasks.
    """
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("col"), F.col("l_partkey").cast("string").alias("value"))
    heads = cells.select("col").distinct().withColumn("header", F.when(F.col("col") % 3 == 1, "银行账号").otherwise("数量"))
    told = linking.with_headers(cells, F.broadcast(heads), ["col"]).select("sheet", "col", (F.xxhash64("value") % 64).alias("part"), F.col("hint").eqNullSafe("账号").cast("long").alias("account"))
    parts = dealt(told, most, "sheet", "col", "part", of=cells).groupBy("sheet", "col", "part").agg(F.count("*").alias("cells"), F.sum("account").alias("account_cells"))
    return dealt(parts, most, "sheet", "col", of=cells).groupBy("sheet", "col").agg(F.sum("cells").alias("cells"), F.sum("account_cells").alias("account_cells"))


@query(f"SELECT doc_id, i - 1 AS ord, c[i] AS constant FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(formula, '\"((?:[^\"]|\"\")*)\"', 1) AS c FROM ({_FX_FORMULA})))")
def formula_constants(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_FORMULA).select("doc_id", F.posexplode(rules.formula_constants(F.col("formula"))).alias("ord", "constant")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT doc_id, md5(text) AS expected, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE md5(text || '!') END AS actual FROM documents WHERE (doc_id % 89 = 0 OR doc_id % 97 = 0) AND text IS NOT NULL")
def writeback_diff_whole(spark, sf_dir):
    """Whole texts are compared, which differ behind their last character; their digests are returned."""
    e = table(spark, sf_dir, "documents").select("doc_id", "text")
    a = e.where("doc_id % 97 <> 0").withColumn("text", F.when(F.col("doc_id") % 89 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return masking.write_back_issues(e, a, ["doc_id"]).select("doc_id", digest("expected"), digest("actual"))


@query(f"""WITH {_HITS}, t AS (SELECT doc_id, start, start + length(surface) AS stop, 'X' AS l FROM hits),
f AS (SELECT doc_id, start, stop, CASE WHEN start % 5 = 0 THEN 'Y' ELSE 'X' END AS l FROM t WHERE start % 3 <> 0 UNION ALL SELECT doc_id, -1, 0, 'X' FROM t GROUP BY doc_id)
SELECT doc_id, count(t.l) AS expected, count(f.l) AS found, count(*) FILTER (f.l IS NULL) AS missed, count(*) FILTER (t.l IS NULL) AS false_hit, count(*) FILTER (t.l <> f.l) AS wrong_label
FROM t FULL JOIN f USING (doc_id, start, stop) GROUP BY doc_id""")
def evaluation_counts(spark, sf_dir):
    t = _spans(spark, sf_dir).select("doc_id", "start", (F.col("start") + F.length("surface")).alias("end"), F.lit("X").alias("label"))
    f = t.where("start % 3 <> 0").withColumn("label", F.when(F.col("start") % 5 == 0, "Y").otherwise("X"))
    f = f.unionByName(t.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("X").alias("label")))
    return masking.evaluation(t, f)


@query("SELECT doc_id, b.block, o - b.base AS in_block FROM (SELECT doc_id, unnest(range(0, length(text), 500)) AS o FROM documents) x JOIN (SELECT doc_id, block, CAST(coalesce(sum(len + 1) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, len FROM (SELECT doc_id, i - 1 AS block, length(l[i]) AS len FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))) b USING (doc_id) WHERE o >= b.base AND o <= b.base + b.len")
def offset_to_block(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    blocks = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "line")).select("doc_id", F.col("block").cast("long").alias("block"), F.length("line").cast("long").alias("len"))
    offsets = d.where(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(500))).alias("o")).withColumn("o", F.col("o").cast("long"))
    return linking.to_blocks(offsets, blocks).select("doc_id", "block", "in_block")


@query(f"WITH {_HITS}, n AS (SELECT surface, count(*) AS n FROM hits GROUP BY surface), r AS (SELECT surface, n, sum(length(surface) + 1) OVER (ORDER BY n DESC, surface ROWS UNBOUNDED PRECEDING) AS used FROM n) SELECT surface, n, CAST(used AS BIGINT) AS used FROM r WHERE used <= 800")
def known_entity_budget(spark, sf_dir):
    n = _spans(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("n"))
    return linking.within_budget(n, "surface", "n", 800)


@query("SELECT doc_id, code, count(*) AS originals FROM (SELECT o_custkey AS doc_id, '[金额' || (o_orderkey % 7) || ']' AS code FROM orders) GROUP BY ALL HAVING count(*) > 1")
def mapping_v1_ambiguous(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), sp.code(F.lit("金额"), F.col("o_orderkey") % 7).alias("code"), F.col("o_orderkey").alias("surface"))
    return codes.ambiguous(d)


@query("SELECT page_id, url, rtrim(regexp_replace(url, '[?#].*', ''), '/') || '/v1' AS base FROM pages")
def api_base_normalized(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", rules.api_base(F.regexp_replace("url", "[?#].*", "")).alias("base"))


# --- derived texts through the shipped path ---------------------------------------------------------------------------------


#: Bytes of a file that become one task of masking: some 50,000 derived rows.
MOST = 1 << 17


def _masked_fx(spark: SparkSession, sf_dir: str, sql: str, options: Options) -> DataFrame:
    """Derived texts masked and restored. They are a few bytes each in their file and cost some 100 microseconds, so they are
    dealt out over all cores whatever the file's row groups."""
    texts = _fx(spark, sf_dir, sql).select("doc_id", "text")
    done = masking.restored(masking.masked(dealt(texts, MOST, "doc_id", "text"), options))
    return done.select("doc_id", "masked", F.col("restored").alias("restored"))


_FX_TWO_AMOUNTS = "SELECT o_orderkey AS doc_id, concat('总额', cast(cast(o_totalprice AS decimal(20,2))*100 AS varchar(30)), '元，余额', cast(cast(o_totalprice AS decimal(20,2))*100 + 1000 AS varchar(30)), '元，数量', cast(o_orderkey AS varchar(20)), '。') AS text FROM orders"


@query(f"""WITH t AS (SELECT doc_id, text, CAST(regexp_extract(text, '^总额([0-9.]+)', 1) AS DECIMAL(24,2)) AS a FROM ({_FX_TWO_AMOUNTS})),
f AS (SELECT *, CASE WHEN a >= 1000000 THEN CAST(CAST(round_even(a, -6) / 10000 AS BIGINT) AS VARCHAR) || '万余元' END AS x, CASE WHEN a + 1000 >= 1000000 THEN CAST(CAST(round_even(a + 1000, -6) / 10000 AS BIGINT) AS VARCHAR) || '万余元' END AS y FROM t)
SELECT doc_id, '总额' || coalesce(x, CAST(a AS VARCHAR) || '元') || '，余额' || coalesce(y || CASE WHEN x = y THEN '①' ELSE '' END, CAST(a + 1000 AS VARCHAR) || '元') || '，数量' || doc_id || '。' AS masked, text AS restored FROM f""")
def masked_amounts(spark, sf_dir):
    """Two amounts a text, mostly of one coarse form."""
    return _masked_fx(spark, sf_dir, _FX_TWO_AMOUNTS, Options(mode="regex", amounts=True))


@query(f"SELECT doc_id, '签订于[日期1]，[日期2]生效' AS masked, text AS restored FROM ({_FX_DATE})")
def masked_exact_dates(spark, sf_dir):
    return _masked_fx(spark, sf_dir, _FX_DATE, Options(mode="regex", exact_dates=True))


_FX_TOLD_ID = f"SELECT doc_id, concat('编号', id, CASE WHEN doc_id % 2 = 0 THEN '，身份证号：' ELSE '，序号' END, id, '。') AS text FROM ({_FX_ID}) x"


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '^编号([0-9]{{17}}[0-9X])', 1) AS id FROM ({_FX_TOLD_ID})),
k AS (SELECT *, try_strptime(substr(id, 7, 8), '%Y%m%d') IS NOT NULL AND substr('10X98765432', CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(id[i] AS INT) * ([7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2])[i])) % 11 + 1 AS INT), 1) = id[18] AS ok FROM t),
r AS (SELECT *, (31 - list_sum(list_transform(range(1, 18), lambda i: (instr('{rules.CREDIT_CHARS}', id[i]) - 1) * ({list(rules.CREDIT_WEIGHTS)})[i])) % 31) % 31 = instr('{rules.CREDIT_CHARS}', id[18]) - 1 AS credit FROM k),
c AS (SELECT *, CASE WHEN ok THEN '[证件1]' WHEN credit THEN '[信用代码1]' WHEN id[18] <> 'X' THEN '[账号1]' ELSE '[账号1]X' END AS plain, CASE WHEN doc_id % 2 = 0 THEN '[证件1]' ELSE plain END AS told FROM r)
SELECT doc_id, '编号' || plain || CASE WHEN doc_id % 2 = 0 THEN '，身份证号：' ELSE '，序号' END || told || '。' AS masked, text AS restored FROM c""")
def masked_ids(spark, sf_dir):
    """ID numbers with a right and a wrong check character, once bare and once behind their field's name.

    A bare one that fails is what its digits still are: a credit code, or a number of 16 to 19 digits.
    """
    return _masked_fx(spark, sf_dir, _FX_TOLD_ID, Options(mode="regex"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS col, CASE WHEN l_linenumber % 3 = 1 THEN '[账号1]' WHEN l_linenumber % 3 = 2 AND l_extendedprice * 100 >= 1000000 THEN CAST(CAST(round_even(CAST(l_extendedprice AS DECIMAL(20,2)) * 100, -6) / 10000 AS BIGINT) AS VARCHAR) || '万余元'
  WHEN l_linenumber % 3 = 2 THEN CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * 100 AS VARCHAR) ELSE CAST(100000 + l_partkey AS VARCHAR) END AS masked, l_partkey AS part FROM lineitem""")
def masked_cells_by_header(spark, sf_dir):
    """Every cell of a wide table by its own column's header: accounts and large amounts are masked, quantities stay."""
    value = F.when(F.col("l_linenumber") % 3 == 2, (F.col("l_extendedprice").cast("decimal(20,2)") * 100).cast("decimal(24,2)").cast("string")).otherwise((F.col("l_partkey") + 100_000).cast("string"))
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("col"), F.col("l_partkey").alias("part"), value.alias("text"))
    header = F.when(F.col("col") % 3 == 1, "银行账号").when(F.col("col") % 3 == 2, "合同金额").otherwise("数量")
    told = linking.with_headers(cells, F.broadcast(cells.select("col").distinct().withColumn("header", header)), ["col"])
    told = dealt(told, 8 * MOST, "doc_id", "col", "part", "text", of=cells)
    return masking.masked(told, Options(mode="regex", amounts=True), hint="hint").select("doc_id", "col", "masked", "part")


# --- more rules and operators over derived rows ----------------------------------------------------------------------------

_FX_LANDLINE = "SELECT s_suppkey AS doc_id, concat('总机010-', cast(60000000 + s_suppkey AS varchar(10)), CASE WHEN s_suppkey % 2 = 0 THEN concat('-', cast(s_suppkey % 90 + 10 AS varchar(4))) ELSE '' END, '。') AS text FROM supplier"
_of_rule("landline_hits", _FX_LANDLINE, rules.LANDLINE, "0[0-9]{2,3}-[0-9]{7,8}(?:-[0-9]{1,6})?")

_FX_SPACED = f"SELECT doc_id, concat('证件', substr(id, 1, 6), ' ', substr(id, 7, 8), '-', substr(id, 15, 4), '止') AS text FROM ({_FX_ID}) x"
_of_rule("id_with_separators", _FX_SPACED, rules.ID_CARD, "[0-9]{6}[ -]?[0-9]{8}[ -]?[0-9]{3}[0-9Xx]", "try_strptime(substr(replace(replace(x, ' ', ''), '-', ''), 7, 8), '%Y%m%d') IS NOT NULL")

_FX_CREDIT = "SELECT s_suppkey AS doc_id, concat('91350100M000', lpad(cast(s_suppkey % 100000 AS varchar(5)), 5, '0'), substr('0123456789ABCDEFGHJKLMNPQRTUWXY', CAST(1 + s_suppkey % 31 AS INT), 1)) AS c FROM supplier"


@query(f"""SELECT doc_id, c, substr('{rules.CREDIT_CHARS}', CAST((31 - list_sum(list_transform(range(1, 18), lambda i: (instr('{rules.CREDIT_CHARS}', c[i]) - 1) * ({list(rules.CREDIT_WEIGHTS)})[i])) % 31) % 31 + 1 AS INT), 1) = c[18] AS ok FROM ({_FX_CREDIT})""")
def credit_checksum(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_CREDIT).select("doc_id", "c", rules.credit_checksum_ok(F.col("c")).alias("ok"))


_FX_ADDRESS = "SELECT s_suppkey AS doc_id, concat('山西省运城市', n_name, '县城关镇', cast(s_suppkey AS varchar(8)), '村') AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT doc_id, substr(address, 1, i) AS fragment FROM (SELECT doc_id, address, unnest(range(1, length(address) + 1)) AS i FROM ({_FX_ADDRESS})) WHERE substr(address, i, 1) IN ('省','市','区','县','镇','乡','村')")
def address_fragments(spark, sf_dir):
    return _fx(spark, sf_dir, _FX_ADDRESS).select("doc_id", F.explode(rules.address_fragments(F.col("address"))).alias("fragment"))


@query("SELECT o_orderkey AS row, CAST(CAST(o_orderkey + 1 AS DECIMAL(20,0)) * 1000000000000000 AS VARCHAR) AS digits FROM orders")
def full_digit_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.concat((F.col("o_orderkey") + 1).cast("string"), F.lit("E15")).alias("cell"))
    return d.select("row", rules.full_digits(F.col("cell")).alias("digits"))


@query(f"{_NUMBERED} SELECT doc_id, 2 AS version, '[X' || n || ']' AS code, surface FROM c")
def mapping_json_round_trip(spark, sf_dir):
    rows = _numbers(spark, sf_dir).select("doc_id", sp.code(F.lit("X"), F.col("n")).alias("code"), "surface", "label")
    return codes.mapping_read(codes.mapping_json(rows))


@query(f"{_NUMBERED} SELECT doc_id, 'X' AS label, max(n) AS last FROM c GROUP BY doc_id")
def code_counters(spark, sf_dir):
    rows = _numbers(spark, sf_dir).select("doc_id", sp.code(F.lit("X"), F.col("n")).alias("code"))
    return codes.counters(rows).select("doc_id", "label", F.col("last").cast("long").alias("last"))


@query(f"WITH i AS (SELECT doc_id, 'a' AS stage FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'b' FROM documents WHERE doc_id % 7 = 0) SELECT doc_id, count(DISTINCT stage) AS unfinished, count(stage) = 0 AS complete FROM documents LEFT JOIN i USING (doc_id) GROUP BY doc_id")
def status_per_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    issue = lambda n, s: d.where(f"doc_id % {n} = 0").select("doc_id", F.lit(s).alias("stage"), F.lit("warning").alias("severity"))
    return masking.status(issue(5, "a").unionByName(issue(7, "b")), d)


@query(f"WITH {_HITS} SELECT DISTINCT doc_id FROM hits WHERE doc_id % 3 = 0")
def zero_code_gate(spark, sf_dir):
    """Documents with hits of a rule and no code: here those whose codes were left out."""
    found = _spans(spark, sf_dir).select("doc_id").distinct()
    return found.join(_numbers(spark, sf_dir).where("doc_id % 3 <> 0").select("doc_id").distinct(), "doc_id", "left_anti")


@query(f"WITH {_HITS} SELECT doc_id, start + 1 AS start FROM hits WHERE (doc_id, start + 1) NOT IN (SELECT (doc_id, start) FROM hits)")
def exceptions_unlocated(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return linking.unlocated(s.select("doc_id", (F.col("start") + 1).alias("start")), s, ["doc_id", "start"])


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def document_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'legacy format' WHEN page_id % 4 = 1 THEN 'content is not docx' WHEN page_id % 4 = 3 THEN 'unknown extension' END AS problem FROM pages")
def format_problems(spark, sf_dir):
    from maskloom.sources.files import checked

    d = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*(F.lit(x) for x in ("doc", "docx", "txt", "bin"))), (F.col("page_id") % 4 + 1).cast("int")).alias("format"), F.col("html").cast("binary").alias("content"))
    return checked(d).select("page_id", "problem")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE NOT regexp_full_match(text, '[\\s0-9.,%¥$元万亿+-]*')")
def blocks_for_model(spark, sf_dir):
    from maskloom.operators.recognizer import for_model

    return for_model(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query(f"SELECT DISTINCT doc_id, label, surface FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '人名' ELSE '公司' END AS label, regexp_extract(string_split(c, ' ')[1], '^[^\\n\\t]*') AS surface FROM ({_CHUNKS})) WHERE surface <> ''")
def model_answers_whole(spark, sf_dir):
    """Names of an answer for each chunk of each document: a class and the chunk's first word, blank where it begins with none."""
    from maskloom.operators.recognizer import chunks, in_text, parsed, stored

    d = table(spark, sf_dir, "documents")
    batches = chunks(d)
    word = F.regexp_extract(F.get(F.split("c", " "), F.lit(0)), r"^[^\n\t]*", 0)
    kind = F.when(F.col("doc_id") % 2 == 0, "PER").otherwise("ORG")
    answers = batches.select("doc_id", "chunk", F.when(word == "", "").otherwise(F.concat(kind, F.lit("\t"), word, F.lit("\nEND"))).alias("answer"))
    names, _, _ = parsed(stored(batches, answers))
    return in_text(names, d).select("doc_id", "label", "surface")


# --- aliases, relations and associations -------------------------------------------------------------------------------------

_FX_PLACED = "SELECT s_suppkey AS doc_id, concat('北京宏图', cast(s_suppkey AS varchar(8)), '科技有限公司与', CASE WHEN s_suppkey % 3 = 1 THEN '天津' WHEN s_suppkey % 3 = 2 THEN '北京' ELSE '' END, '宏图', cast(s_suppkey AS varchar(8)), '签约。') AS text FROM supplier"


@query(f"SELECT doc_id, '[公司1]与' || CASE WHEN doc_id % 3 = 1 THEN '天津' ELSE '' END || '[公司1]①签约。' AS masked, text AS restored FROM ({_FX_PLACED})")
def masked_place_aliases(spark, sf_dir):
    """An organization named without the place that its full name begins with."""
    return _masked_fx(spark, sf_dir, _FX_PLACED, Options(mode="regex", places=True))


_HOLDS_AT = "[^ \\n]*@[^ \\n]*"


@query(f"""WITH k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS known FROM documents),
c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_HOLDS_AT}')) AS surface FROM documents)
SELECT doc_id, surface FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = c.doc_id AND contains(c.surface, k.known) AND length(c.surface) > length(k.known))""")
def candidates_without_context(spark, sf_dir):
    """Words with an at sign but those that hold a shorter address of their document."""
    d = table(spark, sf_dir, "documents")
    of = lambda pattern: d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("surface"))
    return aliases.without_dirty(of(_HOLDS_AT), of(_EMAIL))


@query("""WITH h AS (SELECT conv_id AS doc_id, turn, role || '-' || turn AS surface, role, 'A' || turn % 3 AS alias FROM conversations),
b AS (SELECT *, lag(role) OVER w AS before, lag(surface) OVER w AS of FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY turn, surface))
SELECT doc_id, alias, arg_min(of, (turn, of)) AS "full" FROM b WHERE before = 'user' GROUP BY doc_id, alias""")
def aliases_bound(spark, sf_dir):
    """Each turn declares an alias for the turn before it, which counts as an organization if it is a user's."""
    turn = F.col("turn").cast("string")
    label = F.when(F.col("role") == "user", "公司").otherwise("人名")
    alias = F.concat(F.lit("A"), (F.col("turn") % 3).cast("string"))
    hits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("start"), F.concat("role", F.lit("-"), turn).alias("surface"), label.alias("label"), alias.alias("alias"))
    return aliases.declared_to(hits)


@query("""SELECT o_custkey AS doc_id, o_orderkey AS surface, coalesce(new, o_orderkey % 7) AS org_id FROM orders
LEFT JOIN (SELECT c_custkey, c_custkey % 7 AS old, c_custkey % 5 AS new FROM customer) ON c_custkey = o_custkey AND old = o_orderkey % 7""")
def variants_moved(spark, sf_dir):
    """Orders as variants of a customer's organizations, one of which moves to another."""
    names = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("surface"), (F.col("o_orderkey") % 7).alias("org_id"))
    moves = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 7).alias("old"), (F.col("c_custkey") % 5).alias("new"))
    return aliases.moved(names, moves)


@query("""WITH n AS (SELECT l_orderkey AS doc_id, l_returnflag AS surface, CAST(l_linenumber AS BIGINT) AS org_id FROM lineitem),
m AS (SELECT o_orderkey AS doc_id, (['A', 'N', 'R', 'X'])[o_custkey % 4 + 1] AS surface, min(o_custkey) AS org_id FROM orders GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = m.doc_id AND n.surface = m.surface)""")
def aliases_registered(spark, sf_dir):
    """An order's return flags, and one more where its lines don't have it yet."""
    names = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("surface"), F.col("l_linenumber").cast("long").alias("org_id"))
    flags = F.array(*(F.lit(x) for x in ("A", "N", "R", "X")))
    more = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.get(flags, (F.col("o_custkey") % 4).cast("int")).alias("surface"), F.col("o_custkey").cast("long").alias("org_id"))
    return aliases.registered(names, more)


@query(f"SELECT doc_id, chunk, lang AS surface, source AS other FROM ({_CHUNKS}) JOIN documents USING (doc_id) WHERE contains(c, lang) OR contains(c, source)")
def relations_of_chunks(spark, sf_dir):
    """A relation a document, carried by the chunks that name either side."""
    from maskloom.operators.recognizer import chunks, relations_of

    d = table(spark, sf_dir, "documents")
    return relations_of(chunks(d), d.select("doc_id", F.col("lang").alias("surface"), F.col("source").alias("other")))


@query(f"""WITH {_HITS}, n AS (SELECT doc_id, length(surface) % 3 AS org, start % 4 AS code, count(*) AS n FROM hits GROUP BY ALL),
m AS (SELECT doc_id, sum(rest) AS merged FROM (SELECT doc_id, sum(n) - max(n) AS rest FROM n GROUP BY doc_id, code) GROUP BY doc_id),
s AS (SELECT doc_id, sum(rest) AS split FROM (SELECT doc_id, sum(n) - max(n) AS rest FROM n GROUP BY doc_id, org) GROUP BY doc_id)
SELECT doc_id, CAST(merged AS BIGINT) AS merged, CAST(split AS BIGINT) AS split FROM m JOIN s USING (doc_id)""")
def wrong_associations(spark, sf_dir):
    """Spans whose code stands mostly for another organization, and whose organization has mostly another code."""
    s = _spans(spark, sf_dir).withColumn("end", F.col("start") + F.length("surface"))
    truth = s.select("doc_id", "start", "end", (F.length("surface") % 3).alias("org"))
    return masking.associations(truth, s.select("doc_id", "start", "end", (F.col("start") % 4).alias("code")))


@query("SELECT l_orderkey AS doc_id, median(CAST(l_quantity AS DOUBLE)) AS median FROM lineitem GROUP BY l_orderkey")
def median_of_runs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.median(F.col("l_quantity").cast("double")).alias("median"))


@query("SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS surface FROM documents INTERSECT SELECT unnest(regexp_extract_all(html, '[0-9]+')) FROM pages")
def numbers_in_both(spark, sf_dir):
    """Numbers that documents and pages share."""
    of = lambda name, text: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))).alias("surface"))
    return of("documents", "text").intersect(of("pages", "html"))
