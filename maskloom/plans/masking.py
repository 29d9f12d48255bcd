"""Masking, restoring, verifying and evaluating collections of documents.

The text path is one narrow pass of native expressions: spans, their choice, codes, mapping and masked text are arrays and
maps in the document's row, so it works alike on a stream. A document is worked on by its own evidence alone.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import orgs, rules
from maskloom.functions import spans as sp
from maskloom.functions.spans import let, running
from maskloom.options import Options

#: Codes of full names come before those of aliases, which share their number.
ORG_LABEL = "公司"


def _has_form(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\x{4e00}-\x{9fa5}]")) & F.rlike(text, F.lit("|".join(orgs.FORMS)))


_NO_ORGS = "array<struct<surface:string,full:string,k:int>>"


def org_surfaces(text: Column, options: Options = Options()) -> Column:
    """(surface, full, kind) of organizations, aliases declared and peeled; of a surface the first. None in a text without a legal form.

    With options.places also what is left of a peeled name without its place, if it may be an alias.
    """

    def every(names: Column) -> Column:
        full = F.transform(names, lambda n: F.struct(n.alias("surface"), n.alias("full"), F.lit(0).alias("k")))
        said = F.transform(orgs.declared(text), lambda p: F.struct(p["alias"].alias("surface"), p["full"].alias("full"), F.lit(1).alias("k")))
        short = F.filter(F.transform(names, lambda n: F.struct(orgs.peeled(n).alias("surface"), n.alias("full"), F.lit(2).alias("k"))), lambda s: (F.length(s["surface"]) >= 2) & (s["surface"] != s["full"]))
        if not options.places:
            return F.concat(full, said, short)
        bare = F.transform(names, lambda n: F.struct(orgs.unplaced(orgs.peeled(n), options.more_places).alias("surface"), n.alias("full"), F.lit(3).alias("k")))
        return F.concat(full, said, short, F.filter(bare, lambda s: orgs.alias_like(s["surface"], options.more_places) & (s["surface"] != s["full"])))

    def first_of_each(v: Column) -> Column:
        names = F.transform(v, lambda s: s["surface"])
        return let(names, lambda n: F.filter(v, lambda s, i: F.array_position(n, s["surface"]) == i + 1))

    return F.when(_has_form(text), let(let(orgs.full_names(text), every), first_of_each)).otherwise(F.array().cast(_NO_ORGS))


#: In texts of so few bytes, as cells have, it is first asked whether any fixed format occurs.
SHORT = 64


def spans_of(text: Column, options: Options, named: Column | None = None, owners: Column | None = None, hint: Column | None = None) -> Column:
    """All candidate spans. named: array<struct<surface, label>> that a recognizer gave for the text; owners: its org_surfaces;
    hint: the field that a cell's own column header names.

    ID numbers and credit codes need their check character, unless their field is named right before them or by the header.
    """
    plain = tuple(r for r in rules.FIXED if r.name not in rules.CHECKSUMS) + (rules.LABELLED_ID, rules.LABELLED_CREDIT)
    told = lambda r: F.filter(sp.found(text, r), lambda s: rules.CHECKSUMS[r.name](s["surface"]))
    every = F.concat(sp.all_found(text, plain), *(told(r) for r in rules.FIXED if r.name in rules.CHECKSUMS))
    fixed = (*rules.FIXED, rules.LABELLED_ID, rules.LABELLED_CREDIT)
    out = F.when((F.octet_length(text) > SHORT) | sp.any_hit(text, fixed), every).otherwise(sp.none())
    if hint is not None:
        out = F.concat(out, hinted(text, hint, options))
    if options.dates and options.exact_dates:
        real = lambda s: rules.valid_date(s["surface"])
        out = F.concat(out, F.filter(sp.found(text, rules.DATE), real), F.filter(sp.found(text, rules.MONTH), real))
    if options.amounts:
        large = lambda s: F.coalesce(rules.amount_value(s["surface"]) >= rules.LEAST_AMOUNT, F.lit(True))  # noqa: E731  one too long for a number is large
        out = F.concat(out, F.filter(sp.found(text, rules.AMOUNT), large))
    if options.mode == "regex":
        surfaces = org_surfaces(text, options) if owners is None else owners
        out = F.concat(out, F.flatten(F.transform(surfaces, lambda s: sp.located(text, s["surface"], F.lit(ORG_LABEL), "org", 100))))
    if named is not None:
        out = F.concat(out, F.flatten(F.transform(F.coalesce(named, F.array().cast("array<struct<surface:string,label:string>>")), lambda s: sp.located(text, s["surface"], s["label"], "model", 120))))
    return out


def hinted(text: Column, hint: Column, options: Options) -> Column:
    """A cell that is a number as a whole, as the span that its column's header says it is; other cells have none.

    Of amounts only those from a million on, and only where amounts are masked.
    """
    bare = F.trim(text)
    start = F.length(text) - F.length(F.ltrim(text))
    number = ((hint == "账号") & F.rlike(bare, F.lit("^[0-9][0-9 -]{4,28}[0-9]$"))) | ((hint == "证件") & F.rlike(bare, F.lit("^[0-9]{6}[ -]?[0-9]{8}[ -]?[0-9]{3}[0-9Xx]$")))
    if options.amounts:
        large = F.coalesce(rules.amount_value(bare) >= rules.LEAST_AMOUNT, F.lit(True))
        number = number | ((hint == rules.AMOUNT.label) & F.rlike(bare, F.lit(r"^[0-9][0-9,]*(?:\.[0-9]+)?(?:美元|欧元|港元|元)?$")) & large)
    one = F.struct(start.cast("int").alias("start"), (start + F.length(bare)).cast("int").alias("end"), bare.alias("surface"), hint.alias("label"), F.lit("header").alias("source"), F.lit(5).alias("prio"))
    return F.when(number, F.array(one)).otherwise(sp.none()).cast(sp.NO_SPANS)


def above(text: Column) -> Column:
    """The greatest number of anything in the text that looks like a code: numbering starts above it."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\[\]0-9]+([0-9]{1,6})\]"), F.lit(1)), lambda n: n.cast("int"))), F.lit(0))


def numbered(chosen: Column, start: Column, owners: Column | None = None) -> Column:
    """struct<codes, which>: (label, surface, full, n, k) of each surface in order of first position, and each span's place there.

    An alias has its full name's n, and k from 1. By sorting, so many spans cost little more than few; very few are compared pair by pair.
    """
    own = lambda s: s["surface"] if owners is None else F.coalesce(F.get(F.filter(owners, lambda o: o["surface"] == s["surface"]), F.lit(0))["full"], s["surface"])
    numbers = lambda size: F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    plus = lambda a, x: a + x

    def firsts(v: Column) -> Column:
        """Of each span the place of the first of its label and surface."""
        keyed = F.array_sort(F.transform(v, lambda s, i: F.struct(F.concat(s["label"], F.lit("\x01"), s["surface"]).alias("key"), i.alias("i"))))
        new = lambda o: F.transform(o, lambda x, j: F.when((j == 0) | (F.get(o, j - 1)["key"] != x["key"]), x["i"]).otherwise(-1))
        back = lambda o, f: F.transform(F.array_sort(F.transform(o, lambda x, j: F.struct(x["i"].alias("i"), F.get(f, j).alias("f")))), lambda y: y["f"])
        return let(keyed, lambda o: let(sp.last_set(new(o)), lambda f: back(o, f)))

    def families(v: Column, f: Column) -> Column:
        """(i, label, surface, full, fam, k) of each surface by first place i; fam is the first place of any of its full name's."""
        one = lambda s, i: F.struct(s["label"].alias("label"), own(s).alias("full"), i.alias("i"), s["surface"].alias("surface"))
        entries = F.array_sort(F.transform(F.filter(numbers(F.size(v)), lambda i: F.get(f, i) == i), lambda i: one(F.get(v, i), i)))
        alias = lambda x: (x["surface"] != x["full"]).cast("int")

        def grouped(e: Column, count: Column) -> Column:
            new = lambda x, j: (j == 0) | (F.get(e, j - 1)["label"] != x["label"]) | (F.get(e, j - 1)["full"] != x["full"])
            fam = sp.last_set(F.transform(e, lambda x, j: F.when(new(x, j), x["i"]).otherwise(-1)))
            base = sp.last_set(F.transform(e, lambda x, j: F.when(new(x, j), F.get(count, j) - alias(x)).otherwise(-1)))
            row = lambda x, j, g, b: F.struct(x["i"].alias("i"), x["label"].alias("label"), x["surface"].alias("surface"), x["full"].alias("full"), F.get(g, j).alias("fam"), F.when(alias(x) == 1, F.get(count, j) - F.get(b, j)).otherwise(0).alias("k"))
            return let(fam, lambda g: let(base, lambda b: F.array_sort(F.transform(e, lambda x, j: row(x, j, g, b)))))

        return let(entries, lambda e: let(running(F.transform(e, alias), plus, F.lit(0)), lambda count: grouped(e, count)))

    def by_place(r: Column, f: Column, above_all: Column) -> Column:
        """At the first place of each full name its number, elsewhere 0."""
        heads = F.array_sort(F.transform(F.filter(r, lambda x: x["i"] == x["fam"]), lambda x: F.struct(x["label"].alias("label"), x["i"].alias("i"))))
        begins = lambda h: sp.last_set(F.transform(h, lambda x, j: F.when((j == 0) | (F.get(h, j - 1)["label"] != x["label"]), j).otherwise(-1)))
        pair = lambda i, n: F.struct(i.cast("int").alias("i"), n.cast("int").alias("n"))
        counted = let(heads, lambda h: let(begins(h), lambda b: F.transform(h, lambda x, j: pair(x["i"], above_all + 1 + j - F.get(b, j)))))
        rest = F.transform(F.filter(r, lambda x: x["i"] != x["fam"]), lambda x: pair(x["i"], F.lit(0)))
        again = F.transform(F.filter(numbers(F.size(f)), lambda i: F.get(f, i) != i), lambda i: pair(i, F.lit(0)))
        return F.transform(F.array_sort(F.concat(counted, rest, again)), lambda x: x["n"])

    def made(v: Column, f: Column, r: Column, above_all: Column) -> Column:
        code = lambda x, n: F.struct(x["label"].alias("label"), x["surface"].alias("surface"), x["full"].alias("full"), F.get(n, x["fam"]).cast("int").alias("n"), x["k"].cast("int").alias("k"))
        codes = let(by_place(r, f, above_all), lambda n: F.transform(r, lambda x: code(x, n)))
        seen = running(F.transform(f, lambda x, i: (x == i).cast("int")), plus, F.lit(0))
        return F.struct(codes.alias("codes"), let(seen, lambda c: F.transform(f, lambda x: F.get(c, x) - 1)).alias("which"))

    def few(v: Column) -> Column:
        """The same for very few spans."""
        key = F.transform(v, lambda s: F.concat(s["label"], F.lit("\x01"), s["surface"]))
        first = let(key, lambda q: F.transform(q, lambda x: F.array_position(q, x).cast("int") - 1))
        entry = lambda s, i: F.struct(i.alias("i"), s["label"].alias("label"), s["surface"].alias("surface"), own(s).alias("full"))
        entries = lambda f: F.filter(F.transform(v, entry), lambda x: F.get(f, x["i"]) == x["i"])
        kin = lambda x, y: (y["label"] == x["label"]) & (y["full"] == x["full"])
        before = lambda e, x: F.size(F.filter(e, lambda y: kin(x, y) & (y["surface"] != y["full"]) & (y["i"] <= x["i"])))
        fam = lambda e, x: F.get(F.filter(e, lambda y: kin(x, y)), F.lit(0))["i"]
        grouped = lambda e: F.transform(e, lambda x: F.struct(*(x[c].alias(c) for c in ("i", "label", "surface", "full")), fam(e, x).alias("fam"), F.when(x["surface"] != x["full"], before(e, x)).otherwise(0).alias("k")))
        single = lambda e: F.transform(e, lambda x: F.struct(*(x[c].alias(c) for c in ("i", "label", "surface", "full")), x["i"].alias("fam"), F.lit(0).alias("k")))
        families = lambda e: single(e) if owners is None else F.when(F.size(owners) == 0, single(e)).otherwise(grouped(e))
        n = lambda r, x: F.size(F.filter(r, lambda y: (y["i"] == y["fam"]) & (y["label"] == x["label"]) & (y["i"] <= x["fam"])))
        code = lambda r, x, a: F.struct(x["label"].alias("label"), x["surface"].alias("surface"), x["full"].alias("full"), (a + n(r, x)).cast("int").alias("n"), x["k"].cast("int").alias("k"))
        codes = lambda r: let(start, lambda a: F.transform(r, lambda x: code(r, x, a)))
        which = lambda r, f: let(F.transform(r, lambda x: x["i"]), lambda at: F.transform(f, lambda i: F.array_position(at, i).cast("int") - 1))
        return let(first, lambda f: let(let(entries(f), families), lambda r: F.struct(codes(r).alias("codes"), which(r, f).alias("which"))))

    many = lambda v: let(firsts(v), lambda f: let(families(v, f), lambda r: let(start, lambda a: made(v, f, r, a))))
    return let(chosen, lambda v: F.when(F.size(v) <= FEW, few(v)).otherwise(many(v)))


#: So many spans are numbered pair by pair.
FEW = 6


def _amounts_above(text: Column) -> Column:
    """Where the suffixes of a text's amounts start: above those of coarse forms that it has itself, and at 1 if a suffix follows an amount."""
    own = F.regexp_extract_all(text, F.lit(rf"{sp.COARSE}({sp.SUFFIX}?)"), F.lit(1))
    used = F.transform(own, lambda s: F.when(s == "", 0).when(F.substr(s, F.lit(1), F.lit(1)) == "(", F.coalesce(F.regexp_extract(s, r"^\(([0-9]{1,6})\)$", 1).try_cast("int"), F.lit(0))).otherwise(F.position(s, F.lit("①②③④⑤⑥⑦⑧⑨⑩"))))
    follows = F.rlike(text, F.lit(rf"(?:{rules.AMOUNT.pattern}){sp.SUFFIX}"))
    any_used = F.greatest(F.coalesce(F.array_max(used) + 1, F.lit(0)), F.coalesce(follows.cast("int"), F.lit(0)))
    return F.when(F.rlike(text, F.lit(f"万余|{sp.SUFFIX}")), any_used).otherwise(0)


def amounts_coded(codes: Column, text: Column) -> Column:
    """(i, code) of the amounts among codes, i their place there: the coarse form, and a suffix where several amounts share it."""
    coarse = lambda c: F.coalesce(rules.amount_masked(rules.amount_value(c["surface"]), rules.amount_currency(c["surface"]), rules.LEAST_AMOUNT), sp.code(c["label"], c["n"]))
    every = F.filter(F.transform(codes, lambda c, i: F.when(c["label"] == rules.AMOUNT.label, F.struct(coarse(c).alias("made"), i.alias("i"), c["surface"].alias("surface")))), F.isnotnull)

    def told_apart(o: Column, start: Column) -> Column:
        begins = sp.last_set(F.transform(o, lambda x, j: F.when((j == 0) | (F.get(o, j - 1)["made"] != x["made"]), j).otherwise(-1)))
        return let(begins, lambda b: F.transform(o, lambda x, j: F.struct(x["i"].alias("i"), F.concat(x["made"], sp.suffix(start + j - F.get(b, j))).alias("code"))))

    some = let(F.array_sort(every), lambda o: let(_amounts_above(text), lambda start: told_apart(o, start)))
    return F.when(F.exists(codes, lambda c: c["label"] == rules.AMOUNT.label), some).otherwise(F.array().cast("array<struct<i:int,code:string>>"))


def masked(documents: DataFrame, options: Options | None = None, *, named: str | None = None, hint: str | None = None) -> DataFrame:
    """doc_id, text, spans (chosen), codes, mapping (code to surface), masked, edits (year masks), issues.

    An amount's code is its coarse form, such as 300万余元 and 300万余元①; below a million amounts stay.

    hint: a column of documents with the field that a cell's column header names (``linking.with_headers``), or null.
    named: a column of documents with what a recognizer found, array<struct<surface, label>>. In llm mode without it names
    and addresses are not looked for, which is an issue, as is every range that only partly lost to another.
    """
    d = documents
    for name, column in _columns(options or Options(mode="regex"), named, hint, id(SparkContext._gateway)):
        d = d.withColumn(name, column)
    return d.drop("__owners", "__found", "__numbered", "__codes")


@functools.lru_cache(maxsize=64)
def _columns(options: Options, named: str | None, hint: str | None, gateway: int) -> list[tuple[str, Column]]:
    """The columns that masking adds, one after the other: made once for each choice of options, as they are thousands of calls."""
    text, owners = F.col("text"), None
    out: list[tuple[str, Column]] = []
    if options.mode == "regex":
        out.append(("__owners", org_surfaces(text, options)))
        owners = F.col("__owners")
    out.append(("__found", sp.resolution(spans_of(text, options, F.col(named) if named else None, owners, F.col(hint) if hint else None))))
    out.append(("spans", F.col("__found.kept")))
    out.append(("__numbered", numbered(F.col("spans"), above(text), owners)))
    out.append(("codes", F.col("__numbered.codes")))
    plain = F.transform("codes", lambda c, i: F.struct(i.alias("i"), sp.code(c["label"], c["n"], c["k"]).alias("code")))
    if options.amounts:
        others = F.filter(plain, lambda x: F.get(F.col("codes"), x["i"])["label"] != rules.AMOUNT.label)
        plain = F.array_sort(F.concat(others, amounts_coded(F.col("codes"), text)))
    out.append(("__codes", F.transform(plain, lambda x: x["code"])))
    out.append(("mapping", F.map_from_arrays(F.col("__codes"), F.transform("codes", lambda c: c["surface"]))))
    pieces = let(F.col("__codes"), lambda made: F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(made, F.get(F.col("__numbered.which"), i)).alias("code"))))
    out.append(("masked", sp.spliced(text, pieces)))
    if options.dates:
        out.append(("edits", sp.found(F.col("masked"), rules.Rule("year", "日期", "[0-9]{4}年", 0, 0, "年"))))
        out.append(("masked", rules.year_masked(F.col("masked"))))
    else:
        out.append(("edits", sp.none()))
    issue = lambda stage, severity, message: F.struct(F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    skipped = []
    if named is None:
        skipped.append(issue("names", "warning" if options.mode == "llm" else "info", "names and addresses were not looked for"))
    skipped += [issue(x, "info", f"{x} are switched off") for x, on in (("dates", options.dates), ("amounts", options.amounts)) if not on]
    kind = "array<struct<stage:string,severity:string,message:string>>"
    crossed = F.transform(F.col("__found.crossed"), lambda s: F.struct(F.lit("overlap").alias("stage"), F.lit("warning").alias("severity"), F.concat(F.lit("crossing range at "), s["start"].cast("string")).alias("message")))
    out.append(("issues", F.concat(F.array(*skipped).cast(kind) if skipped else F.array().cast(kind), crossed.cast(kind))))
    return out


def restored(done: DataFrame) -> DataFrame:
    """masked documents with ``restored``: years first, by the positions kept, then codes, in one pass each."""
    years = sp.spliced(F.col("masked"), F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["surface"].alias("code"))))
    return done.withColumn("restored", sp.restored(years, F.col("mapping")))


def write_back_issues(expected: DataFrame, actual: DataFrame, on: list[str], value: str = "text") -> DataFrame:
    """Rows that differ between what was to be written and what was read again, by locator."""
    e, a = expected.select(*on, F.col(value).alias("expected")), actual.select(*on, F.col(value).alias("actual"))
    return e.join(a, on, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def evaluation(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: expected, found, missed, false_hit, wrong_label of annotated spans (doc_id, start, end, label)."""
    keys = ["doc_id", "start", "end"]
    both = truth.select(*keys, F.col("label").alias("t")).join(found.select(*keys, F.col("label").alias("f")), keys, "full_outer")
    return both.groupBy("doc_id").agg(
        F.count("t").alias("expected"), F.count("f").alias("found"), F.count_if(F.col("f").isNull()).alias("missed"),
        F.count_if(F.col("t").isNull()).alias("false_hit"), F.count_if(F.col("t") != F.col("f")).alias("wrong_label"),
    )


def associations(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: merged and split spans, truth being (doc_id, start, end, org) and found (doc_id, start, end, code).

    Of spans in both, merged counts those whose code stands mostly for another organization, and split those whose
    organization has mostly another code; of equal shares one is the main one, which changes no count.
    """
    keys = ["doc_id", "start", "end"]
    pairs = truth.select(*keys, "org").join(found.select(*keys, "code"), keys).groupBy("doc_id", "org", "code").agg(F.count("*").alias("n"))

    def others(of: str) -> DataFrame:
        """Per document the spans outside the main partner of each code or organization."""
        each = pairs.groupBy("doc_id", of).agg((F.sum("n") - F.max("n")).alias("rest"))
        return each.groupBy("doc_id").agg(F.sum("rest").alias("merged" if of == "code" else "split"))

    return others("code").join(others("org"), "doc_id")


def status(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document: complete, or the number of stages that aren't."""
    n = issues.where("severity <> 'info'").groupBy("doc_id").agg(F.countDistinct("stage").alias("unfinished"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("unfinished", F.lit(0)).alias("unfinished"), F.col("unfinished").isNull().alias("complete"))
