"""Spans in a text as arrays in its row: found, chosen among overlaps, replaced, and put back. No step shuffles.

A span is struct<start, end, surface, label, source, prio>, 0-based, end exclusive, in code points. A null text has none.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.rules import CHECKS, Rule, let

SPAN = "struct<start:int,end:int,surface:string,label:string,source:string,prio:int>"
NO_SPANS = f"array<{SPAN}>"


def none() -> Column:
    return F.array().cast(NO_SPANS)


def running(values: Column, op: Callable[[Column, Column], Column], first: Column, kind: str = "int", block: int = 256) -> Column:
    """The running results of an associative op, of which first is neutral. Block by block, so that no long array is copied a step."""
    none_yet = F.array().cast(f"array<{kind}>")

    def of_block(part: Column) -> Column:
        return F.aggregate(part, none_yet, lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, op(F.element_at(a, -1), x)).otherwise(x).cast(kind))))

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(first.cast(kind)), lambda a, p: F.concat(a, F.array(op(F.element_at(a, -1), F.element_at(p, -1)).cast(kind))))
        return let(before, lambda q: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda x: op(F.get(q, b), x).cast(kind)))))

    begins = lambda v: F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = lambda v: F.transform(begins(v), lambda b: of_block(F.slice(v, b + 1, F.lit(block))))
    return let(values, lambda v: F.when(F.size(v) == 1, F.transform(v, lambda x: x.cast(kind))).when(F.size(v) <= block, of_block(v)).otherwise(let(blocks(v), joined)))


def last_set(values: Column) -> Column:
    """Of whole numbers the last one so far that is not negative."""
    return running(values, lambda a, x: F.when(x >= 0, x).otherwise(a), F.lit(-1))


def _span(start: Column, end: Column, surface: Column, label: Column, source: Column, prio: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), surface.alias("surface"), label.alias("label"), source.alias("source"), prio.alias("prio"))


def _cheap(text: Column, rule: Rule) -> Column:
    """Whether a text has what every hit of the rule needs."""
    needs = rule.needs
    return F.rlike(text, F.lit(needs)) if len(needs) > 1 else F.contains(text, F.lit(needs)) if needs else F.lit(True)


def any_hit(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether the pattern of any of several rules occurs. One after the other: as one pattern they are far slower."""
    return functools.reduce(lambda a, b: a | b, (_cheap(text, r) & F.rlike(text, F.lit(r.pattern)) for r in rules))


def _hits(text: Column, rule: Rule, source: str) -> Column:
    """A rule's hits and, if there are any, the gaps between them. A text without what the rule needs isn't searched: null."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    row = lambda h: F.struct(F.lit(rule.label).alias("label"), F.lit(source).alias("source"), F.lit(rule.prio).alias("prio"), h.alias("hits"), F.when(F.size(h) > 0, F.split(text, rule.pattern, -1)).alias("gaps"))
    return F.when(_cheap(text, rule), let(hits, row))


def _walked(r: Column) -> Column:
    """Hit i ends where the gaps and hits up to it end."""
    lengths = F.transform(r["hits"], lambda h, i: F.length(F.get(r["gaps"], i)) + F.length(h))
    ends = running(lengths, lambda a, x: a + x, F.lit(0))
    spans = let(ends, lambda e: F.transform(r["hits"], lambda h, i: _span(F.get(e, i) - F.length(h), F.get(e, i), h, r["label"], r["source"], r["prio"])))
    return F.when(F.size(r["hits"]) > 0, spans).otherwise(none())


def found(text: Column, rule: Rule, source: str = "rule") -> Column:
    """All hits of a rule that pass its check."""
    got = let(_hits(text, rule, source), lambda r: F.when(r.isNotNull(), _walked(r)).otherwise(none()))
    return F.filter(got, lambda s: CHECKS[rule.name](s["surface"])) if rule.name in CHECKS else got


def all_found(text: Column, rules: tuple[Rule, ...], source: str = "rule") -> Column:
    """All hits of several rules."""
    plain = [_hits(text, r, source) for r in rules if r.name not in CHECKS]
    checked = [found(text, r, source) for r in rules if r.name in CHECKS]
    return F.concat(*([F.flatten(F.transform(F.filter(F.array(*plain), F.isnotnull), _walked))] if plain else []), *checked) if rules else none()


def located(text: Column, surface: Column, label: Column, source: str, prio: int) -> Column:
    """All occurrences of a surface, one after the other; an empty or null one has none."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(surface, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    size = F.length(surface)

    def walked(gaps: Column) -> Column:
        lengths = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: F.length(g) + size)
        return F.transform(running(lengths, lambda a, x: a + x, F.lit(0)), lambda e: _span(e - size, e, surface, label, F.lit(source), F.lit(prio)))

    return F.when((size > 0) & F.contains(text, surface), let(F.split(text, quoted, -1), walked)).otherwise(none())


def located_any(text: Column, surfaces: list[str], label: str, source: str = "org", prio: int = 100) -> Column:
    """All occurrences of a list of surfaces in one pass over the text, the longest first where several begin; for lists that fit a plan."""
    quoted = [r"\Q" + x.replace(r"\E", r"\E\\E\Q") + r"\E" for x in sorted({x for x in surfaces if x}, key=lambda x: (-len(x), x))]
    return found(text, Rule("listed", label, "|".join(quoted), 0, prio), source) if quoted else none()


def ordered(spans: Column) -> Column:
    """By start, then precedence, then the longest first, then label."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["prio"].alias("b"), (-s["end"]).alias("c"), s["label"].alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _overlap(s: Column, k: Column) -> Column:
    return (s["start"] < k["end"]) & (k["start"] < s["end"])


def _chosen(island: Column) -> Column:
    """struct<kept, crossed> of spans that overlap in a chain: in order of precedence, then length, then start, each that
    crosses none chosen before; and those that lost against one which they only partly cover."""
    ranked = F.transform(F.array_sort(F.transform(island, lambda s: F.struct(s["prio"].alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["label"].alias("d"), s.alias("s")))), lambda k: k["s"])
    kept = ordered(F.aggregate(ranked, none(), lambda a, s: F.when(F.exists(a, lambda k: _overlap(s, k)), a).otherwise(F.concat(a, F.array(s)))))
    partly = lambda s, k: _overlap(s, k) & ((s["start"] < k["start"]) | (s["end"] > k["end"]))
    both = let(kept, lambda won: F.struct(won.alias("kept"), F.filter(island, lambda s: F.exists(won, lambda k: partly(s, k))).alias("crossed")))
    alone = F.struct(island.alias("kept"), none().alias("crossed"))
    return F.when(F.size(island) > 1, both).otherwise(alone)


def resolution(spans: Column) -> Column:
    """struct<kept, crossed>: the spans without overlap, in order, and those that lost against one which they only partly cover.

    Spans that come in order and apart are kept as they are. Others are swept by start into islands that no span crosses; each
    island is settled by itself, so a long text of many spans costs no more than its spans.
    """

    def settled(v: Column, ends: Column) -> Column:
        begins = F.filter(F.transform(v, lambda s, i: F.when((i == 0) | (F.get(ends, i - 1) <= s["start"]), i)), F.isnotnull)
        parts = lambda b: F.transform(b, lambda at, j: _chosen(F.slice(v, at + 1, F.coalesce(F.get(b, j + 1), F.size(v)) - at)))
        every = lambda q: F.struct(F.flatten(F.transform(q, lambda x: x["kept"])).alias("kept"), F.flatten(F.transform(q, lambda x: x["crossed"])).alias("crossed"))
        return let(begins, lambda b: let(parts(b), every))

    ends = lambda v: running(F.transform(v, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    some = lambda given: let(ordered(given), lambda v: let(ends(v), lambda e: settled(v, e)))
    alone = lambda given: F.struct(given.alias("kept"), none().alias("crossed"))
    meets = lambda given: F.exists(F.transform(given, lambda s, i: (i > 0) & (s["start"] < F.get(given, i - 1)["end"])), lambda x: x)
    return let(spans, lambda given: F.when(F.size(given) == 0, alone(none())).when((F.size(given) > 1) & meets(given), some(given)).otherwise(alone(given)))


def resolved(spans: Column) -> Column:
    """Spans without overlap, by precedence."""
    return resolution(spans)["kept"]


def crossing(spans: Column) -> Column:
    """The spans that lost against one which they only partly cover."""
    return resolution(spans)["crossed"]


def spliced(text: Column, pieces: Column, block: int = 64) -> Column:
    """The text with each piece's range, struct<start, end, code> in order and apart, replaced by its code.

    Some pieces' stretch of the text is cut out first and they are cut from it, as each cut counts characters from its begin.
    """
    end_before = lambda q, i: F.when(i > 0, F.get(q, i - 1)["end"]).otherwise(0)

    def stretch(q: Column, b: Column) -> Column:
        at, n = end_before(q, b), F.least(F.lit(block), F.size(q) - b)
        own = F.substr(text, at + 1, F.get(q, b + n - 1)["end"] - at)
        cut = lambda part: F.transform(F.slice(q, b + 1, n), lambda x, i: F.concat(F.substr(part, end_before(q, b + i) - at + 1, x["start"] - end_before(q, b + i)), x["code"]))
        return let(own, lambda part: F.array_join(cut(part), ""))

    def whole(q: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(q) - 1, F.lit(block)), lambda b: stretch(q, b))
        few = F.transform(q, lambda x, i: F.concat(F.substr(text, end_before(q, i) + 1, x["start"] - end_before(q, i)), x["code"]))
        joined = F.when(F.size(q) <= block, F.array_join(few, "")).otherwise(F.array_join(parts, ""))
        return F.when(F.size(q) > 0, F.concat(joined, F.substr(text, F.element_at(q, -1)["end"] + 1))).otherwise(text)

    return let(pieces, whole)


#: A circled or plain suffix, an amount's coarse form, and a code: a bracketed label and number or such a form, with a suffix.
SUFFIX = r"(?:[①-⑩]|\([0-9]+\))"
COARSE = r"[0-9]+万余(?:美元|欧元|港元|元)"
CODE = rf"(?:\[[^\[\]0-9]+[0-9]+\]|{COARSE}){SUFFIX}?"


def suffix(k: Column) -> Column:
    """① to ⑩, then (11) and so on; none for 0."""
    return F.when(k <= 0, F.lit("")).when(k <= 10, F.substr(F.lit("①②③④⑤⑥⑦⑧⑨⑩"), k, F.lit(1))).otherwise(F.concat(F.lit("("), k.cast("string"), F.lit(")")))


def code(label: Column, n: Column, k: Column | None = None) -> Column:
    base = F.concat(F.lit("["), label, n.cast("string"), F.lit("]"))
    return base if k is None else F.concat(base, suffix(k))


def restored(masked: Column, mapping: Column) -> Column:
    """One pass over the codes of a masked text; a code that the map lacks stays. So [人名1] never cuts [人名10]."""

    def put_back(text: Column, codes: Column) -> Column:
        body = F.transform(F.split(text, CODE, -1), lambda g, i: F.concat(g, F.when(i < F.size(codes), F.coalesce(F.try_element_at(mapping, F.get(codes, i)), F.get(codes, i))).otherwise(F.lit(""))))
        return F.when(F.size(codes) > 0, F.array_join(body, "")).otherwise(text)

    return let(masked, lambda text: let(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), lambda codes: put_back(text, codes)))
