"""Word, Excel and PowerPoint files as blocks, and written again with replaced nodes. Standard library only.

A block is one paragraph (Word, PowerPoint) or one non-empty cell (Excel), with the lengths of its text nodes, so that a
replacement can be spread over the nodes it crosses and all other nodes keep their style. Files are small against a task's
memory; one is read at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

#: Parts of each format that hold paragraphs, and the tags of a paragraph and of its text nodes.
PARTS = {
    "docx": (r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", f"{W}p", f"{W}t"),
    "pptx": (r"ppt/slides/slide\d+\.xml", f"{A}p", f"{A}t"),
}

SCHEMA = "doc_id long, block_id int, kind string, part string, row int, col int, text string, formula string, nodes array<int>"


def _paragraphs(z: zipfile.ZipFile, form: str) -> Iterator[dict]:
    pattern, p, t = PARTS[form]
    for name in sorted(n for n in z.namelist() if re.fullmatch(pattern, n)):
        for i, par in enumerate(ET.fromstring(z.read(name)).iter(p)):
            nodes = [x.text or "" for x in _own(par, p, t)]
            if "".join(nodes):
                yield {"kind": "paragraph", "part": name, "row": i, "col": None, "text": "".join(nodes), "formula": None, "nodes": [len(x) for x in nodes]}


def _own(par: ET.Element, p: str, t: str) -> Iterator[ET.Element]:
    """Text nodes of a paragraph, not those of paragraphs inside it (text boxes)."""
    for child in par:
        if child.tag == p:
            continue
        if child.tag == t:
            yield child
        yield from _own(child, p, t)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _full(v: str) -> str:
    """A number of 10 ** 15 and more in all its digits, as the file gives them."""
    if re.fullmatch(r"-?[0-9.]+[eE]\+?[0-9]+", v) and abs(float(v)) >= 1e15:
        return format(int(__import__("decimal").Decimal(v)), "d")
    return v


def _cells(z: zipfile.ZipFile) -> Iterator[dict]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for c in ET.fromstring(z.read(name)).iter(f"{S}c"):
            v, f, inline = c.find(f"{S}v"), c.find(f"{S}f"), c.find(f"{S}is")
            value = "".join(t.text or "" for t in inline.iter(f"{S}t")) if inline is not None else v.text if v is not None else None
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif c.get("t") in (None, "n") and value:
                value = _full(value)
            formula = f.text if f is not None else None
            if value or formula:
                at = {"part": name, "row": int(re.search(r"\d+", c.get("r"))[0]), "col": _column(c.get("r")), "formula": formula}
                yield at | {"kind": "cached" if formula else "cell", "text": value or "", "nodes": [len(value or "")]}
                for constant in re.findall(r'"((?:[^"]|"")*)"', formula or ""):
                    yield at | {"kind": "constant", "text": constant.replace('""', '"'), "nodes": [len(constant)]}


def read(doc_id: int, form: str, content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rows = list(_cells(z) if form == "xlsx" else _paragraphs(z, form))
    return [{"doc_id": doc_id, "block_id": i} | r for i, r in enumerate(rows)]


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of docs(doc_id, format, content). A formula's cached value is one block (kind cached, maybe stale), each of its quoted constants another."""
    columns = ["doc_id", "block_id", "kind", "part", "row", "col", "text", "formula", "nodes"]

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d in frame.itertuples():
                rows = read(d.doc_id, d.format, bytes(d.content))
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"row": "Int32", "col": "Int32"})

    return docs.where(F.col("format").isin("docx", "pptx", "xlsx")).select("doc_id", "format", "content").mapInPandas(f, SCHEMA)


def cached_issues(found: DataFrame) -> DataFrame:
    """An issue for each formula whose stored value was used: nothing here computes formulas anew."""
    return found.where("kind = 'cached'").select("doc_id", F.lit("formula").alias("stage"), "block_id", F.lit("warning").alias("severity"), F.lit("stored value used, maybe stale").alias("message"))


def spread(nodes: Column, start: Column, end: Column, code: Column, text: Column) -> Column:
    """A block's nodes as new texts: the code goes to the first node that the range touches, the rest of the range is cut."""
    begins = F.transform(nodes, lambda n, i: F.coalesce(F.aggregate(F.slice(nodes, F.lit(1), i), F.lit(0), lambda a, x: a + x), F.lit(0)))
    touched = F.array_min(F.filter(F.transform(nodes, lambda n, i: F.when((F.get(begins, i) < end) & (F.get(begins, i) + n > start), i)), F.isnotnull))

    def part(n: Column, i: Column) -> Column:
        b = F.get(begins, i)
        head = F.substr(text, b + 1, F.greatest(F.least(start, b + n) - b, F.lit(0)))
        tail_at = F.greatest(F.least(end, b + n), b)
        return F.concat(head, F.when(i == touched, code).otherwise(F.lit("")), F.substr(text, tail_at + 1, b + n - tail_at))

    return F.when(touched.isNull(), F.transform(nodes, lambda n, i: F.substr(text, F.get(begins, i) + 1, n))).otherwise(F.transform(nodes, part))


def rewritten(form: str, content: bytes, edits: dict[tuple[str, int], tuple[str, list[str]]]) -> tuple[bytes, list[tuple[str, int]]]:
    """A Word or PowerPoint file with new node texts by (part, paragraph), each given with the text expected there, and the places where another text was found."""
    pattern, p, t = PARTS[form]
    out, wrong = io.BytesIO(), []
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            data = z.read(item.filename)
            mine = {i: e for (part, i), e in edits.items() if part == item.filename}
            if mine:
                root = ET.fromstring(data)
                for i, par in enumerate(root.iter(p)):
                    if i in mine:
                        nodes = list(_own(par, p, t))
                        expected, new = mine[i]
                        if "".join(x.text or "" for x in nodes) != expected:
                            wrong.append((item.filename, i))
                            continue
                        for x, text in zip(nodes, new, strict=True):
                            x.text = text
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            w.writestr(item, data)
    return out.getvalue(), wrong


def _named(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def rewritten_cells(content: bytes, edits: dict[tuple[str, int, int], tuple[str, str, str | None]]) -> tuple[bytes, list[tuple[str, int, int]], dict[tuple[str, int, int], str]]:
    """An Excel file with new cells by (part, row, column), each given as the text expected there, the new text, and the new formula.

    A cell with a new formula keeps being one, and the file asks to be computed anew; any other becomes a text cell, its style kept.
    Also the places where another text was found, and the cells as they were, as XML, with which ``restored_cells`` puts
    formulas and types back.
    """
    out, wrong, were = io.BytesIO(), [], {}
    texts = {(r["part"], r["row"], r["col"]): r["text"] for r in read(0, "xlsx", content) if r["kind"] != "constant"}
    anew = any(e[2] is not None for e in edits.values())
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            data = z.read(item.filename)
            mine = {_named(col) + str(row): ((part, row, col), e) for (part, row, col), e in edits.items() if part == item.filename}
            if mine:
                root = ET.fromstring(data)
                for c in root.iter(f"{S}c"):
                    if c.get("r") not in mine:
                        continue
                    at, (expected, new, formula) = mine.pop(c.get("r"))
                    if texts.get(at, "") != expected:
                        wrong.append(at)
                        continue
                    were[at] = ET.tostring(c, encoding="unicode")
                    for x in list(c):
                        c.remove(x)
                    if formula is not None:
                        c.set("t", "str")
                        ET.SubElement(c, f"{S}f").text = formula
                        ET.SubElement(c, f"{S}v").text = new
                    else:
                        c.set("t", "inlineStr")
                        ET.SubElement(ET.SubElement(c, f"{S}is"), f"{S}t").text = new
                wrong += [at for at, _ in mine.values()]
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            elif item.filename == "xl/workbook.xml" and anew:
                root = ET.fromstring(data)
                settings = root.find(f"{S}calcPr")
                settings = ET.SubElement(root, f"{S}calcPr") if settings is None else settings
                settings.set("fullCalcOnLoad", "1")
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            w.writestr(item, data)
    return out.getvalue(), wrong, were


def restored_cells(content: bytes, were: dict[tuple[str, int, int], str], masked: dict[tuple[str, int, int], str]) -> tuple[bytes, list[tuple[str, int, int]]]:
    """An Excel file with the cells that it had, where it still holds the masked text; and the places where it doesn't."""
    out, wrong = io.BytesIO(), []
    texts = {(r["part"], r["row"], r["col"]): r["text"] for r in read(0, "xlsx", content) if r["kind"] != "constant"}
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            data = z.read(item.filename)
            mine = {_named(col) + str(row): (part, row, col) for part, row, col in were if part == item.filename}
            if mine:
                root = ET.fromstring(data)
                for line in root.iter(f"{S}row"):
                    for i, c in enumerate(list(line)):
                        at = mine.pop(c.get("r"), None)
                        if at is not None and texts.get(at, "") == masked[at]:
                            line[i] = ET.fromstring(were[at])
                        elif at is not None:
                            wrong.append(at)
                wrong += list(mine.values())
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            w.writestr(item, data)
    return out.getvalue(), wrong


def masked_formula(formula: str, constants: dict[str, str]) -> str:
    """A formula with its quoted constants replaced; everything else of it stays."""
    return re.sub(r'"((?:[^"]|"")*)"', lambda m: '"' + constants.get(m[1].replace('""', '"'), m[1].replace('""', '"')).replace('"', '""') + '"', formula)


def files_rewritten(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, content, wrong) of docs(doc_id, format, content) with edits(doc_id, part, row, col, expected, nodes, formula).

    nodes are the new texts of a paragraph's text nodes, or of a cell the one new text. wrong lists the places that held another
    text and were left alone, as ``part:row:col``. A file that can't be read has null content and says so there. A document's
    edits are as many as its blocks at most, so they go to its row.
    """
    mine = edits.groupBy("doc_id").agg(F.collect_list(F.struct("part", "row", "col", "expected", "nodes", "formula")).alias("edits"))
    both = docs.select("doc_id", "format", "content").join(mine, "doc_id", "left")

    def one(form: str, content: bytes, rows: list) -> tuple[bytes | None, list[str]]:
        try:
            if form == "xlsx":
                made, wrong, _ = rewritten_cells(content, {(e["part"], int(e["row"]), int(e["col"])): (e["expected"], e["nodes"][0], e["formula"]) for e in rows})  # pandas makes floats of columns with nulls
                return made, [f"{p}:{r}:{c}" for p, r, c in wrong]
            made, wrong = rewritten(form, content, {(e["part"], int(e["row"])): (e["expected"], list(e["nodes"])) for e in rows})
            return made, [f"{p}:{r}:" for p, r in wrong]
        except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as bad:
            return None, [f"{type(bad).__name__}::"]

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d in frame.itertuples():
                content, wrong = one(d.format, bytes(d.content), [] if d.edits is None else list(d.edits))
                yield pd.DataFrame({"doc_id": [d.doc_id], "content": [content], "wrong": [wrong]})

    return both.mapInPandas(f, "doc_id long, content binary, wrong array<string>")
