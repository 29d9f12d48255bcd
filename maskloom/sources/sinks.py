"""Masked texts and their mappings, written beside each other and never over the originals."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions.rules import AMOUNT


def _apart(out: str, source: str) -> None:
    a, b = out.rstrip("/"), source.rstrip("/")
    if a == b or a.startswith(f"{b}/") or b.startswith(f"{a}/"):
        raise ValueError("masked files are never written over their originals")


def write_masked(done: DataFrame, out: str, source: str) -> None:
    """Only documents whose text changed are rewritten; all are listed with whether they were."""
    _apart(out, source)
    changed = ~F.col("masked").eqNullSafe(F.col("text"))
    done.select("doc_id", F.when(changed, F.col("masked")).alias("masked"), changed.alias("changed")).write.mode("errorifexists").parquet(f"{out}/masked")


def write_mappings(done: DataFrame, out: str, source: str) -> None:
    """One version 2 mapping a document, as JSON lines in a folder of its own; it holds the originals, so guard it."""
    _apart(out, source)
    entries = F.transform("codes_of", lambda e: F.struct(e["key"].alias("code"), e["value"].alias("surface"), F.when(F.startswith(e["key"], F.lit("[")), F.regexp_extract(e["key"], r"^\[([^\[\]0-9]+)", 1)).otherwise(AMOUNT.label).alias("label")))
    done.select("doc_id", F.map_entries("mapping").alias("codes_of")).select("doc_id", F.to_json(F.struct(F.lit(2).alias("version"), entries.alias("entries"))).alias("mapping")).write.mode("errorifexists").json(f"{out}/mappings")


def verified(spark, out: str, done: DataFrame) -> DataFrame:
    """Rows whose written text, read again, isn't the one computed; none if all is well."""
    changed = done.where(~F.col("masked").eqNullSafe(F.col("text"))).select("doc_id", F.col("masked").alias("text"))
    again = spark.read.parquet(f"{out}/masked").where("changed").select("doc_id", F.col("masked").alias("text"))
    return changed.exceptAll(again).unionByName(again.exceptAll(changed))


def originals_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose hash isn't what it was."""
    b = before.select("path", F.col("sha256").alias("was"))
    return b.join(after.select("path", F.col("sha256").alias("now")), "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def write_files(done: DataFrame, out: str, source: str) -> DataFrame:
    """One masked file for each of done(path, text, masked, mapping) and its mapping beside it, in a folder that all executors share.

    ``a/x.txt`` gives ``x_脱敏.txt`` and ``x_脱敏映射表.json``; the name must be the document's alone. A file that is there already
    is copied first, to a name with its own digest, and the copy is read again. Files are written under another name and moved,
    so a task that runs twice leaves the same. Returns (path, file, backup, sha256, ok), ok if what was read again is what was
    to be written.
    """
    _apart(out, source)
    entries = F.transform(F.map_entries("mapping"), lambda e: F.struct(e["key"].alias("code"), e["value"].alias("surface"), F.when(F.startswith(e["key"], F.lit("[")), F.regexp_extract(e["key"], r"^\[([^\[\]0-9]+)", 1)).otherwise(AMOUNT.label).alias("label")))
    rows = done.where("masked is not null").select("path", "masked", F.to_json(F.struct(F.lit(2).alias("version"), entries.alias("entries"))).alias("mapping"))

    def put(fs, name: str, data: bytes) -> tuple[str | None, bool]:
        backup, kept = None, True
        if fs.get_file_info(name).is_file:
            with fs.open_input_stream(name) as f:
                old = f.read()
            if old == data:
                return None, True
            backup = f"{name}.{hashlib.sha256(old).hexdigest()[:12]}.bak"
            with fs.open_output_stream(backup) as f:
                f.write(old)
            with fs.open_input_stream(backup) as f:
                kept = f.read() == old
        part = f"{name}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            f.write(data)
        fs.move(part, name)
        with fs.open_input_stream(name) as f:
            return backup, kept and f.read() == data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(out)
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            got = []
            for path, text, mapping in zip(*(batch.column(c).to_pylist() for c in ("path", "masked", "mapping")), strict=True):
                stem, dot, end = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
                stem, end = (stem, dot + end) if dot else (end, "")
                for name, data in ((f"{folder}/{stem}_脱敏{end}", text.encode()), (f"{folder}/{stem}_脱敏映射表.json", mapping.encode())):
                    backup, ok = put(fs, name, data)
                    got.append({"path": path, "file": name, "backup": backup, "sha256": hashlib.sha256(data).hexdigest(), "ok": ok})
            yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("path", pa.string()), ("file", pa.string()), ("backup", pa.string()), ("sha256", pa.string()), ("ok", pa.bool_())]))

    return rows.mapInArrow(run, "path string, file string, backup string, sha256 string, ok boolean")
