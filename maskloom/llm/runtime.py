"""What the operators share: checkpoints, row passes over Arrow batches, hash-bounded samples."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a session in one process (tests) gets a folder of its own where that is unset;
    a cluster's executors would not see it, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint, so that a lost executor costs no long recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """cut(), read again in partitions of about so many rows at least, so that what follows doesn't write a file for each of many near-empty ones."""
    out = cut(df)
    return out.coalesce(out.count() // rows + 1)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what finished steps left: shuffle files stay on all disks until its garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id counts as the empty text, of crc32 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5, as int."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold at most so many bytes of text (or one row), so that a batch of long texts stays small."""
    if not batch.num_rows:
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right"))
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def over_texts(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, column: str = "text") -> DataFrame:
    """One narrow pass: f over runs of rows of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """All rows, or by hash about so many of them where there are more; the same rows on every run."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(1 << 20)) < int((1 << 20) * most / n))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
