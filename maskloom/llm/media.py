"""Media columns: texts stored as FLAC, read back as PCM blocks with sample offsets, and digests of both.

The payload of a text is its UTF-8 followed by zero bytes up to a positive multiple of 64; a null text is the empty one.
Each byte is an 8-bit sample. Values depend on the text alone, so repeated rows get equal ones. Bytes stay in columns:
nothing is written beside the tables. Rows of one task are taken about half a megabyte of text at a time; a longer text
is taken alone, its frames a few hundred at a time, so that it needs a few times its own size. Columns other than the two named are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import flac
from maskloom.llm.runtime import over_texts, slices

_BYTES = 512 << 10


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def feature(pcm: np.ndarray) -> str:
    """Peak, root mean square, zero crossings and mean step of the samples, from whole numbers."""
    peak = crossings = square = steps = 0
    for lo in range(0, len(pcm), 1 << 20):
        x = pcm[max(0, lo - 1) : lo + (1 << 20)].astype(np.int32)  # and the sample before, for the step to it
        own = x if lo == 0 else x[1:]
        peak = max(peak, int(np.abs(own).max()))
        square += int((own * own).sum(dtype=np.int64))
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        steps += int(np.abs(np.diff(x)).sum(dtype=np.int64))
    return f"peak={peak};rms={(square / len(pcm)) ** 0.5:.3f};crossings={crossings};step={steps / max(1, len(pcm) - 1):.3f}"


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))


def stored(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, flac): the stream of each text."""
    base = _base(docs, doc_id, text)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [s for part in slices(batch, "text", _BYTES) for s in flac.streams([payload(t) for t in part.column("text").to_pylist()])]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "flac"])

    return over_texts(base, f, f"id {base.schema['id'].dataType.simpleString()}, flac binary").withColumnRenamed("id", doc_id)


def pcm_blocks(media: DataFrame, *, doc_id: str = "doc_id", column: str = "flac") -> DataFrame:
    """(id, block, first_sample, n_samples, byte_offset, pcm, error) of each frame of each stream; a null stream has no block.

    byte_offset is where the frame begins in the stream, so a block can be read again by itself. A stream that is corrupt or of
    a kind that isn't read (only mono of 8 or 16 bits is) gives one row with its id and error, and nothing else.
    """
    base = media.select(F.col(doc_id).alias("id"), F.col(column).alias("flac")).where("flac is not null")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], [], []]
        for i, s in zip(batch.column("id").to_pylist(), batch.column("flac").to_pylist(), strict=True):
            try:
                info = flac.opened(s)
                pcm = flac.samples([s])[0]
            except (ValueError, IndexError, KeyError) as bad:  # CorruptFrame among them; odd bytes lead to any of these
                for c, v in zip(cols, (i, None, None, None, None, None, f"{type(bad).__name__}: {bad}"), strict=True):
                    c.append(v)
                continue
            for n, point in enumerate(info.points):
                a, size = int(point["sample"]), int(point["size"])
                for c, v in zip(cols, (i, n, a, size, info.first + int(point["offset"]), pcm[a : a + size].tobytes(), None), strict=True):
                    c.append(v)
        kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "block", "first_sample", "n_samples", "byte_offset", "pcm", "error"])

    return over_texts(base, f, f"id {base.schema['id'].dataType.simpleString()}, block int, first_sample long, n_samples int, byte_offset long, pcm binary, error string", "flac").withColumnRenamed("id", doc_id)


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: it is stored, the stored bytes are read back and checked, and what was read is described."""
    base = _base(docs, doc_id, text)

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        for part in slices(batch, "text", _BYTES):
            texts = part.column("text").to_pylist()
            media = flac.streams([payload(t) for t in texts])
            for t, m, pcm in zip(texts, media, flac.samples(media), strict=True):
                back = pcm.tobytes()
                row = (len((t or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(pcm), -(-len(back) // flac.BLOCK))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"])

    schema = f"id {base.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    return over_texts(base, f, schema).withColumnRenamed("id", doc_id)
