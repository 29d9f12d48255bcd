"""Masking as a stream: a document a row, no state, so append mode without watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from maskloom.options import Options
from maskloom.plans.masking import masked


def documents(spark: SparkSession, folder: str, name: str = "documents.parquet", files: int = 16) -> DataFrame:
    """A stream of new files of documents(doc_id, text, ...) in a folder."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def start(stream: DataFrame, out: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Masks what arrives; each file's documents are there as soon as they are done."""
    done = masked(stream, options or Options(mode="regex")).select("doc_id", "text", "masked", "mapping")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
