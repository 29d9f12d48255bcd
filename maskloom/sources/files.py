"""Documents from folders: bytes, their real kind, decoded text, and the mapping files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions and the bytes their files begin with, in hexadecimal.
MAGIC = (("docx", "504B0304"), ("xlsx", "504B0304"), ("pptx", "504B0304"), ("pdf", "25504446"))
OLE = "D0CF11E0A1B11AE1"
TEXT = ("txt", "md", "markdown")
LEGACY = ("doc", "xls", "ppt")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def documents(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(doc_id, path, format, sha256, content) of all files; doc_id is a hash of the path."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return d.select(F.xxhash64("path").alias("doc_id"), "path", extension(F.col("path")).alias("format"), F.sha2("content", 256).alias("sha256"), "content")


def checked(docs: DataFrame) -> DataFrame:
    """docs with ``problem``: a legacy format, content that isn't what the extension says, an unknown extension; null if none."""
    head = F.hex(F.substring("content", 1, 8))
    wrong = F.lit(None).cast("string")
    for ext, magic in MAGIC:
        wrong = F.when((F.col("format") == ext) & ~F.startswith(head, F.lit(magic)), F.lit(f"content is not {ext}")).otherwise(wrong)
    known = [e for e, _ in MAGIC] + list(TEXT)
    problem = F.when(F.col("format").isin(*LEGACY), "legacy format").when(F.startswith(head, F.lit(OLE)), "legacy content under another extension").when(~F.col("format").isin(*known), "unknown extension").otherwise(wrong)
    return docs.withColumn("problem", problem)


def decoded(content: Column) -> Column:
    """UTF-8, with or without a mark at its start, or else GBK. The session needs spark.sql.legacy.javaCharsets for GBK."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2147483647)).otherwise(content)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(F.decode(bare, "GBK"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """One block a line of text files."""
    d = docs.where(F.col("format").isin(*TEXT)).select("doc_id", decoded(F.col("content")).alias("text"))
    return d.select("doc_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("block_id", "text")).withColumn("kind", F.lit("line"))


def stem(path: Column) -> Column:
    """A file's path without its extension and what masking added to its name."""
    return F.regexp_replace(path, r"(_脱敏(映射表)?|_已还原)?\.[A-Za-z0-9]+$", "")


def with_mapping(masked: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """masked files joined with the mapping file of their stem, and those without one."""
    m = mappings.select(stem(F.col("path")).alias("stem"), F.col("mapping"))
    d = masked.withColumn("stem", stem(F.col("path")))
    return d.join(m, "stem"), d.join(m, "stem", "left_anti")


def needs_reading(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, image_share, has_text) with ``route``: the text layer, or character recognition of a scanned page."""
    scanned = F.col("image_share") >= 0.8
    return pages.withColumn("route", F.when(~scanned, "text").when(F.col("has_text"), "text layer").otherwise("recognition"))


def dictionary(spark: SparkSession, path: str | None, key: str, default: tuple[str, ...]) -> DataFrame:
    """(word) of a JSON dictionary's key; the default where the file, the key or its form is wrong."""
    words = list(default)
    if path is not None:
        try:
            row = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", f"`{key}` array<string>").alias("d")).first()
            words = list(row["d"][key]) if row and row["d"] and row["d"][key] else words
        except Exception as e:  # a missing or malformed file degrades to the default
            if "PATH_NOT_FOUND" not in str(e) and "MALFORMED" not in str(e):
                raise
    return spark.createDataFrame([(w,) for w in words], "word string")
