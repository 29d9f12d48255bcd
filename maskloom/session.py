"""Session helpers shared by the entry point, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "maskloom") -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call site for each of the thousands of columns of a plan
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df over all cores, where it comes in fewer pieces than there are cores and these are larger than ``most`` bytes.

    A file of one row group is one task however large; before a pass that works on every text it is dealt out anew. Large
    collections come in many pieces already and are left alone.
    """
    pieces, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if pieces < cores and size > pieces * most else df


def dealt(df: DataFrame, most: int, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """df by the hash of keys in pieces of about ``most`` bytes of the files of ``of``, or one for each core if that is more.

    Where these are small df is left as it is. For passes that cost far more than a shuffle of their rows, and whose tasks must
    not grow with the files' row groups. No sort comes before it, as before a round robin.
    """
    size = int(str((of or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-size // most)), *keys) if size > most else df
