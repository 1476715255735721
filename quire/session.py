"""Session settings shared by the tests, the benchmark and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution on.

    Only what the queries rely on is set; partition counts and memory belong to
    the cluster and are taken from ``conf`` or from spark-submit.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables; the path may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python, about. Rows alone don't bound it: a text may be megabytes long. Both sides hold many times as much while they work on it.
BATCH_BYTES = 1 << 20
#: Spark's default for it, which with two tasks an executor and a copy on either side is hundreds of MB.
USUAL = "67108864b"


def small_batches(spark) -> None:
    """Bound Arrow batches by their bytes, too; a setting that the session gives wins."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == USUAL:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df):
    """The rows over at least as many tasks as there are cores, for work that costs far more than a shuffle of its input.

    A table that has that many splits, as any large one, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def size_of(text: str) -> int:
    """The bytes that a setting such as 128MB, 16m or 1024b names."""
    digits = text.strip().lower().rstrip("bkmgti")
    return int(digits) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[text.strip().lower()[len(digits) :][:1]]
