"""Session settings, shared-folder materialisation and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found at most this many.
BROADCAST_ROWS = 200_000
#: Rows of a key up to which it isn't split when it is joined; parts that rows without a key are spread over.
HOT_ROWS, NULL_SALTS = 2_000_000, 1024
#: Spark's setting by which a query's shuffle files are deleted when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_TEMPORARY: list[str] = []


def build(app: str = "finweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; values in ``conf`` win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in tests one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _TEMPORARY:
        _TEMPORARY.append(tempfile.mkdtemp(prefix="finweave-"))
        atexit.register(shutil.rmtree, _TEMPORARY[0], ignore_errors=True)
    return "file://" + _TEMPORARY[0]


def run_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/finweave-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application materialised; frames that read it can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage", release: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    The files survive the loss of an executor, unlike cached blocks. ``release`` deletes the shuffle files as soon as the rows are written; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    if release:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``materialize`` gave, once everything that reads them is written; they can't be used afterwards."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join a unique-keyed ``dim`` to ``df`` whose keys may be heavily skewed.

    Up to BROADCAST_ROWS counted rows the dimension is broadcast. Beyond, keys with more than HOT_ROWS rows of ``df`` are counted and split into as many salts as
    they need, with their rows of the dimension repeated once a salt; other keys are joined as they are. The salt is a hash of the row, so a
    repeated task gives the same. Rows with a null key meet nothing and are spread likewise. ``dim`` should be a materialised table because it is counted here.
    """
    n = dim.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(dim), on, how)
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    hot = df.where(known).groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("__salts")).where("__salts > 1")
    hot = F.broadcast(materialize(hot, "hot-keys", release=True))  # at most one key for each HOT_ROWS rows
    row = F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))
    salted = df.join(hot, on, "left").withColumn("__salt", F.when(known, F.pmod(row, F.coalesce("__salts", F.lit(1)))).otherwise(F.pmod(row, F.lit(NULL_SALTS))).cast("int")).drop("__salts")
    spread = dim.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")
