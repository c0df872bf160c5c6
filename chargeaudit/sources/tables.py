"""Written tables: clean tables, the published catalog, response documents."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit.operators.catalog import upsert

# A published version is a folder with its number; the highest number is in use.
_VERSION = re.compile(r"version-(\d{12})")
PUBLISH_TRIES = 50


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a clean table and return it as read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _last_version(spark: SparkSession, path: str) -> int:
    """Number of the version in use; 0 when nothing is published."""
    folder = _hadoop_path(spark, path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max((int(m[1]) for m in map(_VERSION.fullmatch, names) if m), default=0)


def _claim(spark: SparkSession, staged: str, published: str) -> bool:
    """Give a staged folder its published name, unless there is one of that name: one step of the file system.

    Holds for file systems whose rename is atomic, local ones and HDFS among them. An object
    store without such a rename needs a committer of its own.
    """
    java = spark._jvm.org.apache.hadoop.fs
    context = java.FileContext.getFileContext(
        _hadoop_path(spark, staged).toUri(), spark._jsc.hadoopConfiguration()
    )
    never_replace = spark.sparkContext._gateway.new_array(getattr(java, "Options$Rename"), 0)
    try:
        context.rename(_hadoop_path(spark, staged), _hadoop_path(spark, published), never_replace)
    except Py4JJavaError as error:
        if _last_version(spark, published.rsplit("/", 1)[0]) >= int(published[-12:]):
            return False
        raise error
    return True


def _version_path(path: str, number: int) -> str:
    return f"{path}/version-{number:012d}"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version in use, or None when nothing is published."""
    number = _last_version(spark, path)
    return _version_path(path, number) if number else None


def read_catalog(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(version)


def publish_catalog(new: DataFrame, path: str, mode: str = "skip") -> DataFrame:
    """Publish ``new`` under ``path`` and return the catalog in use afterwards.

    ``skip`` keeps a catalog that has rows, ``replace`` takes ``new`` only and
    ``upsert`` lets its rows win by code. Every publication is a folder of its
    own, staged first and then given the next number, which only one writer can
    get; a writer that comes second starts again from the version of the first,
    so no upsert is lost. Nothing is ever overwritten, and a job that dies
    half-way leaves the old version in use.
    """
    if mode not in ("skip", "replace", "upsert"):
        raise ValueError(f"unknown mode: {mode}")
    spark = new.sparkSession
    for _ in range(PUBLISH_TRIES):
        number = _last_version(spark, path)
        old = spark.read.parquet(_version_path(path, number)) if number else None
        if mode == "skip" and old is not None and not old.isEmpty():
            return old
        result = upsert(old, new) if mode == "upsert" and old is not None else new
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        result.write.parquet(staged)
        if _claim(spark, staged, _version_path(path, number + 1)):
            return spark.read.parquet(_version_path(path, number + 1))
    raise RuntimeError(f"other writers published {PUBLISH_TRIES} times in the meantime: {path}")


_READINESS = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("connected", T.BooleanType()),
        T.StructField("collection_size", T.LongType()),
    ]
)


def readiness(catalog: DataFrame) -> DataFrame:
    """ok, or degraded when the catalog has no rows."""
    return catalog.agg(F.count("*").alias("collection_size")).select(
        F.when(F.col("collection_size") > 0, "ok").otherwise("degraded").alias("status"),
        F.lit(True).alias("connected"),
        "collection_size",
    )


def catalog_readiness(spark: SparkSession, path: str) -> DataFrame:
    """One row: ok, degraded (empty) or unavailable (nothing to read)."""
    try:
        catalog = read_catalog(spark, path)
    except AnalysisException:
        catalog = None
    if catalog is None:
        return spark.createDataFrame([("unavailable", False, 0)], _READINESS)
    return readiness(catalog)
