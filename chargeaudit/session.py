"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the operators expect of a session: adaptive execution splits skewed join
# partitions and switches joins by measured size. Generated methods beyond 8000
# bytes of bytecode are never compiled by the JVM; the limit lets Spark fall back
# to split-up projections for the long text expressions of the reports.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", name: str = "chargeaudit", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the cluster; make one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="chargeaudit-")
    context.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet so that several consumers see the very same rows.

    The result is read back from reliable storage, so a lost executor costs a re-read and not
    a recomputation, and a consumer reads only the columns it needs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over all cores if its files make fewer tasks than there are cores.

    Files of one row group are read by one task, and all that follows without a shuffle would
    run there too. A scan of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BROADCAST_BYTES = 64 * 1024 * 1024


def _width(field: T.StructField) -> Column:
    """Bytes of a value, roughly and never far too low."""
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(field.name), F.lit(0)) * 8 + 16
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Size of a frame, measured by running it."""
    total = sum((_width(field) for field in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(total.cast("bigint")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast of ``df`` if its measured size allows it.

    Meant for the catalog: the optimizer's guess for a freshly joined table is
    far too high, and a needless shuffle of the charge lines is the most
    expensive step of the audit. Larger frames are left to the optimizer, which
    shuffles both sides and splits hot keys.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def staged_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Run ``df`` now, keep its rows, and broadcast them if there are few.

    For the rare hits of an aggregation that are joined back to all lines: the
    lines then need no shuffle.
    """
    return broadcast_if_small(materialise(df), max_bytes)
