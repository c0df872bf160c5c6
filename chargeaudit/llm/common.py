"""Shared helpers: tables, work tables, joins with a measured side, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 * 1024 * 1024
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one is made if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(df: DataFrame) -> int:
    parts = [
        F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if t in ("string", "binary")
        else F.greatest(F.size(c), F.lit(0)) * 8 + 16
        if t.startswith("array")
        else F.lit(8)
        for c, t in df.dtypes
    ]
    return df.agg(F.coalesce(F.sum(sum(parts, F.lit(32)).cast("long")), F.lit(0))).first()[0]


def beside(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``rows`` with a table that is usually small.

    Its size is measured: up to ``limit`` bytes it is broadcast. Beyond, both sides are
    shuffled with a salt, so that a key of ``rows`` that holds a third of all rows is
    dealt to ``SALTS`` tasks. ``small`` should be cheap to run twice.
    """
    if _bytes(small) <= limit:
        return rows.join(F.broadcast(small), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(32)
    return z


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound of entries."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
