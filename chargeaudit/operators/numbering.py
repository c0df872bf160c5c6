"""Ordinals and first-rows, safe for keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.session import materialise


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key by ``order``.

    The filter on the row number lets Spark cut every key down to one row per
    task before the shuffle, so a hot key costs no more than any other.
    """
    return top_per_key(df, keys, order, 1, "_first").drop("_first")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, rank: str
) -> DataFrame:
    """The first ``limit`` rows of every key, numbered in column ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)


def number_rows(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    number: str,
    sizes: DataFrame | None = None,
    hot_rows: int = c.HOT_KEY_ROWS,
) -> DataFrame:
    """Number the rows of every key from 1 by the columns ``order``.

    An ordinary window puts a whole key into one task. Keys with more than
    ``hot_rows`` rows are therefore range-partitioned by (key, order) instead,
    numbered inside each range and shifted by the rows of the earlier ranges.
    ``sizes`` may be a cheaper frame with at least as many rows per key, used
    only to find the hot keys.
    """
    hot = (sizes if sizes is not None else df).groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    window = Window.partitionBy(key).orderBy(*order)
    if hot.isEmpty():
        return df.withColumn(number, F.row_number().over(window))

    hot = materialise(hot)
    cold = df.join(hot, key, "left_anti").withColumn(number, F.row_number().over(window))
    # Frozen on storage: the range bounds come from sampling, and both the
    # counts and the numbers below must see the same ranges.
    ranged = materialise(
        df.join(hot, key, "left_semi")
        .repartitionByRange(key, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(key, "_range")
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    numbered = (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [key, "_range"])
        .withColumn(number, (F.col("_offset") + F.col("_row")).cast("int"))
        .drop("_range", "_offset", "_row")
    )
    return cold.unionByName(numbered.select(*cold.columns))
