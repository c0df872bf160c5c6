"""Exact lookup of codes in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeaudit.functions.text import normalise_code
from chargeaudit.session import broadcast_if_small

RECORD = (
    "long_description",
    "short_description",
    "medicare_reference_price",
    "total_rvu",
    "has_price_data",
)


def lookup_codes(codes: DataFrame, catalog: DataFrame, how: str = "left") -> DataFrame:
    """Every row of ``codes`` with its catalog record and a ``found`` flag.

    ``how="inner"`` keeps found codes only. The catalog is broadcast if its
    measured size allows it, otherwise the adaptive join splits hot codes.
    """
    record = broadcast_if_small(
        catalog.select(F.col("code").alias("_key"), *RECORD, F.lit(True).alias("found"))
    )
    return (
        codes.withColumn("code", normalise_code(F.col("code")))
        .join(record, F.col("code") == F.col("_key"), how)
        .drop("_key")
        .withColumn("found", F.coalesce("found", F.lit(False)))
    )


def unknown_codes(codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct codes of every bill that the catalog does not hold."""
    wanted = codes.select("bill_id", normalise_code(F.col("code")).alias("code")).where(
        "code is not null"
    )
    known = broadcast_if_small(catalog.select("code"))
    return wanted.distinct().join(known, "code", "left_anti").select("bill_id", "code")


def lookup_coverage(codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per bill: distinct codes, how many were found, how many are unknown."""
    wanted = codes.select("bill_id", normalise_code(F.col("code")).alias("code")).where(
        "code is not null"
    )
    known = broadcast_if_small(catalog.select("code", F.lit(1).alias("_hit")))
    found = wanted.distinct().join(known, "code", "left")
    return found.groupBy("bill_id").agg(
        F.count("*").alias("n_codes"),
        F.count("_hit").alias("n_found"),
        F.count_if(F.col("_hit").isNull()).alias("n_unknown"),
    )
