"""Roll findings up to one row per bill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.text import normalise_code, pick, round_exact
from chargeaudit.operators.numbering import number_rows
from chargeaudit.operators.rules import with_ranks


def finding_totals(findings: DataFrame) -> DataFrame:
    """Per bill: findings, high and medium ones, and the potential overcharge."""
    reference = F.try_divide(F.col("billed_amount"), F.col("overcharge_ratio"))
    delta = F.col("billed_amount") - reference
    excess = F.when(
        (F.col("anomaly_type") == "price_overcharge") & (F.col("overcharge_ratio") > 0) & (delta > 0),
        delta,
    )
    return findings.groupBy("bill_id").agg(
        F.count("*").alias("anomaly_count"),
        F.count_if(F.col("severity") == "high").alias("high_severity_count"),
        F.count_if(F.col("severity") == "medium").alias("medium_severity_count"),
        round_exact(F.sum(excess), 2).alias("potential_overcharge_total"),
    )


def line_totals(lines: DataFrame) -> DataFrame:
    """Per bill: lines, and the total billed if every amount is known."""
    complete = F.count("*") == F.count("billed_amount")
    return lines.groupBy("bill_id").agg(
        F.count("*").alias("total_line_items"),
        round_exact(F.when(complete, F.sum("billed_amount")), 2).alias("total_billed_amount"),
    )


def bill_summary(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per bill; bills without findings have zero counts."""
    counts = ("anomaly_count", "high_severity_count", "medium_severity_count")
    return (
        line_totals(lines)
        .join(finding_totals(findings), "bill_id", "left")
        .select(
            "bill_id",
            "total_line_items",
            "total_billed_amount",
            *[F.coalesce(name, F.lit(0)).alias(name) for name in counts],
            "potential_overcharge_total",
        )
    )


def overcharge_summary(findings: DataFrame) -> DataFrame:
    """Per bill with price findings: count by tier and potential overcharge."""
    priced = findings.where("anomaly_type = 'price_overcharge'")
    return finding_totals(priced)


def dominant_type(findings: DataFrame) -> DataFrame:
    """Most frequent type per bill; on a tie the one that comes first."""
    per_type = (
        with_ranks(findings)
        .groupBy("bill_id", "anomaly_type")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("severity_rank", "line_no", "type_rank")).alias("first"),
        )
    )
    best = F.min(F.struct(-F.col("n"), F.col("first"), F.col("anomaly_type").alias("type")))
    return per_type.groupBy("bill_id").agg(
        best["type"].alias("dominant_type"), F.sum("n").alias("anomaly_count")
    )


def subject_lines(findings: DataFrame) -> DataFrame:
    """Subject line of every bill with findings."""
    kind = F.coalesce(pick(F.col("dominant_type"), c.SUBJECT_LABELS), F.lit("Billing Anomaly"))
    count = F.col("anomaly_count")
    # Wording of the subject line.
    subject = (
        F.when(count == 1, F.format_string("Dispute: %s — Itemized Review Requested", kind))
        .when(
            count > 1,
            F.format_string("Dispute: %d Billing Issues (%s and Others) — Review Requested", count, kind),
        )
        .otherwise("Medical Bill Review Request")
    )
    return dominant_type(findings).withColumn("subject_line", subject)


def anomaly_codes(findings: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Distinct codes of the findings of a bill, numbered as first seen."""
    first = (
        with_ranks(findings)
        .where(normalise_code(F.col("code")).isNotNull())
        .groupBy("bill_id", "code")
        .agg(F.min(F.struct("severity_rank", "line_no", "type_rank")).alias("_first"))
    )
    return number_rows(first, "bill_id", ["_first", "code"], "position", sizes).select(
        "bill_id", "code", "position"
    )
