"""Record checks, status routing and parsing of reported findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeaudit import constants as c

Check = tuple[str, str]  # message, SQL condition of a bad record


def _negative(name: str) -> Check:
    return f"{name} must not be negative", f"{name} < 0"


def _missing(name: str) -> Check:
    return f"{name} is required", f"{name} is null"


def _outside(name: str, allowed: tuple[str, ...]) -> Check:
    names = ", ".join(f"'{value}'" for value in allowed)
    return (
        f"{name} must be one of: {', '.join(allowed)}",
        f"{name} is null or {name} not in ({names})",
    )


BILL_CHECKS = (
    _missing("redacted_text"),
    _outside("file_type", c.FILE_TYPES),
    _negative("char_count"),
)
RECORD_CHECKS = (
    _missing("code"),
    _negative("medicare_reference_price"),
    _negative("total_rvu"),
    (
        "similarity_score must lie between 0 and 1",
        "similarity_score < 0 or similarity_score > 1",
    ),
)
LINE_CHECKS = (
    _missing("description"),
    ("quantity must be at least 1", "quantity < 1"),
    _negative("billed_amount"),
)
FINDING_CHECKS = (
    *LINE_CHECKS,
    _outside("anomaly_type", c.ANOMALY_TYPES),
    _outside("severity", c.SEVERITIES),
    _missing("explanation"),
    _missing("suggested_action"),
    _negative("medicare_reference_price"),
    _negative("overcharge_ratio"),
)
SUMMARY_CHECKS = (
    _negative("total_line_items"),
    _negative("total_billed_amount"),
    _negative("anomaly_count"),
    _negative("high_severity_count"),
    _negative("medium_severity_count"),
    _negative("potential_overcharge_total"),
)


def with_violations(df: DataFrame, checks: tuple[Check, ...]) -> DataFrame:
    """Add the list of failed checks; empty for a valid record."""
    messages = [F.when(F.expr(bad), F.lit(message)) for message, bad in checks]
    return df.withColumn("violations", F.array_compact(F.array(*messages)))


# Order in which a bill can fail; the first failing check decides.
STATUS_ORDER = (
    "file_too_large",
    "invalid_file_type",
    "ocr_failed",
    "pii_redaction_failed",
    "bill_too_short",
)


def with_status(df: DataFrame, failures: dict[str, Column]) -> DataFrame:
    """One status column out of the failure conditions that apply to ``df``."""
    steps = [F.when(failures[name], name) for name in STATUS_ORDER if name in failures]
    return df.withColumn("status", F.coalesce(*steps, F.lit("ok")))


def _field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _type_of(item: Column, name: str) -> Column:
    return F.schema_of_variant(F.variant_get(item, f"$.{name}", "variant"))


def _is_text(item: Column, name: str) -> Column:
    return F.coalesce(_type_of(item, name) == "STRING", F.lit(False))


def _is_absent(item: Column, name: str) -> Column:
    return F.coalesce(_type_of(item, name) == "VOID", F.lit(True))


def _number(item: Column, name: str) -> Column:
    return F.coalesce(
        _field(item, name, "double"), _field(item, name, "string").try_cast("double")
    )


def _good_number(item: Column, name: str) -> Column:
    number = _number(item, name)
    return _is_absent(item, name) | F.coalesce(number >= 0, F.lit(False))


def _items(json_col: str) -> Column:
    return F.try_variant_get(F.try_parse_json(F.col(json_col)), "$.anomalies", "array<variant>")


def _quantity(item: Column) -> Column:
    given = F.floor(_number(item, "quantity")).cast("double")
    return F.when(_type_of(item, "quantity").isNull(), F.lit(1.0)).otherwise(given)


def is_valid_finding(item: Column) -> Column:
    """All required fields there, every field of its type and in its range.

    Text fields must be text: a number is not converted.
    """
    return (
        _is_text(item, "description")
        & _is_text(item, "explanation")
        & _is_text(item, "suggested_action")
        & F.coalesce(_field(item, "anomaly_type", "string").isin(*c.ANOMALY_TYPES), F.lit(False))
        & F.coalesce(_field(item, "severity", "string").isin(*c.SEVERITIES), F.lit(False))
        & (_is_absent(item, "code") | _is_text(item, "code"))
        & (_is_absent(item, "service_date") | _is_text(item, "service_date"))
        & F.coalesce(_quantity(item) >= 1, F.lit(False))
        & _good_number(item, "billed_amount")
        & _good_number(item, "medicare_reference_price")
        & _good_number(item, "overcharge_ratio")
    )


def parse_findings(reports: DataFrame, json_col: str = "report", key: str = "bill_id") -> DataFrame:
    """Valid findings of reported JSON documents, one row each.

    A malformed finding is dropped and the others of the report are kept.
    """
    items = reports.select(key, F.posexplode(_items(json_col)).alias("item_no", "item"))
    item = F.col("item")
    return items.where(is_valid_finding(item)).select(
        key,
        "item_no",
        _field(item, "code", "string").alias("code"),
        _field(item, "description", "string").alias("description"),
        _quantity(item).cast("int").alias("quantity"),
        _number(item, "billed_amount").alias("billed_amount"),
        _field(item, "service_date", "string").alias("service_date"),
        _field(item, "anomaly_type", "string").alias("anomaly_type"),
        _field(item, "severity", "string").alias("severity"),
        _field(item, "explanation", "string").alias("explanation"),
        _number(item, "medicare_reference_price").alias("medicare_reference_price"),
        _number(item, "overcharge_ratio").alias("overcharge_ratio"),
        _field(item, "suggested_action", "string").alias("suggested_action"),
    )


def finding_stats(reports: DataFrame, json_col: str = "report", key: str = "bill_id") -> DataFrame:
    """Per report: line items, findings reported, valid and skipped."""
    items = F.coalesce(_items(json_col), F.array().cast("array<variant>"))
    lines = F.try_variant_get(F.try_parse_json(F.col(json_col)), "$.total_line_items", "bigint")
    return reports.select(
        key,
        F.coalesce(lines, F.lit(0)).alias("total_line_items"),
        F.size(items).cast("bigint").alias("n_reported"),
        F.size(F.filter(items, is_valid_finding)).cast("bigint").alias("n_valid"),
    ).withColumn("n_skipped", F.col("n_reported") - F.col("n_valid"))
