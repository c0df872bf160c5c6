"""The audit end to end: uploaded texts and charge lines to documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.text import is_blank
from chargeaudit.operators.checks import with_status
from chargeaudit.operators.extract import candidate_codes, with_text_status
from chargeaudit.operators.lookup import lookup_codes
from chargeaudit.operators.redact import redact, with_gate
from chargeaudit.operators.report import letters, to_documents
from chargeaudit.operators.rules import detect_anomalies, with_clean_codes
from chargeaudit.operators.summary import bill_summary
from chargeaudit.session import materialise


def route_bills(bills: DataFrame, profile: str = "parity", redacted: bool = False) -> DataFrame:
    """Redact, gate and check every bill; one ``status`` says how far it came.

    ``bills(bill_id, text, …)`` may bring ``n_bytes`` and ``mime_type`` of the
    upload. Texts that fail the gate are blanked, so that they cannot travel
    on. With ``redacted`` the text is taken as redacted already and only gated.
    """
    if redacted:
        step = bills.withColumn("redacted_text", F.col("text")).withColumn("n_total", F.lit(0))
    else:
        step = redact(bills, "text", profile)
    step = with_text_status(with_gate(step, "redacted_text", profile))
    failures = {
        "ocr_failed": is_blank(F.col("text")),
        "pii_redaction_failed": ~F.col("is_safe"),
        "bill_too_short": F.col("text_status") != "ok",
    }
    if "n_bytes" in bills.columns:
        failures["file_too_large"] = F.col("n_bytes") > c.MAX_UPLOAD_MB * 1024 * 1024
    if "file_type" in bills.columns:
        failures["invalid_file_type"] = ~F.coalesce(F.col("file_type").isin(*c.FILE_TYPES), F.lit(False))
    keep = [name for name in bills.columns if name != "text"]
    routed = with_status(step, failures).select(
        *keys_first(keep),
        F.when(F.col("is_safe"), F.col("redacted_text")).alias("redacted_text"),
        F.length("redacted_text").cast("bigint").alias("char_count"),
        F.col("n_total").cast("bigint").alias("n_redactions"),
        "status",
    )
    # Read by several consumers; the redaction runs once.
    return materialise(routed)


def keys_first(names: list[str]) -> list[str]:
    return ["bill_id", *[name for name in names if name != "bill_id"]]


class Audit(NamedTuple):
    bills: DataFrame
    lookups: DataFrame
    findings: DataFrame
    summary: DataFrame
    letters: DataFrame
    documents: DataFrame


def audit_bills(
    bills: DataFrame,
    lines: DataFrame,
    catalog: DataFrame,
    pairs: DataFrame | None = None,
    profile: str = "parity",
    redacted: bool = False,
    upcoded: DataFrame | None = None,
    uncoded: DataFrame | None = None,
) -> Audit:
    """Everything the audit yields for the bills that pass all checks.

    ``lines`` are the charge lines read from the bills. ``upcoded`` and
    ``uncoded`` are the findings of the similarity rules for these lines, if
    the caller has vectors. The findings feed four outputs and are therefore
    written once.
    """
    routed = route_bills(bills, profile, redacted)
    accepted = routed.where("status = 'ok'")
    lookups = lookup_codes(candidate_codes(accepted), catalog)
    bills_kept = accepted.select("bill_id").distinct()
    audited = with_clean_codes(lines).join(bills_kept, "bill_id", "left_semi")
    similar = [
        None if found is None else found.join(bills_kept, "bill_id", "left_semi") for found in (upcoded, uncoded)
    ]
    findings = materialise(detect_anomalies(audited, catalog, pairs, upcoded=similar[0], uncoded=similar[1]))
    summary = bill_summary(findings, audited)
    letter_rows = letters(findings, sizes=audited, keep_findings=True)
    return Audit(
        routed,
        lookups,
        findings,
        summary,
        letter_rows.drop("anomalies"),
        to_documents(findings, summary, letter_rows),
    )
