"""The charge rules. Input is one row per charge line:

``bill_id, line_no, code, description, quantity, billed_amount, service_date``

``line_no`` orders the lines of a bill. ``code`` is trimmed and upper-case, or
null (see ``with_clean_codes``). Every rule returns findings with the columns of
``FINDING``; rules on different evidence are joined by union.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.text import (
    fixed,
    normalise_code,
    parse_service_date,
    severity_rank,
    type_rank,
)
from chargeaudit.operators.numbering import number_rows
from chargeaudit.session import broadcast_if_small, materialise, staged_if_small

LINE = (
    "bill_id",
    "line_no",
    "code",
    "description",
    "quantity",
    "billed_amount",
    "service_date",
)
FINDING = (
    *LINE,
    "anomaly_type",
    "severity",
    "medicare_reference_price",
    "overcharge_ratio",
    "related",
)


def finding_columns(
    kind: str,
    severity: Column | str,
    price: Column | None = None,
    ratio: Column | None = None,
    related: Column | None = None,
) -> list[Column]:
    """Finding columns after the line's own."""

    def given(value: Column | None, type_name: str) -> Column:
        return F.lit(None).cast(type_name) if value is None else value

    return [
        F.lit(kind).alias("anomaly_type"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        given(price, "double").alias("medicare_reference_price"),
        given(ratio, "double").alias("overcharge_ratio"),
        given(related, "string").alias("related"),
    ]


def _line(lines: DataFrame) -> list[Column]:
    return [F.col(name) for name in LINE]


def with_clean_codes(lines: DataFrame) -> DataFrame:
    """Lines as read from a bill, made fit for the rules."""
    return lines.withColumn("code", normalise_code(F.col("code")))


def overcharge_severity(ratio: Column) -> Column:
    return (
        F.when(ratio > c.HIGH_RATIO, "high")
        .when(ratio >= c.MEDIUM_RATIO, "medium")
        .when(ratio >= c.LOW_RATIO, "low")
    )


def price_and_code_findings(
    lines: DataFrame, catalog: DataFrame, per_unit: bool = False
) -> DataFrame:
    """Overcharged lines and lines with an unknown code, in one pass.

    A code is either in the catalog (then its price is compared) or not, so one
    left join answers both rules. The charge is compared as billed; with
    ``per_unit`` it is divided by the quantity first.
    """
    prices = broadcast_if_small(
        catalog.select(
            F.col("code").alias("_key"),
            F.when(F.col("has_price_data"), F.col("medicare_reference_price")).alias("_price"),
        )
    )
    billed = F.col("billed_amount")
    if per_unit:
        billed = F.try_divide(billed, F.col("quantity"))
    ratio = F.try_divide(billed, F.col("_price"))
    judged = (
        lines.where("code is not null")
        .join(prices, F.col("code") == F.col("_key"), "left")
        .withColumn("_ratio", ratio)
        .withColumn(
            "_severity",
            F.when(F.col("_key").isNull(), F.lit(c.UNKNOWN_CODE_SEVERITY)).otherwise(
                overcharge_severity(F.col("_ratio"))
            ),
        )
        .where("_severity is not null")
    )
    kind = F.when(F.col("_key").isNull(), "unknown_code").otherwise("price_overcharge")
    return judged.select(
        *_line(lines),
        kind.alias("anomaly_type"),
        F.col("_severity").alias("severity"),
        F.col("_price").alias("medicare_reference_price"),
        F.col("_ratio").alias("overcharge_ratio"),
        F.lit(None).cast("string").alias("related"),
    )


def price_overcharges(lines: DataFrame, catalog: DataFrame, per_unit: bool = False) -> DataFrame:
    """Lines billed at least 1.2 times their reference price."""
    priced = catalog.where("has_price_data")
    findings = price_and_code_findings(lines, priced, per_unit)
    return findings.where("anomaly_type = 'price_overcharge'")


def unknown_code_lines(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coded lines whose code the catalog does not hold."""
    known = broadcast_if_small(catalog.select(F.col("code").alias("_key")))
    return (
        lines.where("code is not null")
        .join(known, F.col("code") == F.col("_key"), "left_anti")
        .select(*_line(lines), *finding_columns("unknown_code", c.UNKNOWN_CODE_SEVERITY))
    )


def duplicate_charges(
    lines: DataFrame,
    keys: Sequence[str] = ("bill_id", "code"),
    max_gap_days: int = 1,
) -> DataFrame:
    """Lines that repeat an earlier line of the same ``keys``.

    The first line of a day repeats the previous day it was charged on, if that
    is at most ``max_gap_days`` back; all later lines of a day repeat the first.
    Work is on one row per (key, day), so a hot key costs one window over its
    days and not over its lines.
    """
    dated = lines.withColumn("_day", parse_service_date(F.col("service_date")))
    for key in keys:
        dated = dated.where(F.col(key).isNotNull())
    # Lines of one bill are ordered by their number alone, which keeps the
    # aggregation on plain numbers.
    place = F.col("line_no") if "bill_id" in keys else F.struct("bill_id", "line_no")
    days = dated.groupBy(*keys, "_day").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    repeats = repeated_days(days, keys, max_gap_days)
    return (
        dated.join(staged_if_small(repeats), [*keys, "_day"])
        .withColumn("_later", place > F.col("_first"))
        .where(F.col("_later") | F.col("_near"))
        .select(
            *_line(lines),
            *finding_columns(
                "duplicate_charge",
                F.when(F.col("_later"), c.SAME_DAY_DUPLICATE_SEVERITY).otherwise(
                    c.ADJACENT_DUPLICATE_SEVERITY
                ),
                related=F.date_format(
                    F.when(F.col("_later"), F.col("_day")).otherwise(F.col("_previous")), "MM/dd/yyyy"
                ),
            ),
        )
    )


def repeated_days(days: DataFrame, keys: Sequence[str], max_gap_days: int) -> DataFrame:
    """Of ``days(keys, _day, _n, _first)`` those with several lines or with a near day before: ``_previous``, ``_near``."""
    by_day = Window.partitionBy(*keys).orderBy("_day")
    return (
        days.withColumn("_previous", F.lag("_day").over(by_day))
        .withColumn("_near", F.coalesce(F.datediff("_day", "_previous") <= max_gap_days, F.lit(False)))
        .where(F.col("_day").isNotNull() & ((F.col("_n") > 1) | F.col("_near")))
    )


def neighbour_days(lines: DataFrame, keys: Sequence[str] = ("bill_id", "code")) -> DataFrame:
    """Per key and day: number of lines, and the day before and after it."""
    by_day = Window.partitionBy(*keys).orderBy("service_day")
    return (
        lines.withColumn("service_day", parse_service_date(F.col("service_date")))
        .where("service_day is not null")
        .groupBy(*keys, "service_day")
        .agg(F.count("*").alias("n_lines"))
        .withColumn("previous_day", F.lag("service_day").over(by_day))
        .withColumn("next_day", F.lead("service_day").over(by_day))
    )


def unbundled_pairs(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Code pairs of the bundling table that occur on the same bill.

    ``pairs(code, component_code)``: the component should not be billed next to
    the code. Distinct codes are matched through the pair table, so no bill is
    joined with itself line by line.
    """
    codes = lines.select("bill_id", "code").where("code is not null").distinct()
    expected = codes.join(pairs.select("code", "component_code").distinct(), "code")
    present = codes.withColumnRenamed("code", "component_code")
    return expected.join(present, ["bill_id", "component_code"]).select(
        "bill_id", "code", "component_code"
    )


def unbundled_lines(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines whose code belongs into another code of the same bill."""
    inside = (
        unbundled_pairs(lines, pairs)
        .groupBy("bill_id", F.col("component_code").alias("_component"))
        .agg(F.min("code").alias("_whole"))
    )
    coded = lines.withColumn("_component", F.col("code"))
    return coded.join(staged_if_small(inside), ["bill_id", "_component"]).select(
        *_line(lines), *finding_columns("unbundling", c.UNBUNDLING_SEVERITY, related=F.col("_whole"))
    )


def summary_bill_lines(lines: DataFrame) -> DataFrame:
    """Lines of bills that carry no code at all: ask for an itemised bill."""
    coded = F.col("code").isNotNull()
    itemised = lines.where(coded).select("bill_id").distinct()
    return (
        lines.where(~coded)
        .join(itemised, "bill_id", "left_anti")
        .select(
            *_line(lines),
            *finding_columns("unknown_code", c.SUMMARY_BILL_SEVERITY, related=F.lit("summary bill")),
        )
    )


def uncoded_lines(
    lines: DataFrame, best_matches: DataFrame, min_score: float
) -> DataFrame:
    """Uncoded lines of itemised bills without a close match in the catalog.

    ``best_matches(description, code, similarity_score)`` holds the best match
    of every description.
    """
    coded = F.col("code").isNotNull()
    itemised = lines.where(coded).select("bill_id").distinct()
    close = (
        best_matches.where(F.col("similarity_score") >= min_score).select("description").distinct()
    )
    return (
        lines.where(~coded)
        .join(itemised, "bill_id", "left_semi")
        .join(close, "description", "left_anti")
        .select(*_line(lines), *finding_columns("unknown_code", c.UNCODED_LINE_SEVERITY))
    )


def union_findings(*findings: DataFrame) -> DataFrame:
    """One list of findings."""
    return reduce(lambda a, b: a.unionByName(b), (f.select(*FINDING) for f in findings))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def with_explanations(findings: DataFrame) -> DataFrame:
    """Explanation and suggested action, worded from the finding's own facts."""
    # Worded once each: the sentences below name them many times.
    words = {
        "_billed": F.coalesce(F.concat(F.lit("$"), fixed(F.col("billed_amount"), 2)), F.lit("an unreadable amount")),
        "_ratio_text": fixed(F.col("overcharge_ratio"), 1),
        "_price_text": fixed(F.col("medicare_reference_price"), 2),
    }
    code = F.coalesce("code", F.lit("(none)"))
    date = F.coalesce("service_date", F.lit("unknown"))
    billed = F.col("_billed")
    kind = F.col("anomaly_type")
    no_code = F.col("code").isNull()
    summary_bill = F.coalesce(F.col("related") == "summary bill", F.lit(False))

    related = F.col("related")

    # The sentences with placeholders follow the published wording.
    explanation = (
        F.when(
            kind == "price_overcharge",
            _say(
                "Code ", code, " was billed at ", billed, ", which is ",
                F.col("_ratio_text"), "x the Medicare reference rate of $", F.col("_price_text"), ".",
            ),
        )
        .when(
            kind == "duplicate_charge",
            _say("Code ", code, " was billed for ", billed, " on ", date, " and had already been billed on ", related, "."),
        )
        .when(
            kind == "unbundling",
            _say(
                "Code ", code, " was billed separately for ", billed,
                " although it is part of code ", related, " on the same bill.",
            ),
        )
        .when(
            kind == "upcoding",
            _say(
                "Code ", code, " was billed for ", billed,
                ", but the description fits the cheaper code ", related, " better.",
            ),
        )
        .when(
            summary_bill,
            _say("This line was billed for ", billed, " on a summary bill without procedure codes."),
        )
        .when(
            no_code,
            _say("This line was billed for ", billed, " without a code and matches no known procedure."),
        )
        .otherwise(_say("Code ", code, " was billed for ", billed, " but is not in the code list."))
    )
    action = (
        F.when(
            kind == "duplicate_charge",
            _say("Ask your provider why code ", code, " appears twice on dates ", related, " and ", date, "."),
        )
        .when(
            kind == "unbundling",
            _say(
                "Contact your insurance company to confirm this code should not be bundled with ",
                related, ".",
            ),
        )
        .when(
            no_code,
            F.lit("Request a full itemized bill with procedure codes before disputing this charge."),
        )
        .otherwise(
            _say("Request an itemized bill and ask your provider to explain the charge for code ", code, ".")
        )
    )
    worded = findings.withColumns(words).withColumns({"explanation": explanation, "suggested_action": action})
    return worded.drop(*words)


def _finding(kind: str, severity: Column | str, when: Column, **facts: Column) -> Column:
    """The finding as a struct where ``when`` holds, else null."""
    return F.when(when, F.struct(*finding_columns(kind, severity, **facts)))


def detect_anomalies(
    lines: DataFrame,
    catalog: DataFrame,
    pairs: DataFrame | None = None,
    per_unit: bool = False,
    max_gap_days: int = 1,
    upcoded: DataFrame | None = None,
    uncoded: DataFrame | None = None,
    fits: DataFrame | None = None,
    close: DataFrame | None = None,
    worded: bool = True,
) -> DataFrame:
    """All findings of all bills, unordered.

    The lines are written once with their day. One aggregation of that table, a row for each
    bill, code and day, gives the rare facts of the rules on several lines; then all rules are
    judged in one pass over the lines, which are not shuffled for it as long as the facts are
    small enough to travel.

    The two similarity rules come with ``fits(code, description, other_code, price)``, charged
    pairs that a cheaper code fits better, and ``close(description)``, the descriptions that
    the catalog holds; or as findings of their own, ``upcoded`` and ``uncoded``.

    Without ``worded`` the findings come without explanation and suggested action, which follow
    from the other columns: letters and documents word them where they need them.
    """
    lines = materialise(lines.select(*LINE, parse_service_date(F.col("service_date")).alias("_day")))
    days = materialise(
        lines.groupBy("bill_id", "code", "_day").agg(F.count("*").alias("_n"), F.min("line_no").alias("_first"))
    )
    codes = days.select("bill_id", "code").where("code is not null").distinct()
    prices = broadcast_if_small(
        catalog.select(
            F.col("code").alias("_key"),
            F.when(F.col("has_price_data"), F.col("medicare_reference_price")).alias("_price"),
        )
    )
    repeats = repeated_days(days.where("code is not null"), ["bill_id", "code"], max_gap_days).drop("_n")
    # Bills without any code; most have some.
    bare = days.groupBy("bill_id").agg(F.count("code").alias("_codes")).where("_codes = 0").drop("_codes")
    judged = (
        lines.join(prices, F.col("code") == F.col("_key"), "left")
        .join(staged_if_small(repeats), ["bill_id", "code", "_day"], "left")
        .join(staged_if_small(bare.withColumn("_bare", F.lit(True))), "bill_id", "left")
    )
    coded = F.col("code").isNotNull()
    billed = F.try_divide(F.col("billed_amount"), F.col("quantity")) if per_unit else F.col("billed_amount")
    ratio = F.try_divide(billed, F.col("_price"))
    price = F.col("_price")
    later = F.col("line_no") > F.col("_first")
    found = [
        _finding("price_overcharge", overcharge_severity(ratio), overcharge_severity(ratio).isNotNull(), price=price, ratio=ratio),
        _finding("unknown_code", c.UNKNOWN_CODE_SEVERITY, coded & F.col("_key").isNull()),
        _finding(
            "duplicate_charge",
            F.when(later, c.SAME_DAY_DUPLICATE_SEVERITY).otherwise(c.ADJACENT_DUPLICATE_SEVERITY),
            later | F.col("_near"),
            related=F.date_format(F.when(later, F.col("_day")).otherwise(F.col("_previous")), "MM/dd/yyyy"),
        ),
        _finding("unknown_code", c.SUMMARY_BILL_SEVERITY, F.col("_bare"), related=F.lit("summary bill")),
    ]
    if pairs is not None:
        inside = (
            unbundled_pairs(codes, pairs)
            .groupBy("bill_id", F.col("component_code").alias("code"))
            .agg(F.min("code").alias("_whole"))
        )
        judged = judged.join(staged_if_small(inside), ["bill_id", "code"], "left")
        found.append(
            _finding("unbundling", c.UNBUNDLING_SEVERITY, F.col("_whole").isNotNull(), related=F.col("_whole"))
        )
    if fits is not None:
        other = fits.select("code", "description", F.col("other_code").alias("_other"), F.col("price").alias("_own_price"))
        judged = judged.join(staged_if_small(other), ["code", "description"], "left")
        found.append(
            _finding(
                "upcoding", c.UPCODING_SEVERITY, F.col("_other").isNotNull(), price=F.col("_own_price"), related=F.col("_other")
            )
        )
    if close is not None:
        known = close.select("description").distinct().withColumn("_close", F.lit(True))
        judged = judged.join(staged_if_small(known), "description", "left")
        found.append(
            _finding("unknown_code", c.UNCODED_LINE_SEVERITY, ~coded & F.col("_bare").isNull() & F.col("_close").isNull())
        )
    findings = judged.select(*LINE, F.inline(F.array_compact(F.array(*found))))
    extra = [more for more in (upcoded, uncoded) if more is not None]
    every = union_findings(findings, *extra)
    return with_explanations(every) if worded else every


def with_ranks(findings: DataFrame) -> DataFrame:
    """Add the columns findings are ordered by inside a bill: high first."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumn(
        "type_rank", type_rank(F.col("anomaly_type"))
    )


# The whole line takes part, so that equal ordinals leave no ties open.
FINDING_ORDER = (
    "severity_rank",
    "line_no",
    "type_rank",
    "code",
    "billed_amount",
    "quantity",
    "service_date",
    "description",
)


def number_anomalies(
    findings: DataFrame, sizes: DataFrame | None = None, hot_rows: int = c.HOT_KEY_ROWS
) -> DataFrame:
    """Number the findings of every bill from 1, most severe first.

    ``sizes``: optional cheaper frame with at least as many rows per bill.
    """
    return number_rows(
        with_ranks(findings), "bill_id", FINDING_ORDER, "anomaly_no", sizes, hot_rows
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings sorted by bill and severity."""
    return with_ranks(findings).orderBy("bill_id", *FINDING_ORDER).drop("severity_rank", "type_rank")
