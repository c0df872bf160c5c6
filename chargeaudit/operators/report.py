"""Findings to texts people read: context, brief, letter, nested document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.text import fixed, join_ordered, normalise_code
from chargeaudit.operators.rules import number_anomalies, with_explanations
from chargeaudit.operators.summary import subject_lines


def _dollars(col: Column) -> Column:
    return F.concat(F.lit("$"), fixed(col, 2))


def _price_cell(flag: Column, price: Column) -> Column:
    return F.when(flag, _dollars(price)).otherwise("N/A")


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def _cut(text: Column) -> Column:
    return F.substring(text, 1, c.TABLE_DESCRIPTION_CHARS)


# Headings and sentences of the review context.
_CONTEXT_FOUND = (
    "## Catalog records\n\n"
    "The following codes were found in the bill text and looked up in the catalog. "
    "These records are exact; they need no search.\n\n"
    "| Code | Short Description | Medicare Ref Price | Has Price Data |\n"
    "|------|------------------|--------------------|----------------|\n"
)
_CONTEXT_NONE = (
    "## Catalog records\n\n"
    "No codes were found in the bill text. "
    "Search the catalog by description for what the text mentions."
)
_CONTEXT_END = (
    "\n\n---\n\n"
    "Please judge the charges of this bill. "
    "Give every finding as one record with its line, kind and severity."
)


def review_context(bills: DataFrame, lookups: DataFrame, keys: tuple[str, ...] = ("bill_id",)) -> DataFrame:
    """Bill text and the table of its looked-up codes as one text per bill.

    ``bills(keys, original_filename, file_type, redacted_text)``;
    ``lookups(keys, position, code, short_description, ...)`` holds found codes
    only, at most ``MAX_CODES_PER_BILL`` per bill.
    """
    row = F.format_string(
        "| %s | %s | %s | %s |",
        F.col("code"),
        _cut(F.col("short_description")),
        _price_cell(F.col("has_price_data"), F.col("medicare_reference_price")),
        _yes_no(F.col("has_price_data")),
    )
    tables = lookups.groupBy(*keys).agg(
        join_ordered(F.col("position"), row, "\n").alias("_rows"), F.count("*").alias("n_codes")
    )
    head = F.concat(
        F.lit("## Redacted Medical Bill\n\n"),
        F.format_string("File: %s  |  Type: %s", F.col("original_filename"), F.col("file_type")),
        F.lit("\n\n```\n"),
        F.col("redacted_text"),
        F.lit("\n```\n\n"),
    )
    table = F.when(F.col("_rows").isNull(), F.lit(_CONTEXT_NONE)).otherwise(
        F.concat(F.lit(_CONTEXT_FOUND), F.col("_rows"))
    )
    return bills.join(tables, list(keys), "left").select(
        *keys,
        F.coalesce("n_codes", F.lit(0)).alias("n_codes"),
        F.concat(head, table, F.lit(_CONTEXT_END)).alias("context"),
    )


def format_matches(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Search results of every query as one text table.

    ``queries(query_id, query)``; ``matches`` as returned by
    ``search_similar`` with the catalog record joined.
    """
    row = F.format_string(
        "| %s | %s | %s | %s | %s |",
        F.col("code"),
        _cut(F.col("short_description")),
        _price_cell(F.col("has_price_data"), F.col("medicare_reference_price")),
        _yes_no(F.col("has_price_data")),
        F.coalesce(fixed(F.col("similarity_score"), 2), F.lit("n/a")),
    )
    tables = matches.groupBy("query_id").agg(
        F.count("*").alias("n_results"), join_ordered(F.col("rank"), row, "\n").alias("_rows")
    )
    # Headings of the result table.
    found = F.concat(
        F.format_string("Search results for '%s' (%d found):\n\n", F.col("query"), F.col("n_results")),
        F.lit("| Code | Short Description | Medicare Ref Price | Has Price Data | Similarity |\n"),
        F.lit("|------|------------------|--------------------|----------------|------------|\n"),
        F.col("_rows"),
    )
    none = F.concat(
        F.format_string("No results found for '%s'. ", F.col("query")),
        F.lit("The code or procedure may not be in the HCPCS database."),
    )
    return queries.join(tables, "query_id", "left").select(
        "query_id",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("_rows").isNull(), none).otherwise(found).alias("result_text"),
    )


def _part(number: Column, per_part: int) -> Column:
    return (F.floor((number - 1) / per_part) + 1).cast("int")


def findings_brief(
    findings: DataFrame,
    summary: DataFrame,
    per_part: int = c.FINDINGS_PER_PART,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Facts of every bill with findings as text, in parts.

    Part 1 opens with the summary and every part lists up to ``per_part``
    findings, so a bill of any size is covered by rows of bounded size.
    """
    item_code = F.when(
        normalise_code(F.col("code")).isNotNull(), F.concat(F.lit(" (code: "), F.col("code"), F.lit(")"))
    ).otherwise("")
    # Headings and labels of the brief.
    entry = F.concat_ws(
        "\n",
        F.format_string(
            "### Anomaly %d: %s — %s severity",
            F.col("anomaly_no"),
            F.upper("anomaly_type"),
            F.upper("severity"),
        ),
        F.concat(F.lit("Service: "), F.col("description"), item_code),
        F.concat(
            F.lit("Billed: "), F.coalesce(_dollars(F.col("billed_amount")), F.lit("unknown amount"))
        ),
        F.concat(F.lit("Medicare reference price: "), _dollars(F.col("medicare_reference_price"))),
        F.concat(F.lit("Overcharge ratio: "), fixed(F.col("overcharge_ratio"), 1), F.lit("x Medicare rate")),
        F.concat(F.lit("Service date: "), F.nullif(F.col("service_date"), F.lit(""))),
        F.concat(F.lit("Explanation: "), F.col("explanation")),
        F.concat(F.lit("Suggested action: "), F.col("suggested_action")),
        F.lit(""),
    )
    parts = (
        number_anomalies(findings, sizes)
        .withColumn("_entry", entry)
        .groupBy("bill_id", _part(F.col("anomaly_no"), per_part).alias("part_no"))
        .agg(join_ordered(F.col("anomaly_no"), F.col("_entry"), "\n").alias("_entries"))
    )
    head = F.concat_ws(
        "\n",
        F.lit("## Bill Analysis Summary"),
        F.lit(""),
        F.format_string("Total line items analysed: %d", F.col("total_line_items")),
        F.format_string("Anomalies found: %d", F.col("anomaly_count")),
        F.format_string("High severity: %d", F.col("high_severity_count")),
        F.format_string("Medium severity: %d", F.col("medium_severity_count")),
        F.concat(
            F.lit("Estimated potential overcharge: "), _dollars(F.col("potential_overcharge_total"))
        ),
        F.lit(""),
        F.lit("## Anomalies to Address in the Letter"),
        F.lit("\n"),
    )
    return parts.join(summary, "bill_id").select(
        "bill_id",
        "part_no",
        F.concat(F.when(F.col("part_no") == 1, head).otherwise(""), F.col("_entries")).alias("brief"),
    )


_OPENING = (
    "Dear Billing Department,\n\n"
    "I am writing to ask for a review of my bill. I found %d charge(s) that I would like you to explain or correct."
)
_CONTINUED = "This is part %d of my letter and continues the list of charges."
_CLOSING = (
    "Please review these charges, send me an itemized bill, and reply in writing within 30 days. "
    "Thank you for your help."
)


def _anomaly() -> Column:
    """A finding as a document lists it."""
    return F.struct(
        "anomaly_no",
        F.struct("code", "description", "quantity", "billed_amount", "service_date").alias("line_item"),
        "anomaly_type",
        "severity",
        "explanation",
        "medicare_reference_price",
        "overcharge_ratio",
        "suggested_action",
    )


def _words() -> Column:
    """What a letter needs of it."""
    line = F.struct("code", "description").alias("line_item")
    return F.struct("anomaly_no", line, "severity", "explanation", "suggested_action")


def _listed(findings: DataFrame, finding: Column, per_part: int, sizes: DataFrame | None) -> DataFrame:
    """``anomalies``: the numbered findings of every bill in parts, in order.

    Findings without words get them when they are numbered, so that no words are shuffled.
    """
    numbered = number_anomalies(findings, sizes)
    worded = numbered if "explanation" in numbered.columns else with_explanations(numbered)
    return (
        worded.groupBy("bill_id", _part(F.col("anomaly_no"), per_part).alias("part_no"))
        .agg(F.sort_array(F.collect_list(finding)).alias("anomalies"))
    )


def letters(
    findings: DataFrame,
    per_part: int = c.FINDINGS_PER_PART,
    sizes: DataFrame | None = None,
    keep_findings: bool = False,
) -> DataFrame:
    """Letter of every bill with findings; clean bills have none.

    High and medium findings get a paragraph each, the minor ones of a part
    share one. Bills with more than ``per_part`` findings get the letter in
    numbered parts. With ``keep_findings`` a part brings its findings along as
    ``anomalies``, so that documents need not number them and meet again.
    """
    rows = F.col("anomalies")

    def said(of: Column, words: Callable[[Column], Column], separator: str) -> Column:
        return F.array_join(F.transform(of, words), separator)

    def is_major(row: Column) -> Column:
        return row["severity"].isin("high", "medium")

    parts = _listed(findings, _anomaly() if keep_findings else _words(), per_part, sizes).withColumns(
        {
            "_majors": said(
                F.filter(rows, is_major), lambda row: F.concat(row["explanation"], F.lit(" "), row["suggested_action"]), "\n\n"
            ),
            "_minors": said(
                F.filter(rows, lambda row: ~is_major(row)),
                lambda row: F.concat_ws(": ", row["line_item"]["description"], row["explanation"]),
                " ",
            ),
            "anomaly_codes": F.array_distinct(
                F.array_compact(F.transform(rows, lambda row: normalise_code(row["line_item"]["code"])))
            ),
        }
    )
    opening = F.when(
        F.col("part_no") == 1, F.format_string(_OPENING, F.col("anomaly_count"))
    ).otherwise(F.format_string(_CONTINUED, F.col("part_no")))
    body = F.concat_ws(
        "\n\n",
        opening,
        F.nullif(F.col("_majors"), F.lit("")),
        F.when(
            F.col("_minors") != "",
            F.concat(F.lit("Please also look at these smaller points. "), F.col("_minors")),
        ),
        F.lit(_CLOSING),
    )
    columns = ["bill_id", "part_no", "subject_line", body.alias("body"), "anomaly_codes"]
    listed = parts if keep_findings else parts.drop("anomalies")
    return listed.join(subject_lines(findings), "bill_id").select(*columns, *(["anomalies"] if keep_findings else []))


def letter_citations(letter_rows: DataFrame) -> DataFrame:
    """How often, and where first, a letter names each of its codes as a word."""
    cited = letter_rows.select("bill_id", "part_no", "body", F.explode("anomaly_codes").alias("code"))
    # The code comes first and its left edge is looked back at: a pattern that begins with plain
    # signs is searched by leaps, one that begins with an edge is tried at every sign of the body.
    quoted = F.concat(F.lit(r"\Q"), F.col("code"), F.lit(r"\E(?<=\b\Q"), F.col("code"), F.lit(r"\E)\b"))
    return cited.select(
        "bill_id",
        "part_no",
        "code",
        F.regexp_count(F.col("body"), quoted).cast("bigint").alias("n_citations"),
        F.regexp_instr(F.col("body"), quoted).cast("bigint").alias("first_at"),
    )


def to_documents(
    findings: DataFrame,
    summary: DataFrame,
    letter_rows: DataFrame,
    per_part: int = c.FINDINGS_PER_PART,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One nested JSON document per bill (and part), the way a client reads it.

    Letters that bring their findings along (``keep_findings``) are not matched with them anew.
    """
    facts = F.struct(
        "total_line_items",
        "total_billed_amount",
        "anomaly_count",
        "high_severity_count",
        "medium_severity_count",
        "potential_overcharge_total",
    )
    letter = F.struct("subject_line", "body", "anomaly_codes").alias("dispute_letter")
    if "anomalies" in letter_rows.columns:
        nested = letter_rows.select("bill_id", "part_no", letter, "anomalies")
    else:
        keys = ["bill_id", "part_no"]
        nested = _listed(findings, _anomaly(), per_part, sizes).join(letter_rows.select(*keys, letter), keys, "left")
    empty = F.array().cast(nested.schema["anomalies"].dataType)
    return (
        summary.join(nested, "bill_id", "left")
        .withColumn("part_no", F.coalesce("part_no", F.lit(1)))
        .select(
            "bill_id",
            "part_no",
            F.to_json(
                F.struct(
                    F.coalesce("anomalies", empty).alias("anomalies"),
                    "dispute_letter",
                    facts.alias("bill_summary"),
                ),
                {"ignoreNullFields": "false"},
            ).alias("document"),
        )
    )


# Fields of a response document by name and kind of value; no others may occur.
_TEXT, _WHOLE, _NUMBER = ("STRING",), ("BIGINT",), ("BIGINT", "DOUBLE", "DECIMAL")
_NONE = ("VOID",)
LINE_FIELDS = {
    "code": _TEXT + _NONE, "description": _TEXT + _NONE, "quantity": _WHOLE + _NONE,
    "billed_amount": _NUMBER + _NONE, "service_date": _TEXT + _NONE,
}
ANOMALY_FIELDS = {
    "anomaly_no": _WHOLE, "line_item": ("OBJECT",), "anomaly_type": _TEXT, "severity": _TEXT, "explanation": _TEXT,
    "medicare_reference_price": _NUMBER + _NONE, "overcharge_ratio": _NUMBER + _NONE, "suggested_action": _TEXT,
}
SUMMARY_FIELDS = {
    "total_line_items": _WHOLE, "total_billed_amount": _NUMBER + _NONE, "anomaly_count": _WHOLE,
    "high_severity_count": _WHOLE, "medium_severity_count": _WHOLE, "potential_overcharge_total": _NUMBER + _NONE,
}
LETTER_FIELDS = {"subject_line": _TEXT, "body": _TEXT, "anomaly_codes": ("ARRAY",)}
DOCUMENT_FIELDS = {"anomalies": ("ARRAY",), "dispute_letter": ("OBJECT",) + _NONE, "bill_summary": ("OBJECT",)}


# A document as it is read: each field with its own type.
_LINE_TYPE = "struct<code: string, description: string, quantity: bigint, billed_amount: double, service_date: string>"
_ANOMALY_TYPE = (
    f"struct<anomaly_no: bigint, line_item: {_LINE_TYPE}, anomaly_type: string, severity: string, explanation: string, "
    "medicare_reference_price: double, overcharge_ratio: double, suggested_action: string>"
)
_LETTER_TYPE = "struct<subject_line: string, body: string, anomaly_codes: array<string>>"
_SUMMARY_TYPE = (
    "struct<total_line_items: bigint, total_billed_amount: double, anomaly_count: bigint, high_severity_count: bigint, "
    "medium_severity_count: bigint, potential_overcharge_total: double>"
)
_DOCUMENT_TYPE = f"struct<anomalies: array<{_ANOMALY_TYPE}>, dispute_letter: {_LETTER_TYPE}, bill_summary: {_SUMMARY_TYPE}>"


def _field(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT and so on; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _wrong_fields(value: Column, fields: dict[str, tuple[str, ...]], place: str) -> Column:
    """What is missing, of the wrong kind or not known in an object; an empty list if all is well."""
    wrong = [
        F.when(~F.coalesce(_kind(_field(value, name)).isin(*kinds), F.lit(False)), F.lit(f"{place}{name}"))
        for name, kinds in fields.items()
    ]
    names = F.map_keys(value.try_cast("map<string, variant>"))
    unknown = F.transform(
        F.array_except(names, F.array(*[F.lit(name) for name in fields])),
        lambda name: F.concat(F.lit(f"unknown {place}"), name),
    )
    return F.array_compact(F.concat(F.array(*wrong), F.coalesce(unknown, F.array().cast("array<string>"))))


def _reads_back(read: Column, text: Column) -> Column:
    """Whether a document is sound for certain: written out as it was read, it is the very same text.

    Then no field is missing, of the wrong kind or not known, and what is left to see is that
    no needed value is null and that the findings are numbered one after the other.
    """

    def there(value: Column, fields: dict[str, tuple[str, ...]]) -> list[Column]:
        return [value[name].isNotNull() for name, kinds in fields.items() if _NONE[0] not in kinds]

    def all_of(tests: list[Column]) -> Column:
        return reduce(lambda one, other: one & other, tests)

    items, letter = read["anomalies"], read["dispute_letter"]
    numbered = F.transform(
        items, lambda item, at: all_of([*there(item, ANOMALY_FIELDS), item["anomaly_no"] == items[0]["anomaly_no"] + at])
    )
    tests = [
        F.to_json(read, {"ignoreNullFields": "false"}) == text,
        ~text.rlike('"(NaN|-?Infinity)"'),  # numbers that are no JSON are written as texts
        F.forall(numbered, lambda sound: sound),
        *there(read, DOCUMENT_FIELDS),
        letter.isNull() | all_of(there(letter, LETTER_FIELDS)),
        *there(read["bill_summary"], SUMMARY_FIELDS),
    ]
    return F.coalesce(all_of(tests), F.lit(False))


def _judged(documents: DataFrame, column: str) -> DataFrame:
    """Add ``violations``, and ``_read``: a document without violations as a struct, others as null.

    Most documents read back as they were written; only the others are looked at field by field.
    """
    value = F.col("_value")
    none = F.array().cast("array<string>")

    def finding(item: Column) -> Column:
        return F.concat(
            _wrong_fields(item, ANOMALY_FIELDS, "anomalies."),
            _wrong_fields(_field(item, "line_item"), LINE_FIELDS, "line_item."),
        )

    items = F.coalesce(_field(value, "anomalies", "array<variant>"), F.array().cast("array<variant>"))
    numbers = F.transform(items, lambda item: _field(item, "anomaly_no", "bigint"))
    in_order = F.coalesce(numbers == F.transform(numbers, lambda n, at: numbers[0] + at), F.lit(False))
    letter = _field(value, "dispute_letter")
    found = F.concat(
        _wrong_fields(value, DOCUMENT_FIELDS, ""),
        F.flatten(F.transform(items, finding)),
        F.when(in_order | (F.size(items) == 0), none).otherwise(F.array(F.lit("anomalies.anomaly_no"))),
        F.when(_kind(letter) == "OBJECT", _wrong_fields(letter, LETTER_FIELDS, "dispute_letter.")).otherwise(none),
        _wrong_fields(_field(value, "bill_summary"), SUMMARY_FIELDS, "bill_summary."),
    )
    # Steps of their own, each evaluated once.
    steps = documents.withColumn("_typed", F.from_json(F.col(column), _DOCUMENT_TYPE))
    steps = steps.withColumn("_sound", _reads_back(F.col("_typed"), F.col(column)))
    steps = steps.withColumn("_value", F.when(~F.col("_sound"), F.try_parse_json(F.col(column))))
    is_object = F.coalesce(_kind(value) == "OBJECT", F.lit(False))
    violations = F.when(F.col("_sound"), none).when(is_object, F.array_distinct(found)).otherwise(F.array(F.lit("document")))
    typed = F.when(F.col("_sound"), F.col("_typed")).when(F.size("violations") == 0, F.try_variant_get(value, "$", _DOCUMENT_TYPE))
    return steps.withColumn("violations", violations).withColumn("_read", typed).drop("_typed", "_sound", "_value")


def check_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """Add ``violations``: the fields of a response document that break its schema.

    A text that isn't JSON has the one violation ``document``. Each finding, its line and the
    letter and summary are checked; findings have to be numbered one after the other.
    """
    return _judged(documents, column).drop("_read")


def document_rows(documents: DataFrame, column: str = "document") -> DataFrame:
    """The findings of response documents as rows again, in order, with the facts of their letter and bill.

    Documents with violations have no rows.
    """
    keys = [name for name in documents.columns if name != column]
    read = F.col("_read")
    none = F.array().cast(f"array<{_ANOMALY_TYPE}>")
    items = _judged(documents, column).select(
        *keys,
        read["dispute_letter"]["subject_line"].alias("subject_line"),
        read["bill_summary"]["anomaly_count"].alias("anomaly_count"),
        read["bill_summary"]["total_billed_amount"].alias("total_billed_amount"),
        # Not filtered by violations before: a filter would be pushed below the steps with copies of them.
        F.explode(F.coalesce(read["anomalies"], none)).alias("_item"),
    )
    item = F.col("_item")
    return items.select(
        *keys,
        item["anomaly_no"].alias("anomaly_no"),
        *[item["line_item"][name].alias(name) for name in LINE_FIELDS],
        *[item[name].alias(name) for name in ("anomaly_type", "severity", "explanation", "suggested_action")],
        *[item[name].alias(name) for name in ("medicare_reference_price", "overcharge_ratio")],
        "subject_line",
        "anomaly_count",
        "total_billed_amount",
    )
