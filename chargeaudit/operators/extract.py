"""Pages to bill text, bill text to candidate codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.patterns import spark_regex
from chargeaudit.functions.text import is_blank, join_ordered, ws_trim
from chargeaudit.operators.numbering import number_rows, top_per_key

_CODE_REGEX = spark_regex(c.TEXT_CODE_PATTERN, ignore_case=True)


def assemble_pages(
    pages: DataFrame, key: str = "bill_id", pages_per_part: int = c.PAGES_PER_PART
) -> DataFrame:
    """Join the pages ``(key, page_no, text)`` of every document.

    Blank pages are dropped, the others keep their own number in a heading.
    The text comes in parts of at most ``pages_per_part`` pages, numbered from
    1, so that no document has to fit into one task; most have one part. A
    document without a readable page has one part with a null text.
    """
    body = ws_trim(F.col("text"))
    # Page heading and separator.
    block = F.when(
        ~is_blank(F.col("text")),
        F.concat(F.format_string("[Page %d]", F.col("page_no")), F.lit("\n"), body),
    )
    numbered = pages.select(
        key,
        F.col("page_no"),
        block.alias("block"),
        (F.floor((F.col("page_no") - 1) / pages_per_part) + 1).cast("int").alias("part_no"),
    )
    readable = (
        numbered.where("block is not null")
        .groupBy(key, "part_no")
        .agg(
            F.count("*").alias("n_pages"),
            join_ordered(F.col("page_no"), F.col("block"), "\n\n").alias("text"),
        )
    )
    documents = pages.select(key).distinct()
    return documents.join(readable, key, "left").select(
        key,
        F.coalesce("part_no", F.lit(1)).alias("part_no"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        "text",
        F.when(F.col("text").isNull(), "ocr_failed").otherwise("ok").alias("status"),
    )


def with_text_status(
    bills: DataFrame, text_col: str = "redacted_text", min_chars: int = c.MIN_BILL_CHARS
) -> DataFrame:
    """Mark bills whose text is too short to analyse."""
    length = F.coalesce(F.length(ws_trim(F.col(text_col))), F.lit(0))
    return bills.withColumn("meaningful_chars", length.cast("bigint")).withColumn(
        "text_status", F.when(length < min_chars, "bill_too_short").otherwise("ok")
    )


def codes_in(text: Column) -> Column:
    """All code candidates of a text in upper case, in order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(_CODE_REGEX), 1), F.upper)


def candidate_codes(
    bills: DataFrame,
    text_col: str = "redacted_text",
    key: str = "bill_id",
    limit: int | None = None,
) -> DataFrame:
    """Distinct codes of every text as first seen, all or at most ``limit``.

    One text is one row, so nothing is shuffled.
    """
    codes = F.array_distinct(codes_in(F.col(text_col)))
    if limit is not None:
        codes = F.slice(codes, 1, limit)
    return bills.select(key, F.posexplode(codes).alias("_at", "code")).select(
        key, "code", (F.col("_at") + 1).alias("position")
    )


def candidate_codes_of_pages(
    pages: DataFrame,
    order: Sequence[str],
    text_col: str = "text",
    key: str = "bill_id",
    limit: int | None = None,
) -> DataFrame:
    """The same for bills that are spread over rows, read in ``order``.

    Every row is reduced to its own distinct codes and every bill to its
    distinct codes before anything is ranked. Of codes that rows of equal
    ``order`` name at the same place the smaller one comes first.
    """
    found = pages.select(
        key,
        F.struct(*order).alias("_page"),
        F.posexplode(F.array_distinct(codes_in(F.col(text_col)))).alias("_at", "code"),
    )
    first = found.groupBy(key, "code").agg(F.min(F.struct("_page", "_at")).alias("_first"))
    if limit is None:  # the shape of a code bounds the distinct ones of a bill
        place = F.row_number().over(Window.partitionBy(key).orderBy("_first", "code"))
        return first.withColumn("position", place).drop("_first")
    return top_per_key(first, [key], ["_first", "code"], limit, "position").drop("_first")


def bill_texts(
    lines: DataFrame,
    order: Sequence[str],
    text: Column,
    key: str = "bill_id",
    lines_per_part: int = c.PAGES_PER_PART,
) -> DataFrame:
    """Bill text out of charge lines: one text line each, in numbered parts."""
    rows = lines.withColumn("_text", text)
    numbered = number_rows(rows, key, order, "_no")
    part = (F.floor((F.col("_no") - 1) / lines_per_part) + 1).cast("int")
    return (
        numbered.groupBy(key, part.alias("part_no"))
        .agg(join_ordered(F.col("_no"), F.col("_text"), "\n").alias("redacted_text"))
    )
