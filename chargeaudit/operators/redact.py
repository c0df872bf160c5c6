"""Redact personal data from text, count what was found, gate the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeaudit.functions.patterns import (
    CASE_EXTRAS,
    GUARDS,
    PROFILES,
    Guard,
    Pattern,
    spark_regex,
)
from chargeaudit.functions.text import is_blank
from chargeaudit.session import materialise


def labels(profile: str = "parity") -> list[str]:
    """Labels of a profile in pattern order, each once."""
    return list(dict.fromkeys(p.label for p in PROFILES[profile]))


def count_column(label: str) -> str:
    return "n_" + label.lower().replace("+", "_plus_")


def _regex(pattern: Pattern) -> str:
    return spark_regex(pattern.regex, pattern.ignore_case)


def _guard_inputs(text: Column) -> list[Column]:
    """What the guards look at, computed once per text."""
    odd = reduce(lambda a, b: a | b, [text.contains(letter) for letter in CASE_EXTRAS])
    return [F.lower(text).alias("_low"), odd.alias("_odd"), text.rlike(r"\p{Nd}").alias("_digit")]


def _may_match(guard: Guard, text: Column, low: Column, odd: Column, digit: Column) -> Column:
    if guard.words:
        return reduce(lambda a, b: a | b, [low.contains(word) for word in guard.words], odd)
    return digit & text.rlike(spark_regex(guard.shape))


def redact(
    df: DataFrame,
    text_col: str = "text",
    profile: str = "parity",
    out_col: str = "redacted_text",
) -> DataFrame:
    """Add the redacted text, a count per label, and the counts as a map.

    Patterns run in order, each on the text the earlier ones left. Every step
    is its own projection: one nested expression would run the earlier patterns
    again for every later one. A pattern is tried only on texts that pass its
    guard or were already changed, and only texts that match are rewritten.
    """
    original = F.col(text_col)
    blank_text = F.lit("") if profile == "strict" else original
    step = (
        df.select("*", *_guard_inputs(original), is_blank(original).alias("_blank"))
        .withColumns(
            {
                out_col: F.when(F.col("_blank"), blank_text).otherwise(original),
                "_hits": F.lit(0),
            }
        )
    )
    inputs = [F.col(name) for name in ("_low", "_odd", "_digit")]
    hits: dict[str, list[str]] = {}
    for number, (pattern, guard) in enumerate(zip(PROFILES[profile], GUARDS[profile])):
        hit = f"_hit{number}"
        regex = _regex(pattern)
        current = F.col(out_col)
        tried = ~F.col("_blank") & ((F.col("_hits") > 0) | _may_match(guard, current, *inputs))
        step = step.withColumn(
            hit, F.when(tried, F.regexp_count(current, F.lit(regex))).otherwise(0)
        ).withColumns(
            {
                out_col: F.when(
                    F.col(hit) > 0, F.regexp_replace(current, regex, pattern.token)
                ).otherwise(current),
                "_hits": F.col("_hits") + F.col(hit),
            }
        )
        hits.setdefault(pattern.label, []).append(hit)

    counts = {
        label: reduce(lambda a, b: a + b, [F.col(h) for h in columns]).cast("bigint")
        for label, columns in hits.items()
    }
    total = reduce(lambda a, b: a + b, counts.values())
    entries = F.array(
        *[F.struct(F.lit(label).alias("key"), value.alias("value")) for label, value in counts.items()]
    )
    audit = F.map_from_entries(F.filter(entries, lambda entry: entry["value"] > 0))
    results = F.struct(
        out_col,
        *[value.alias(count_column(label)) for label, value in counts.items()],
        total.alias("n_total"),
        audit.alias("audit"),
    )
    # A list of one row, taken apart again: filters on the results stop here.
    # Pushed further down they would carry a copy of every step for every use.
    own = [name for name in df.columns if name != out_col]
    return step.select(*own, F.inline(F.array(results)))


def redaction_audit(redacted: DataFrame, profile: str = "parity") -> DataFrame:
    """Totals over all texts: one row per label."""
    names = labels(profile)
    totals = redacted.agg(
        F.count("*").alias("_texts"),
        *[F.sum(count_column(n)).alias(count_column(n)) for n in names],
        *[F.count_if(F.col(count_column(n)) > 0).alias("_with_" + count_column(n)) for n in names],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("label"),
                    F.coalesce(count_column(n), F.lit(0)).alias("n_matches"),
                    F.col("_with_" + count_column(n)).alias("n_texts"),
                )
                for n in names
            ]
        )
    )
    return totals.select(rows.alias("row")).select("row.*")


def with_gate(df: DataFrame, text_col: str = "redacted_text", profile: str = "parity") -> DataFrame:
    """Add ``is_safe``: no pattern matches the text (any more).

    The strict profile checks its three riskiest patterns only. A missing text
    has nothing to leak.
    """
    checks = list(zip(PROFILES[profile], GUARDS[profile]))
    if profile == "strict":
        checks = checks[:3]

    def leaks(row: Column) -> Column:
        text, inputs = row["text"], [row[name] for name in ("_low", "_odd", "_digit")]
        return reduce(
            lambda a, b: a | b,
            [_may_match(guard, text, *inputs) & text.rlike(_regex(p)) for p, guard in checks],
        )

    # A list of one row, so that filters on the result cannot make the
    # optimizer copy the guards' inputs into every place that reads them.
    text = F.col(text_col)
    row = F.array(F.struct(text.alias("text"), *_guard_inputs(text)))
    return df.withColumn("is_safe", ~F.coalesce(F.exists(row, leaks), F.lit(False)))


def leak_gate(
    df: DataFrame, text_col: str = "redacted_text", profile: str = "parity"
) -> tuple[DataFrame, DataFrame]:
    """(rows that may go on, rows held back)."""
    gated = with_gate(df, text_col, profile)
    return gated.where("is_safe").drop("is_safe"), gated.where("not is_safe").drop("is_safe")


def publish_redacted(
    df: DataFrame, path: str, text_col: str = "text", profile: str = "parity"
) -> DataFrame:
    """Write redacted texts that pass the gate, and nothing else.

    Raw text and failing rows never reach ``path``. Returns the held rows.
    """
    gated = materialise(with_gate(redact(df, text_col, profile).drop(text_col), profile=profile))
    safe, held = gated.where("is_safe").drop("is_safe"), gated.where("not is_safe").drop("is_safe")
    safe.write.mode("overwrite").parquet(path)
    return held
