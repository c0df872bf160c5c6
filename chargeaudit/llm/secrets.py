"""Secret scans: fixed patterns, and character models of random strings and identifiers.

Only DataFrame functions are used. Pattern spans come from splitting a text at the
pattern: the lengths of what stands between and of what matched give every position.
Two Markov models over pairs of characters are trained from labelled strings: values that
the fixed patterns found and that mix letters and digits are random, other long runs without
a digit before a letter are ordinary. The
counts cover every document; the models have a fixed number of pairs, so only a table of
bounded size reaches the driver. A run is reported if the log-likelihood ratio of the two
models, summed over its pairs, is above ``MIN_RATIO``, it holds a digit and a letter and it
meets no span of a fixed pattern.

Defined results: null and empty texts have no spans; offsets count code points, ends are
exclusive; columns besides those named are kept unless called like a result column;
repeated rows each have their spans; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.llm.common import table, text_or_empty

# Kinds in the order of their names in results, with pattern, group and least length.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A run of at least so many characters begins where the longest run begins, so the bound stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_RATIO = 20.0
PRIOR = 10.0
SIDE = len(ALPHABET) + 1
PAIRS = SIDE * SIDE

SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        found.alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    nothing = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

    def step(held: Column, row: Column) -> Column:
        begin = held["at"] + F.length(row["between"])
        end = begin + F.coalesce(F.length(row["found"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(row["value"]) >= least, F.concat(held["spans"], F.array(span))).otherwise(held["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda held: held["spans"])).otherwise(nothing)


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``assign``, ``access``, ``hex`` and, for the models, ``runs``: arrays of spans in order."""
    own = F.col(text)
    return df.withColumn(text, text_or_empty(text)).withColumns(
        {
            "assign": _spans(own, ASSIGN, 0, 2, ASSIGN_LEAST),
            "access": _spans(own, ACCESS, 1, 0, 0),
            "hex": _spans(own, HEX, 2, 0, 0),
            "runs": _spans(own, CANDIDATE, 3, 0, LEAST),
        }
    )


def _meets(one: Column, other: Column) -> Column:
    return (one["start"] < other["end"]) & (other["start"] < one["end"])


def _apart() -> Column:
    """Runs that meet no span of a fixed pattern."""
    return F.filter("runs", lambda run: ~F.exists("base", lambda span: _meets(run, span)))


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def _pair_indexes(value: Column) -> Column:
    """Number of each pair of neighbouring characters; 0 stands for what is outside of the alphabet."""
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    before, after = F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1)
    return F.zip_with(before, after, lambda a, b: a * SIDE + b)


def train(spans: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio of each pair of characters, random against ordinary.

    Both models give the chance of a character after the one before; counts of a pair are
    mixed with the chance of the character itself, as ``PRIOR`` further observations.
    """

    def value(span: Column) -> Column:
        whole = _cut(F.col(text), span)
        return F.when(span["kind"] == 0, F.regexp_extract(whole, ASSIGN, 2)).otherwise(whole)

    random = F.transform("base", lambda s: F.struct(value(s).alias("value"), F.lit(1).alias("random")))
    ordinary = F.transform("runs", lambda s: F.struct(value(s).alias("value"), F.lit(0).alias("random")))
    own = F.col("sample.value")
    labelled = F.when(F.col("sample.random") == 1, _mixed(own)).otherwise(~own.rlike("[0-9][A-Za-z]"))
    counts = (
        spans.where((F.size("base") > 0) | (F.size("runs") > 0))
        .select(F.explode(F.concat(random, ordinary)).alias("sample"))
        .where(labelled)
        .select("sample.random", F.explode(_pair_indexes(own)).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )  # at most two rows for each pair
    both = [[0.0] * PAIRS, [0.0] * PAIRS]
    for row in counts:
        both[row["random"]][row["pair"]] += row["count"]
    chances = []
    for model in both:
        before = [sum(model[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)]
        single = [(sum(model[b::SIDE]) + 1) / (sum(model) + SIDE) for b in range(SIDE)]
        chances.append(
            [math.log((n + PRIOR * single[p % SIDE]) / (before[p // SIDE] + PRIOR)) for p, n in enumerate(model)]
        )
    return [r - o for o, r in zip(*chances, strict=True)]


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _ratio(value: Column, model: Column) -> Column:
    return F.aggregate(_pair_indexes(value), F.lit(0.0), lambda total, pair: total + model[pair])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.concat_ws(",", parts)


def secret_spans(df: DataFrame, text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (start, kind, end) in order; the models only add to ``base``."""
    own = df.drop("assign", "access", "hex", "runs", "base", "spans")
    found = with_base_spans(own, text).withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    found = found.withColumn("runs", F.when(F.size("base") > 0, _apart()).otherwise(F.col("runs")))
    model = F.lit(train(found, text)).cast("array<double>")

    def suspicious(span: Column) -> Column:
        value = _cut(F.col(text), span)
        return _mixed(value) & (_ratio(value, model) >= min_ratio)

    added = F.when(F.size("runs") > 0, F.filter("runs", suspicious)).otherwise(F.col("runs"))
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("runs")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, spans that meet taken together, replaced by ``[SECRET]``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, span: Column) -> Column:
        before = F.substring(text, held["at"] + 1, span["start"] - held["at"])
        fresh = F.struct(span["end"].alias("at"), F.concat(held["out"], before, F.lit("[SECRET]")).alias("out"))
        longer = F.struct(F.greatest(held["at"], span["end"]).alias("at"), held["out"].alias("out"))
        return F.when((span["start"] >= held["at"]) | (held["out"] == ""), fresh).otherwise(longer)

    def rest(held: Column) -> Column:
        return F.concat(held["out"], F.substring(text, held["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; ``n_chars`` follows the text. A null text stays null."""
    found = secret_spans(docs.withColumn("_null", F.col("text").isNull()))
    text = F.when(F.col("_null"), F.lit(None)).otherwise(masked(F.col("text"), F.col("spans")))
    length = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", length).select(*docs.columns)
