"""Quality rules: text statistics, fixed limits and robust multivariate outliers.

A document's statistics are turned into a vector (logarithms and square-root arcs, so
that shares behave alike at both ends). For every language and source, the
minimum-covariance-determinant estimate is found by concentration steps: start from
medians and median deviations, then again and again take mean and covariance of the
share of documents that is nearest by Mahalanobis distance. A document far from its
group's estimate is rejected.

All sums over a group are Spark aggregations with partial sums in each task, so a source
with a third of all rows is as cheap as any. Distances are cut at a quantile sketch whose
rank error is below 1/10,000. Each feature has a smallest spread, added to the covariance:
statistics that are nearly always zero must not reject a text for a single sign.

Defined results: a null text has no words and fails the base rules; null language or
source is a group of its own; groups with fewer than ``MIN_GROUP`` usable documents are
pooled; repeated rows each count; columns besides those read are kept by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit.llm.common import beside, table, written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"

# name -> smallest spread that counts as a difference
FEATURES = {"f_length": 0.12, "f_symbols": 0.04, "f_lines": 0.15, "f_repeats": 0.15}
NEAREST = 0.75  # share of a group that the estimate is made from
STEPS = 4
MIN_GROUP = 60
# Fixed values of the chi-square distribution with four degrees of freedom.
CUTOFF = 40.0  # less than one in twenty million lies further out
CONSISTENCY = 1.555  # makes the covariance of the nearest 75 % that of all, for normal data

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur twice or more, all occurrences counted."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    names = ids
    width = 1
    while width < window:  # names of windows twice as wide; equal names mean equal words
        step = min(width, window - width)
        pairs = names[: len(names) - step].astype(np.int64) * (int(names.max()) + 1) + names[step:]
        _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        width += step
    covered = np.zeros(len(ids) + 1, np.int32)
    again = np.flatnonzero(counts[names] > 1)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, lines with a word, repeated lines, words in repeated windows."""
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    lines = repeats = 0
    for line in text.split("\n"):
        if line.strip(SEPARATORS):
            lines += 1
            repeats += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        lines,
        repeats,
        repeated_words(ids) if len(numbers) < len(ids) else 0,
    )


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with the statistics of every whole text; they replace columns of their names."""
    kept = df.drop(*STATS.names)
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, *STATS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                stats = np.array([text_stats(t) for t in batch.column(text).to_pylist()], np.int64).reshape(-1, len(STATS))
                columns = [batch.column(f.name) for f in fields] + [pa.array(stats[:, i]) for i in range(len(STATS))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def _arc(part: str, whole: str) -> Column:
    return F.asin(F.sqrt(F.least(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(1.0))))


def with_features(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {
            "f_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "f_symbols": _arc("n_symbols", "word_chars"),
            "f_lines": _arc("n_dup_lines", "n_lines"),
            "f_repeats": _arc("n_repeat_words", "n_words"),
        }
    )


def _group(df: DataFrame, usable: Column) -> DataFrame:
    """``df`` with ``_group``: language and source, or one pool for all small groups."""
    own = F.struct("lang", "source").cast("struct<lang:string,source:string>")
    named = F.to_json(own, {"ignoreNullFields": "false"})
    df = df.withColumn("_own", named)
    large = df.where(usable).groupBy("_own").count().where(F.col("count") >= MIN_GROUP).select("_own", F.lit(True).alias("_large"))
    return beside(df, large, ["_own"], "left").withColumn(
        "_group", F.when(F.col("_large"), F.col("_own")).otherwise(F.lit("pool"))
    ).drop("_own", "_large")


def _medians(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy("_group").agg(*[F.percentile_approx(n, 0.5, 10_000).alias(f"m_{n}") for n in names])


def _start(usable: DataFrame) -> DataFrame:
    """Medians as the centre; squared median deviations and smallest spreads as the diagonal."""
    names = list(FEATURES)
    centre = written(_medians(usable, names), "centre")
    away = beside(usable, centre, ["_group"]).select("_group", *[F.abs(F.col(n) - F.col(f"m_{n}")).alias(n) for n in names])
    spread = _medians(away, names).select("_group", *[F.col(f"m_{n}").alias(f"s_{n}") for n in names])
    weight = [F.lit(1.0) / (F.pow(1.4826 * F.col(f"s_{n}"), 2) + F.lit(FEATURES[n] ** 2)) for n in names]
    matrix = [weight[i] if i == j else F.lit(0.0) for i in range(len(names)) for j in range(len(names))]
    return centre.join(spread, "_group").select(
        "_group", F.array(*[F.col(f"m_{n}") for n in names]).alias("centre"), F.array(*matrix).alias("inverse")
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of the features from ``centre`` under ``inverse``."""
    names = list(FEATURES)
    away = [F.col(n) - F.col("centre")[i] for i, n in enumerate(names)]
    return sum(
        (away[i] * away[j] * F.col("inverse")[i * len(names) + j] for i in range(len(names)) for j in range(len(names))),
        F.lit(0.0),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inverse(covariance: pd.Series) -> pd.Series:
    size = len(FEATURES)
    floor = np.diag([s * s for s in FEATURES.values()])
    return covariance.map(lambda c: np.linalg.inv(np.array(c, float).reshape(size, size) + floor).ravel().tolist())


def _concentrate(usable: DataFrame, estimate: DataFrame) -> DataFrame:
    """One step: mean and covariance of each group's nearest documents."""
    names = list(FEATURES)
    far = beside(usable, estimate, ["_group"]).select("_group", *names, _distance().alias("_d"))
    edge = written(far.groupBy("_group").agg(F.percentile_approx("_d", NEAREST, 10_000).alias("_edge")), "edge")
    near = beside(far, edge, ["_group"]).where(F.col("_d") <= F.col("_edge"))
    covariance = [F.covar_pop(a, b) * CONSISTENCY for a in names for b in names]
    moments = near.groupBy("_group").agg(
        F.array(*[F.avg(n) for n in names]).alias("centre"), F.array(*covariance).alias("_covariance")
    )
    return written(moments.select("_group", "centre", _inverse("_covariance").alias("inverse")), "estimate")


def judge(df: DataFrame, steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """``df`` (lang, source, text and others; without text) with statistics, ``base_failed``, ``distance`` and ``kept``."""
    df = df.drop("base_failed", "distance", "kept", *FEATURES)
    stats = written(with_features(with_stats(df)), "stats")
    grouped = _group(stats, ~base_failed())
    usable = written(grouped.where(~base_failed()).select("_group", *FEATURES), "usable")
    estimate = written(_start(usable), "estimate")
    for _ in range(steps):
        estimate = _concentrate(usable, estimate)
    return (
        beside(grouped, estimate, ["_group"], "left")
        .withColumn("base_failed", base_failed())
        .withColumn("distance", _distance())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))
        .drop("_group", "centre", "inverse", *FEATURES)
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"_id": F.coalesce(F.col("doc_id"), F.lit(0)), "_null": F.col("doc_id").isNull(), "_text": F.xxhash64("text")}
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; rows with the same id and text share their verdict."""
    judged = judge(_keyed(docs.select("doc_id", "lang", "source", "text")))
    passed = written(judged.where("kept").select("_id", "_null", "_text").distinct(), "passed")
    return beside(_keyed(docs), passed, ["_id", "_null", "_text"], "left_semi").select(*docs.columns)
