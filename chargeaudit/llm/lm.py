"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

The chance of a word is that of its class, given features of the words before, times that
of the word in its class. Frequent words (``HEAD`` of them, a bounded table) are dealt to
classes of about equal mass; all others form one class. Features are the last word, the
last two words and the word before the last (a skip), each hashed to ``BUCKETS`` rows of
weights. Inside a class only the word itself is a feature; the weights that maximise the
likelihood are then smoothed relative frequencies, so they need no gradient.

Weights of the classes are learned by distributed gradient updates: in each round every
task goes over its part of the round's documents in batches, and Spark adds up the tasks'
changes per bucket, weighted by tokens. The rounds take disjoint parts that together are
all training documents. Counts of words are one Spark aggregation over all of them;
words outside of the table get theirs by a join, so no vocabulary is held as a whole.

Defined results: a null text counts as empty and has the end token only; a null id is never
held out; repeated rows each count and each have a score; with no training documents all
counts are 0; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.llm.common import mixed, table, text_or_empty, written

FOLDS, HELD = 7, 2
HEAD = 1 << 17
CLASSES = 24  # and one for the words outside of the table
BUCKETS = 1 << 12
KINDS = 3
ROUNDS = 2
RATE = 0.25
BATCH = 16_384
FLUSH = 500_000
END = b""


def remainder() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1))


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lowered (other characters stay), then the end."""
    return [*text.lower().split(), END]


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, count) over all rows of ``text``; the end is the empty word."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "count"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update(tokens(text))
                if len(counts) >= FLUSH:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    return documents.select("text").mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


class _Numbers(dict):
    """Numbers of the frequent words; the others share the last one."""

    def __missing__(self, word: bytes) -> int:
        return self.rest


class Vocabulary:
    """The frequent words, their counts and classes."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int):
        self.words, self.rest = words, len(words)
        self.counts = np.array([*counts, 0], np.float64)
        self.total, self.distinct = total, distinct
        mass = np.cumsum(self.counts[:-1]) / max(1.0, self.counts.sum())
        self.classes = np.append(np.minimum((mass * CLASSES).astype(np.int64), CLASSES - 1), CLASSES)
        of_class = np.bincount(self.classes[:-1], self.counts[:-1] + 1, CLASSES + 1)
        of_class[CLASSES] = total - self.counts.sum() + (distinct - len(words)) + 1
        self.rare = of_class[CLASSES]
        self.inside = np.log10((self.counts + 1) / of_class[self.classes])
        self.inside[-1] = 0.0  # comes from the join
        self.base = np.log10(self.counts + 1)
        self.base[-1] = 0.0
        shares = np.bincount(self.classes, self.counts, CLASSES + 1)
        shares[CLASSES] = total - shares.sum()
        self.bias = np.log((shares + 1) / (shares.sum() + CLASSES + 1)).astype(np.float32)

    def numbers(self) -> _Numbers:
        found = _Numbers(zip(self.words, range(self.rest), strict=True))
        found.rest = self.rest
        return found


def _contexts(ids: np.ndarray, ends: np.ndarray, rest: int) -> list[np.ndarray]:
    """Bucket of each feature for every token of consecutive documents."""
    one = np.empty(len(ids), np.uint64)
    one[1:], one[0] = ids[:-1], rest + 1
    one[ends[:-1]] = rest + 1
    two = np.empty(len(ids), np.uint64)
    two[1:], two[0] = one[:-1], rest + 1
    two[ends[:-1]] = rest + 1
    mask = np.uint64(BUCKETS - 1)
    last = mixed(one + np.uint64(1))
    return [
        (last & mask).astype(np.int64),
        (mixed(last ^ (two + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & mask).astype(np.int64) + BUCKETS,
        (mixed(two + np.uint64(1 << 40)) & mask).astype(np.int64) + 2 * BUCKETS,
    ]


def _log_chances(weights: np.ndarray, bias: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the chance of every class."""
    scores = weights[buckets[0]] + weights[buckets[1]]
    scores += weights[buckets[2]]
    scores += bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _numbered(batches: Iterator[pa.RecordBatch], numbers: _Numbers, least: int) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Runs of whole documents with at least ``least`` tokens: words, numbers, ends, rows."""
    words: list[list[bytes]] = []
    rows: list[pa.RecordBatch] = []
    held = 0

    def out():
        ends = np.cumsum([len(w) for w in words])
        ids = np.fromiter((i for own in words for i in map(numbers.__getitem__, own)), np.int64, held)
        return words, ids, ends, rows

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        begin = 0
        for at, text in enumerate(texts):
            words.append(tokens(text))
            held += len(words[-1])
            if held >= least:
                rows.append(batch.slice(begin, at + 1 - begin))
                yield out()
                words, rows, held, begin = [], [], 0, at + 1
        if begin < len(texts):
            rows.append(batch.slice(begin))
    if words:
        yield out()


def _train_round(documents: DataFrame, vocabulary, weights: np.ndarray) -> np.ndarray:
    """Weights after every task went once over its documents."""
    context = documents.sparkSession.sparkContext
    now = context.broadcast(weights)
    names = [f"v{i}" for i in range(CLASSES + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        numbers = known.numbers()
        own, squares, seen = now.value.copy(), np.full(now.value.shape, 1e-2, np.float32), 0
        for _, ids, ends, _ in _numbered(batches, numbers, BATCH):
            contexts = _contexts(ids, ends, known.rest)
            target = known.classes[ids]
            seen += len(ids)
            for at in range(0, len(ids), BATCH):  # very long documents take several steps
                buckets = [c[at : at + BATCH] for c in contexts]
                slope = np.exp(_log_chances(own, known.bias, buckets))
                slope[np.arange(len(slope)), target[at : at + BATCH]] -= 1
                for bucket in buckets:
                    order = np.argsort(bucket, kind="stable")
                    places, first = np.unique(bucket[order], return_index=True)
                    step = np.add.reduceat(slope[order], first, axis=0)
                    squares[places] += step * step
                    own[places] -= RATE * step / np.sqrt(squares[places])
        touched = np.flatnonzero((own != now.value).any(axis=1))
        change = (own - now.value)[touched].astype(np.float64) * seen
        columns = [pa.array(touched), pa.array(np.full(len(touched), seen, np.int64)), *(pa.array(change[:, i]) for i in range(CLASSES + 1))]
        total = [pa.array([-1]), pa.array([seen]), *(pa.array([0.0]) for _ in names)]
        for part in (columns, total):
            yield pa.RecordBatch.from_arrays(part, ["bucket", "seen", *names])

    schema = "bucket long, seen long, " + ", ".join(f"{n} double" for n in names)
    sums = documents.select("text").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("seen").alias("seen"), *[F.sum(n).alias(n) for n in names])
    found = sums.toPandas()  # a row for each bucket at most
    total = int(found.loc[found.bucket == -1, "seen"].sum())
    found = found[found.bucket >= 0]
    result = weights.copy()
    if total:
        # a bucket's change counts by the tokens of the tasks that met it
        result[found.bucket.to_numpy()] += (found[names].to_numpy() / found[["seen"]].to_numpy()).astype(np.float32)
    now.unpersist()
    return result


def _scored(documents: DataFrame, vocabulary, weights: np.ndarray) -> DataFrame:
    """Sums over the frequent words of each row, and its other words with how often they occur."""
    final = documents.sparkSession.sparkContext.broadcast(weights)
    names = ["row", "doc_id", "held_out", "n_tokens", "n_head", "base", "own", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        numbers = known.numbers()
        row = TaskContext.get().partitionId() << 33
        for words, ids, ends, rows in _numbered(batches, numbers, 4 * BATCH):
            contexts = _contexts(ids, ends, known.rest)
            target = known.classes[ids]
            chance = np.empty(len(ids))
            for at in range(0, len(ids), BATCH):
                part = _log_chances(final.value, known.bias, [c[at : at + BATCH] for c in contexts])
                chance[at : at + BATCH] = part[np.arange(len(part)), target[at : at + BATCH]]
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sums = [np.add.reduceat(x, begins) for x in (known.base[ids], chance / np.log(10) + known.inside[ids], (ids < known.rest).astype(np.int64))]
            other = np.flatnonzero(ids == known.rest)
            flat = [w for own in words for w in own] if len(other) else []
            cuts = np.searchsorted(other, np.concatenate([begins, [len(ids)]]))
            rare = [Counter(flat[i] for i in other[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            whole = pa.Table.from_batches(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(words))),
                    whole.column("doc_id").combine_chunks(),
                    whole.column("held_out").combine_chunks(),
                    pa.array(ends - begins),
                    pa.array(sums[2]),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.array([list(r) for r in rare], pa.list_(pa.binary())),
                    pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())),
                ],
                names,
            )
            row += len(words)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, own double, rare array<binary>, times array<long>"
    return documents.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def score(documents: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text)."""
    context = documents.sparkSession.sparkContext
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (remainder() == HELD).alias("held_out")
    )
    training = rows.where(~F.col("held_out"))
    counts = written(word_counts(training), "words")
    totals = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("count"), "word").limit(head).toPandas()
    vocabulary = context.broadcast(Vocabulary([bytes(w) for w in top["word"]], top["count"].tolist(), totals["n"], totals["v"]))
    weights = np.zeros((KINDS * BUCKETS, CLASSES + 1), np.float32)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(rounds))
    for number in range(rounds):
        weights = _train_round(training.where(part == number), vocabulary, weights)
    sums = written(_scored(rows, vocabulary, weights), "scored")
    edge = int(top["count"].min()) if len(top) else 0
    other = sums.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    tail = counts.where(F.col("count") <= edge)  # the words outside of the table, and those that tie with its last ones
    found = (
        other.join(tail, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("n_tail"),
            F.sum(F.col("times") * F.log10(F.coalesce(F.col("count"), F.lit(0)) + 1.0)).alias("tail"),
            F.sum("times").alias("n_other"),
        )
    )
    none = F.lit(0)
    known = vocabulary.value
    at_all = float(np.log10(known.total + known.distinct + 1))
    return sums.drop("rare", "times").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", none)).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * at_all).alias("base_score"),
        (F.col("own") + F.coalesce("tail", F.lit(0.0)) - F.coalesce("n_other", none) * float(np.log10(known.rare))).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the model and under the counts."""
    return score(table(spark, sf_dir, "documents"))
