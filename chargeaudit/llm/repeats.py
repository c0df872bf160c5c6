"""Substring dedup by recompression.

Texts are sequences of words. Rounds of recompression rename them: first runs of an equal
symbol become one symbol, then pairs of a left and a right symbol do, where the side of a
symbol is a bit of its name. Names are 64-bit hashes of what they stand for, so equal runs
and pairs get the same name in every document without a dictionary, and equal stretches of
words get the same symbols except near their ends. Along with each symbol goes the range of
words that its making looked at: inside a window, all symbols whose range lies in the window
are the same wherever the window's words occur.

From each window of ``WINDOW`` words the symbol with the smallest hash of its range stands
for the window. Spark gathers these high-level symbols; those in two or more documents
reveal windows that may repeat. These windows are verified: 128-bit fingerprints of all their
words (those of exact copies aside, which go as a whole) are grouped to the smallest document, and words under windows that a smaller document
has too are removed. A window without such a symbol (inside a long run) stands for itself.

Defined results: a null text has no words; rows with a null id are kept whole and own
nothing; rows with the same id are equals, neither is smaller; texts shorter than a window
are kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.llm.common import WordHashes, beside, mixed, table, text_or_empty, written

WINDOW = 50
ROUNDS = 3
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _rename(names: np.ndarray, low: np.ndarray, high: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: symbols with the first word and the word after the last that their making looked at.

    What looks beyond the text's ends gets -1 or ``edge``: elsewhere there may be a word.
    """
    n = len(names)
    # runs: a symbol looks at both neighbours to know where its run ends
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    run = np.where(size > 1, mixed(names[first] ^ (size.astype(np.uint64) * FACTORS[0])), names[first])
    low, high = np.append(low, -1)[first - 1], np.append(high, edge)[last + 1]
    if len(run) < 2:
        return run, low, high
    # pairs: a left symbol looks to its right, a right symbol to its left
    right = (mixed(run ^ FACTORS[1]) & np.uint64(1)).astype(bool)
    pair = ~right[:-1] & right[1:]
    head = np.append(pair, False)  # begins a pair
    tail = np.append(False, pair)  # ends one
    name = run.copy()
    name[head] = mixed(run[head] * FACTORS[0] + mixed(run[tail]) + FACTORS[1])
    seen_low, seen_high = low.copy(), high.copy()
    alone_left = ~right & ~head
    seen_high[alone_left] = np.append(high, edge)[np.flatnonzero(alone_left) + 1]
    seen_high[head] = high[tail]
    alone_right = right & ~tail
    seen_low[alone_right] = np.append(low, -1)[np.flatnonzero(alone_right) - 1]
    kept = ~tail
    return name[kept], seen_low[kept], seen_high[kept]


def _prefix_hashes(words: np.ndarray, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sums of word hashes times rising powers, and the powers, to hash any range of words."""
    powers = np.empty(len(words) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = factor
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:-1], out=sums[1:])
    return sums, powers


def _inverse_powers(factor: np.uint64, count: int) -> np.ndarray:
    inverse = np.empty(count, np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(int(factor), -1, 1 << 64))
    return np.multiply.accumulate(inverse)


def _range_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Hash of the words of each range, the same wherever the words stand."""
    sums, _ = _prefix_hashes(words, factor)
    shift = _inverse_powers(factor, len(words) + 1)
    return mixed((sums[high] - sums[low]) * shift[low] + (high - low).astype(np.uint64))


def anchors(words: np.ndarray) -> np.ndarray:
    """For the window at each word the hash of the symbol that stands for it."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    names = words
    low, high = np.arange(len(words)), np.arange(1, len(words) + 1)
    for _ in range(ROUNDS):
        names, low, high = _rename(names, low, high, len(words) + 1)
    short = (high - low <= WINDOW) & (low >= 0) & (high <= len(words))
    low, high = low[short], high[short]
    keys = mixed(_range_hashes(words, low, high, FACTORS[0]))
    starts = np.arange(n)
    # symbols a..b of the window: ranges begin and end in rising order
    a = np.searchsorted(low, starts, "left")
    b = np.searchsorted(high, starts + WINDOW, "right")
    count = b - a
    best = np.empty(n, np.uint64)
    some = count > 0
    if some.any():
        level = np.zeros(n, np.int64)
        level[some] = np.frexp(count[some].astype(np.float64))[1] - 1
        table_of = keys
        for step in range(int(level[some].max()) + 1):
            here = np.flatnonzero(some & (level == step))
            best[here] = np.minimum(table_of[a[here]], table_of[b[here] - (1 << step)])
            if len(table_of) > 1 << step:
                table_of = np.minimum(table_of[: len(table_of) - (1 << step)], table_of[1 << step :])
    none = starts[~some]
    if len(none):
        best[none] = _range_hashes(words, none, none + WINDOW, FACTORS[1])
    return best


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _symbols(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id, symbol): what stands for the windows of each document, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [np.unique(anchors(hashes.of(t.split()))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                sizes = [len(f) for f in found]
                ids = [pa.array(np.repeat(batch.column(n).to_numpy(), sizes)) for n in ("doc_id", "text_id")]
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(flat)], ["doc_id", "text_id", "symbol"])

    return documents.select("doc_id", "text_id", "text").mapInArrow(run, "doc_id long, text_id long, symbol long")


def _copies(documents: DataFrame) -> DataFrame:
    """(doc_id, text_id) of the rows whose text a smaller document has as a whole."""
    digests = documents.select("doc_id", "text_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return beside(digests, first.select("digest", "least"), ["digest"]).where("doc_id > least").select("doc_id", "text_id").distinct()


PLACES = "doc_id long, text_id long, n_words long, n_removed long, kept_sha256 string, text string, starts array<int>"


def _candidates(documents: DataFrame) -> DataFrame:
    """Rows whose windows may repeat keep their text and the windows' places; the others are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                yield mark(whole.slice(at, 500), hashes)

    def mark(batch: pa.RecordBatch, hashes: WordHashes) -> pa.RecordBatch:
        counts, removed, digests, texts, starts = [], [], [], [], []
        rows = zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("symbols"), batch.column("copy").to_pylist(), strict=True)
        for text, shared, copy in rows:
            words = text.split()
            if copy and len(words) >= WINDOW:  # every window starts in the smaller document
                counts.append(len(words))
                removed.append(len(words))
                digests.append(_digest([]))
                texts.append(None)
                starts.append(np.zeros(0, np.int32))
                continue
            places = np.zeros(0, np.int32)
            if shared.is_valid and len(shared.values):
                mine = shared.values.to_numpy().view(np.uint64)
                places = np.flatnonzero(np.isin(anchors(hashes.of(words)), mine)).astype(np.int32)
            counts.append(len(words))
            removed.append(0)
            digests.append(None if len(places) else _digest(words))
            texts.append(text.decode() if len(places) else None)
            starts.append(places)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_id"),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(texts, pa.string()),
                pa.array(starts, pa.list_(pa.int32())),
            ],
            ["doc_id", "text_id", "n_words", "n_removed", "kept_sha256", "text", "starts"],
        )

    return documents.select("doc_id", "text_id", "text", "symbols", "copy").mapInArrow(run, PLACES)


def _windows(places: DataFrame) -> DataFrame:
    """(doc_id, text_id, start, one, two): fingerprint of every window that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                sizes, starts, one, two = [], [], [], []
                for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts"), strict=True):
                    begin = own.values.to_numpy().astype(np.int64)
                    words = hashes.of(text.split())
                    other = mixed(words ^ FACTORS[1])
                    sizes.append(len(begin))
                    starts.append(begin)
                    one.append(_range_hashes(words, begin, begin + WINDOW, FACTORS[0]))
                    two.append(_range_hashes(other, begin, begin + WINDOW, FACTORS[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column("doc_id").to_numpy(), sizes)),
                        pa.array(np.repeat(batch.column("text_id").to_numpy(), sizes)),
                        pa.array(np.concatenate(starts).astype(np.int32)),
                        pa.array(np.concatenate(one).view(np.int64)),
                        pa.array(np.concatenate(two).view(np.int64)),
                    ],
                    ["doc_id", "text_id", "start", "one", "two"],
                )

    return places.select("doc_id", "text_id", "text", "starts").mapInArrow(run, "doc_id long, text_id long, start int, one long, two long")


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(places: DataFrame) -> DataFrame:
    """Words of each row that no repeated window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("repeated"), strict=True):
                words = text.split()
                if own.is_valid and len(own.values):
                    begin = own.values.to_numpy().astype(np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + WINDOW, -1)
                    free = np.cumsum(edge[:-1]) == 0
                    kept = [w for w, f in zip(words, free, strict=True) if f]
                else:
                    kept = words
                removed.append(len(words) - len(kept))
                digests.append(_digest(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return places.select("doc_id", "n_words", "text", "repeated").mapInArrow(run, REMOVED)


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of (doc_id, text).

    ``kept`` is the remaining text, null where nothing was removed because no window could repeat.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("text_id", F.xxhash64("text"))
    owned = rows.where(F.col("doc_id").isNotNull())
    copies = written(_copies(owned), "copies")  # they own no window and are removed as a whole
    symbols = beside(written(_symbols(owned), "symbols"), copies, ["doc_id", "text_id"], "left_anti")
    shared = (
        symbols.groupBy("symbol")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most")
        .select("symbol")
    )
    shared = written(shared, "shared")
    lists = beside(symbols, shared, ["symbol"]).groupBy("doc_id", "text_id").agg(F.collect_set("symbol").alias("symbols"))
    lists = lists.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    marked = rows.join(lists, ["doc_id", "text_id"], "left")
    places = written(_candidates(marked), "places")
    may = places.where(F.col("text").isNotNull())
    windows = _windows(may)
    owners = windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    owners = written(owners.where("least < most").select("one", "two", "least"), "owners")
    repeated = (
        windows.join(owners, ["one", "two"])
        .where(F.col("doc_id") > F.col("least"))
        .groupBy("doc_id", "text_id")
        .agg(F.collect_list("start").alias("repeated"))
    )
    done = places.where(F.col("text").isNull()).select(
        "doc_id", "n_words", "n_removed", "kept_sha256", F.when(F.col("n_removed") > 0, F.lit("")).alias("kept")
    )
    return _remove(may.join(repeated, ["doc_id", "text_id"], "left")).union(done)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of the kept words of every document."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
