"""Benchmark decontamination by greedy string tiling.

Words are lower-cased, stripped of punctuation at their ends and hashed. Seeds are runs of
``MIN_MATCH`` words. A bitmap of fixed size, built from the benchmark in Spark, tells while
documents are read where a seed may begin; stretches of such places are all a tile can lie
in, so only those stretches are kept. A join on the seeds gives the pairs of document and
item that share one. For every pair, tiles are found by running Karp-Rabin: the longest
matches that don't overlap are marked first, then shorter ones down to ``MIN_MATCH``. The
order of tiles doesn't matter, so reordered passages count in full. An item leaks if the
tiles cover at least ``COVERAGE`` of its words.

The benchmark may be of any size: the bitmap's false hits only make the join larger, and
the joined sides are broadcast only if measured small.

Defined results: null texts and items have no words; items shorter than ``MIN_MATCH`` words
are never reported; rows without an id are not reported; repeated documents give equal rows
once; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.llm.common import beside, mixed, table, text_or_empty, written

MIN_MATCH = 5
COVERAGE = 0.6
BITS = 24
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*#$%&|"
BASE = 0x9E3779B97F4A7C15


class _Words(dict):
    """Hash of each word as it stands in a text; 0 for those of punctuation only."""

    def __missing__(self, word: str) -> int:
        import xxhash

        plain = word.strip(EDGES)
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = (xxhash.xxh3_64_intdigest(plain.encode()) | 1) if plain else 0
        return value


def hashed_words(text: str, known: _Words) -> np.ndarray:
    words = text.lower().split()
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return ids[ids != 0]


def seeds_of(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(ids) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(BASE) + ids[i : i + n]
    return mixed(total)


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in pattern, place in text, length) of the tiles.

    ``text`` may hold 0 where nothing matches. Rounds search for matches of a length that
    starts at the longest possible one and halves down to ``least``. A round extends all
    matches at least as long and marks the longest; it is repeated while it marks any.
    """
    marked_p, marked_t = [False] * len(pattern), [t == 0 for t in text]
    found: list[tuple[int, int, int]] = []
    search = max(least, min(len(pattern), len(text)))
    while True:
        places = defaultdict(list)
        for p, key in _rolled(pattern, marked_p, search):
            places[key].append(p)
        matches: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, key in _rolled(text, marked_t, search):
            for p in places.get(key, ()):
                length = 0
                while (
                    p + length < len(pattern)
                    and t + length < len(text)
                    and not marked_p[p + length]
                    and not marked_t[t + length]
                    and pattern[p + length] == text[t + length]
                ):
                    length += 1
                if length >= search:
                    matches[length].append((p, t))
        newly = 0
        for p, t in matches[max(matches)] if matches else ():
            length = max(matches)
            if not any(marked_p[p : p + length]) and not any(marked_t[t : t + length]):
                marked_p[p : p + length] = marked_t[t : t + length] = [True] * length
                found.append((p, t, length))
                newly += 1
        if newly:
            continue
        if search == least:
            return found
        search = max(least, search // 2)


def _rolled(words: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Place and rolling hash of every run of ``size`` unmarked words."""
    modulus, base = (1 << 61) - 1, 1_000_003
    top = pow(base, size - 1, modulus)
    value = run = 0
    for i, word in enumerate(words):
        if marked[i]:
            value = run = 0
            continue
        if run >= size:
            value = (value - words[i - size] * top) % modulus
        value = (value * base + word) % modulus
        run += 1
        if run >= size:
            yield i - size + 1, value


def bench_seeds(items: DataFrame, least: int) -> DataFrame:
    """(item_id, words, seeds, times) of every item with at least ``least`` words; ``times`` counts each seed's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = hashed_words(text, known)
                if item is not None and len(ids) >= least:
                    own, times = np.unique(seeds_of(ids, least), return_counts=True)
                    rows.append((item, ids.view(np.int64), own.view(np.int64), times))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                ],
                ["item_id", "words", "seeds", "times"],
            )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>, seeds array<long>, times array<long>")


def seed_bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which of 2**bits slots hold a seed: at most 2**bits / 64 rows come to the driver."""
    slot = F.shiftrightunsigned(F.col("seed"), 64 - bits)
    rows = (
        seeds.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    words = np.zeros(1 << bits - 6, np.uint64)
    words[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def seed_stretches(documents: DataFrame, bitmap: np.ndarray, bits: int, least: int) -> DataFrame:
    """(doc_id, words, seeds): the stretches of each document where seeds may begin, 0 between them."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        slots = shared.value
        for batch in batches:
            docs, words, seeds = [], [], []
            for at in range(batch.num_rows):
                ids = hashed_words(batch.column("text")[at].as_py(), known)
                own = seeds_of(ids, least)
                slot = own >> np.uint64(64 - bits)
                hits = np.flatnonzero(slots[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                if not len(hits):
                    continue
                cover = np.zeros(len(ids) + 1, np.int64)
                np.add.at(cover, hits, 1)
                np.add.at(cover, hits + least, -1)
                inside = np.cumsum(cover[:-1]) > 0
                kept = np.where(inside, ids, np.uint64(0))
                gap = ~inside
                gap[1:] &= inside[:-1]  # one 0 between stretches is enough
                docs.append(batch.column("doc_id")[at].as_py())
                words.append(kept[inside | gap].view(np.int64))
                seeds.append(np.unique(own[hits]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))],
                ["doc_id", "words", "seeds"],
            )

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, words array<long>, seeds array<long>")


def _tile_pairs(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                own = tiles(row["item_words"], row["words"], least)
                covered = sum(n for _, _, n in own)
                if covered >= coverage * len(row["item_words"]):
                    rows.append((row["doc_id"], row["item_id"], len(own), covered, len(row["item_words"])))
            names = ["doc_id", "item_id", "n_tiles", "n_covered", "n_item_words"]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def leaks(documents: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, bits: int = BITS) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_covered, n_item_words) of every item found in a document."""
    items = written(bench_seeds(benchmark, least), "items").dropDuplicates(["item_id", "words"])
    counted = F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("times").alias("places"))).alias("s")
    seeds = items.select("item_id", F.size("words").alias("_size"), counted).select("item_id", "_size", "s.seed", "s.places")
    places = written(seed_stretches(documents, seed_bitmap(seeds, bits), bits, least), "stretches").dropDuplicates(["doc_id", "words"])
    places = places.withColumn("_text", F.xxhash64("words"))
    hits = places.select("doc_id", "_text", F.explode("seeds").alias("seed"))
    shared = beside(hits, seeds, ["seed"]).groupBy("doc_id", "_text", "item_id").agg(
        F.sum("places").alias("_shared"), F.first("_size").alias("_size")
    )
    # tiles cover words that stand in a place of a shared seed, and a place has ``least`` words
    pairs = shared.where(F.col("_shared") * least >= F.col("_size") * coverage).select("doc_id", "_text", "item_id")
    full = pairs.join(places.select("doc_id", "_text", "words"), ["doc_id", "_text"])
    full = beside(full, items.select("item_id", F.col("words").alias("item_words")), ["item_id"])
    found = full.select("doc_id", "item_id", "words", "item_words").mapInArrow(
        _tile_pairs(least, coverage), "doc_id long, item_id long, n_tiles long, n_covered long, n_item_words long"
    )
    return found.distinct()


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with an item of the benchmark in it, and how its tiles cover the item."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_item_words"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark; those without an id stay."""
    bad = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
