"""N-gram Jaccard join by chosen paths.

A text is its set of shingles of ``SHINGLE`` words. Texts with equal sets are one class and
take part once. Each class has a signature of ``WIDTH`` smallest hashes, whose share of equal
places estimates the Jaccard similarity; a place together with its value is a shared token
for the purpose of splitting. A run starts with all classes in one node. In each step a node
chooses one place at random, or two with a chance that makes 1 / ``SIMILARITY`` children on
average, and sends each class to the child named by its value there. Nodes with few classes
are compared by brute force; larger ones are split again. A pair of the wanted similarity
meets in a run with a known chance; runs are repeated until the target recall is reached.

A large node is contracted before it is split. The places in which signatures differ are a
metric: if a class differs from the node's least class in at most ``CORE`` places, whatever is
similar to it differs from that one in at most ``CORE + APART``. So all classes within
``CORE + APART`` are tied to the least one, and those within ``CORE`` need not go on: who could
meet them further down is tied to the same class. A large group of near copies thus leaves a
run after one step or two.

What meets is only a candidate. Candidates form components; in each component the classes'
full shingle sets are compared with each other, block by block, so the links found are exact
and no list of pairs is made: a block gives each class its number of linked documents and the
edges of a spanning forest. Components of the links are the near-duplicate groups.

Defined results: texts with fewer words than a shingle are one shingle; null texts and those
without a word link to nothing and are groups of their own; repeated rows link to each other;
null ids take part but name no group unless all ids are null; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeaudit.llm.common import WordHashes, beside, mixed, table, written
from chargeaudit.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99999
WIDTH = 128
SMALL = 48  # classes in a node that is compared by brute force
DEPTH = 5
BLOCK_SHINGLES = 60_000
BLOCK_CLASSES = 400
KNOWN_WORDS = 120_000  # hashes a task remembers
SLACK = 5.0  # standard deviations of the signature's estimate

_FAR, _SPREAD = WIDTH * (1 - SIMILARITY), math.sqrt(WIDTH * SIMILARITY * (1 - SIMILARITY))
APART = math.ceil(_FAR + SLACK * _SPREAD)  # places in which similar classes differ at most
CORE = math.ceil(_FAR + _SPREAD)  # places up to which a class goes no further than the least one

CODE = np.random.default_rng(20_240_801)
_FLIPS = CODE.integers(0, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32)
_FACTORS = (CODE.integers(0, 1 << 31, WIDTH, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_POWERS = CODE.integers(0, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``SHINGLE`` words."""
    words = hashes.of(text.split())
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return mixed(np.array([np.bitwise_xor.reduce(mixed(words + _POWERS[: len(words)]))]))
    total = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for i, factor in enumerate(_POWERS):
        total += words[i : len(words) - SHINGLE + 1 + i] * factor
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """For each of ``WIDTH`` hash functions 16 bits of the smallest value."""
    best = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = (short[None, at : at + 2048] ^ _FLIPS[:, None]) * _FACTORS[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (mixed(best.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def meeting_chance(similarity: float, depth: int) -> float:
    """Chance that two sets share a node after ``depth`` steps of a run."""
    two = 1 / SIMILARITY - 1
    chance = 1.0
    for _ in range(depth):
        once = similarity * chance
        chance = (1 - two) * once + two * (1 - (1 - once) ** 2)
    return chance


def runs_needed(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(SIMILARITY, DEPTH)))


def _classes(documents: DataFrame) -> DataFrame:
    """(doc, set, size, signature) of every document with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(KNOWN_WORDS)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                docs, keys, sizes, signatures = [], [], [], []
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    own = shingles(text, hashes)
                    if len(own):
                        docs.append(doc)
                        keys.append(np.array([np.bitwise_xor.reduce(mixed(own)), own.sum()], np.uint64).tobytes())
                        sizes.append(len(own))
                        signatures.append(signature(own).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())],
                    ["doc", "set", "size", "signature"],
                )

    return documents.mapInArrow(run, "doc long, set binary, size long, signature binary")


def _children(node: np.ndarray, rep: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that one step sends each class to."""
    first = mixed(node)
    second = mixed(first + np.uint64(1))
    two = (second >> np.uint64(11)).astype(np.float64) / (1 << 53) < 1 / SIMILARITY - 1
    out = []
    for choice, who in ((first, np.ones(len(node), bool)), (second, two)):
        place = (choice % np.uint64(WIDTH)).astype(np.int64)
        value = marks[np.arange(len(marks)), place].astype(np.uint64)
        child = mixed(node ^ mixed((place.astype(np.uint64) << np.uint64(16)) + value + np.uint64(1)))
        out.append((child[who], rep[who]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, WIDTH)


MEMBER = "node long, rep long, size long, bits_a long, bits_b long, tied long"


def _split(members: DataFrame, runs: int | None) -> DataFrame:
    """Members of the children of each row's ``nodes``; ``runs`` starts that many runs at their roots.

    ``nodes`` has (node, least, marks) of each node, with the signature of its least class. A row
    with ``tied`` is no member: it says that ``rep`` goes with that class. What travels with a
    member is one bit of each place of its signature, not the signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                yield from split(whole.slice(at, 2000))

    def out(*columns: pa.Array | np.ndarray) -> pa.RecordBatch:
        names = ["node", "rep", "size", "bits_a", "bits_b", "tied"]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names)

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marks = _marks(batch.column("signature"))
        bits = np.packbits(marks & 1, axis=1).view(np.int64)
        rep, size = batch.column("rep").to_numpy(), batch.column("size").to_numpy()
        own = np.arange(len(rep))
        if runs is None:
            nodes = batch.column("nodes")
            node, least, theirs = nodes.flatten().flatten()
            who = np.repeat(own, nodes.value_lengths().to_numpy())
            differ = (marks[who] != _marks(theirs)).sum(axis=1)
            near = differ <= CORE + APART
            # a class mostly meets the same least class in all its nodes
            tied = np.unique(np.stack([rep[who[near]], least.to_numpy()[near]], axis=1), axis=0)
            tied = tied[tied[:, 0] != tied[:, 1]]
            none = pa.nulls(len(tied), pa.int64())
            yield out(none, tied[:, 0], none, none, none, tied[:, 1])
            on = differ > CORE
            starts = [(node.to_numpy().view(np.uint64)[on], who[on])]
        else:
            starts = [(np.full(len(rep), mixed(np.array([r + 1], np.uint64))[0]), own) for r in range(runs)]
        for start, who in starts:
            node, at = _children(start, who, marks[who])
            yield out(node.view(np.int64), rep[at], size[at], bits[at, 0], bits[at, 1], pa.nulls(len(node), pa.int64()))

    return members.mapInArrow(run, MEMBER)


def _compare(members: DataFrame) -> DataFrame:
    """Edges (u, v) of spanning forests of the pairs that may be similar, from rows sorted by node."""
    equal = (1 + SIMILARITY) / 2  # chance that a bit is the same
    least = WIDTH * equal - SLACK * math.sqrt(WIDTH * equal * (1 - equal))

    def edges(node: np.ndarray, rep: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = np.arange(len(node))
        left, right = [], []
        for shift in range(1, len(node)):
            same = np.flatnonzero(node[shift:] == node[:-shift])
            if not len(same):
                break
            a, b = same, same + shift
            close = np.minimum(size[a], size[b]) >= SIMILARITY * np.maximum(size[a], size[b])
            a, b = a[close], b[close]
            alike = WIDTH - np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) >= least
            left.append(a[alike])
            right.append(b[alike])
        if not left:
            return rep[:0], rep[:0]
        a, b = np.concatenate(left), np.concatenate(right)
        while True:  # the smallest place of each forest's tree
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        tied = np.flatnonzero(label != np.arange(len(node)))
        return rep[tied], rep[label[tied]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            node = whole.column("node").to_numpy()
            full = int(np.searchsorted(node, node[-1], "left")) if len(node) else 0  # the last node may go on
            held = whole.slice(full)
            if full:
                yield out(whole.slice(0, full))
        if held is not None and held.num_rows:
            yield out(held)

    def out(rows: pa.Table) -> pa.RecordBatch:
        node, rep, size, bits_a, bits_b = (rows.column(n).to_numpy() for n in ("node", "rep", "size", "bits_a", "bits_b"))
        u, v = edges(node, rep, size, np.stack([bits_a, bits_b], axis=1).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return members.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(run, "u long, v long")


def candidate_edges(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges whose components hold every pair of classes (rep, size, signature) that met in a run.

    Large nodes are counted and taken out before members are dealt by node, so no task gets
    more than ``SMALL`` rows of a node. What is near their least class is tied to it there.
    """
    spark = classes.sparkSession
    found = spark.createDataFrame([], "u long, v long")
    members = _split(classes, runs_needed(recall)).drop("tied")
    marks = classes.select(F.col("rep").alias("least"), F.col("signature").alias("marks"))
    for depth in range(1, DEPTH + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where(F.col("n") > SMALL)
        sizes = written(sizes.select("node", "least"), "nodes")
        found = found.union(written(_compare(beside(members, sizes.select("node"), ["node"], "left_anti")), "pairs"))
        if depth < DEPTH:
            large = beside(members.select("node", "rep"), written(sizes.join(marks, "least"), "leasts"), ["node"])
            # a class is in a bounded number of nodes, so its signature is fetched once for all of them
            parents = large.groupBy("rep").agg(F.collect_list(F.struct("node", "least", "marks")).alias("nodes")).join(classes, "rep")
            rows = written(_split(parents, None), "members")
            found = found.union(rows.where("tied IS NOT NULL").select("rep", "tied"))
            members = rows.where("tied IS NULL").drop("tied")
        else:
            # classes that are still many have shared DEPTH chosen places: they go on as one
            large = beside(members, sizes, ["node"])
            found = found.union(large.select(F.col("rep").alias("u"), F.col("least").alias("v")).where("u != v"))
    return found.distinct()


def _sets(members: DataFrame) -> DataFrame:
    """(comp, rep, weight, set) with the full shingle set in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(KNOWN_WORDS)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                found = pa.array([shingles(t, hashes).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("comp", "rep", "weight")), found], ["comp", "rep", "weight", "shingles"])

    return members.select("comp", "rep", "weight", "text").mapInArrow(run, "comp long, rep long, weight long, shingles binary")


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks: documents linked to each class, and edges to the least class of each tree."""
    rows = rows.sort_values(["block", "rep"], kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    low, high = rows["low"].iloc[0], rows["high"].iloc[0]
    block, weight = rows["block"].to_numpy(), rows["weight"].to_numpy()
    linked = np.zeros(len(sets), np.int64)
    label = np.arange(len(sets))
    for i in np.flatnonzero(block == low):
        first, last = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        counts = last - first
        ends = np.cumsum(counts)
        places = np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]))
        common = np.bincount(owners[places], minlength=len(sets))
        similar = common * 5 >= (sizes[i] + sizes - common) * 4  # SIMILARITY in whole numbers
        similar[: i + 1] = False
        if low != high:
            similar &= block == high
        others = np.flatnonzero(similar)
        if len(others):
            linked[i] += weight[others].sum()
            linked[others] += weight[i]
            merged = np.append(others, i)
            roots = np.unique(label[merged])
            label[np.isin(label, roots)] = roots[0]
    reps = rows["rep"].to_numpy()
    touched = np.flatnonzero(linked)
    return pd.DataFrame({"rep": reps[touched], "links": linked[touched], "root": reps[label[touched]]})


def near_groups(documents: DataFrame, recall: float = RECALL) -> DataFrame:
    """(row, group, n_links) for rows (row, text): the least row of the group and the number of similar other rows."""
    texts = documents.where(F.col("text").isNotNull()).select(F.col("row").alias("doc"), "text")
    rows = written(_classes(texts), "sets")
    classes = written(
        rows.groupBy("set").agg(F.min("doc").alias("rep"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("signature").alias("signature")),
        "classes",
    )
    comps = components(candidate_edges(classes.select("rep", "size", "signature"), recall))
    comps = written(comps.union(comps.select(F.col("root").alias("vertex"), "root").distinct()), "comps")
    members = comps.select(F.col("vertex").alias("rep"), F.col("root").alias("comp")).join(classes.select("rep", "weight", "size"), "rep")
    members = written(members, "members")
    # blocks of bounded size: a component's classes are dealt to as many as its shingles need
    blocks = members.groupBy("comp").agg(
        F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks")
    )
    chosen = beside(texts, members.select(F.col("rep").alias("doc"), "comp", "weight"), ["doc"]).withColumnRenamed("doc", "rep")
    sets = written(_sets(chosen), "shingles")
    dealt = beside(sets, written(blocks, "blocks"), ["comp"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", "rep", "weight", "shingles", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = written(
        dealt.groupBy("comp", "low", "high").applyInPandas(block_links, "rep long, links long, root long"), "links"
    )
    trees = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        classes.select("set", "rep", "weight")
        .join(trees.select(F.col("vertex").alias("rep"), "root"), "rep", "left")
        .join(links, "rep", "left")
        .select("set", F.coalesce("root", "rep").alias("group"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    grouped = beside(rows.select("doc", "set"), written(named, "named"), ["set"])
    alone = documents.select("row").join(rows.select(F.col("doc").alias("row")), "row", "left_anti")
    return grouped.select(F.col("doc").alias("row"), "group", "n_links").union(
        alone.select("row", F.col("row").alias("group"), F.lit(0).cast("long").alias("n_links"))
    )


def _with_rows(documents: DataFrame) -> DataFrame:
    """``documents`` with ``row``, a number of its own for each row: the id where ids are unique, else one from a written copy."""
    unclear = documents.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull())
    if unclear.isEmpty():
        return documents.withColumn("row", F.col("doc_id").cast("long"))
    return written(documents.withColumn("row", F.monotonically_increasing_id()), "rows")


def near_duplicates(documents: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of (doc_id, text): the smallest id of its group, and the rows similar to it."""
    rows = _with_rows(documents.select("doc_id", "text"))
    groups = written(near_groups(rows.select("row", "text"), recall), "groups")
    named = groups.join(rows.select("row", "doc_id"), "row")
    least = named.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    return named.join(written(least, "least"), "group").select("doc_id", "class_id", "n_links")


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, or the first row where ids repeat."""
    rows = _with_rows(docs.drop("row"))
    first = near_groups(rows.select("row", "text")).where(F.col("row") == F.col("group")).select("row")
    return beside(rows, written(first, "first"), ["row"], "left_semi").select(*docs.columns)
