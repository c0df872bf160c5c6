"""Token ids in files of blocks: frequency ranks in one to four bytes, lengths in control bytes.

Each block codes the ids of consecutive documents. Its ids are replaced by their rank of
frequency in the block, so common ids take one byte. A control byte holds the lengths of
four values; the data bytes follow separately, so a reader finds all values by looking
the control bytes up in a table and adding up lengths, without a loop over values. Blocks
carry their own rank table: a shard is written in one pass and read without any other.

Files are Parquet with one row for each block, written by Spark's commit protocol, so a
lost executor leaves no half-written shard. ``part`` and ``first`` give a block's place.

Defined results: a null text counts as empty and holds the end id only; null document ids
come first; rows with the same id stand next to each other; an empty table gives no file
rows. Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargeaudit.llm.common import shared_folder, table, text_or_empty
from chargeaudit.llm.pieces import json_tokenizer

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 2_000_000

BLOCKS = (
    "part int, block int, first long, n_ids long, doc_ids binary, doc_nulls binary, n_tokens binary, "
    "ranks binary, control binary, data binary"
)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (four 2-bit lengths minus one each, lowest first) and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    sizes = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < sizes[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1)


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values of ``pack``, found by table lookup."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    starts = np.cumsum(sizes) - sizes
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = padded[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(sizes > byte)
        values[longer] |= padded[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values


def _block(part: int, number: int, first: int, docs: list, ids: list[np.ndarray]) -> dict:
    flat = np.concatenate(ids)
    counts = np.bincount(flat)
    used = np.flatnonzero(counts)
    ranks = used[np.argsort(-counts[used], kind="stable")]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    control, data = pack(rank_of[flat])
    return {
        "part": part,
        "block": number,
        "first": first,
        "n_ids": len(flat),
        "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
        "doc_nulls": np.array([d is None for d in docs], np.uint8).tobytes(),
        "n_tokens": np.array([len(i) for i in ids], "<i8").tobytes(),
        "ranks": ranks.astype("<u4").tobytes(),
        "control": control,
        "data": data,
    }


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every document of (doc_id, text) below ``path``, in ascending order of ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_tokenizer(tokenizer)
        part, number, first, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        ids: list[np.ndarray] = []
        end = np.array([end_id], np.uint32)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for doc, own in zip(names, encoder.encode(batch.column("text").to_pylist()), strict=True):
                docs.append(doc)
                ids.append(np.concatenate([own, end]))
                held += len(ids[-1])
                if held >= block_ids:
                    yield _row(_block(part, number, first, docs, ids))
                    number, first, held, docs, ids = number + 1, first + held, 0, [], []
        if docs:
            yield _row(_block(part, number, first, docs, ids))

    ordered = documents.select("doc_id", text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def _row(block: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([block], _SCHEMA)


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64())]
    + [(n, pa.binary()) for n in ("doc_ids", "doc_nulls", "n_tokens", "ranks", "control", "data")]
)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the files with ``start``, the number of ids in all blocks before.

    The offsets of the parts come from one row for each part, of which there are as many as
    the writing job had tasks.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("first"))


def decoded_blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    """(document ids, ends of the documents in the ids, ids, ids before the block) of each block."""
    for row in batch.to_pylist():
        ids = np.frombuffer(row["ranks"], "<u4")[unpack(row["control"], row["data"], row["n_ids"])]
        nulls = np.frombuffer(row["doc_nulls"], np.uint8)
        docs = [None if n else int(d) for d, n in zip(np.frombuffer(row["doc_ids"], "<i8"), nulls, strict=True)]
        yield docs, np.cumsum(np.frombuffer(row["n_tokens"], "<i8")), ids, row["start"]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                for docs, ends, ids, start in decoded_blocks(whole.slice(at, 1)):
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))
                    starts = pa.array(start + np.concatenate([[0], ends[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), starts, lists], ["doc_id", "start", "ids"])

    return read_blocks(spark, path).drop("offset").mapInArrow(run, "doc_id long, start long, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                for docs, ends, ids, start in decoded_blocks(whole.slice(at, 1)):
                    begins = np.concatenate([[0], ends[:-1]])
                    data = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array(start + begins), pa.array(ends - begins), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read_blocks(spark, path).drop("offset").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to files of the shared folder and digest them from there."""
    import uuid

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_digests(spark, path)
