"""Byte-level BPE encoding and decoding with a rank file, by the tokenizers library.

The library works on characters: each byte stands for one printable character. A rank
file names byte strings, so its entries are mapped to such characters, and every way to
cut an entry into two entries becomes a merge with that entry's rank. Decoding looks up
the bytes of each id in one flat table, so a character split over ids comes back whole.

Defined results: a null text counts as empty and has no ids; null ids decode to empty
bytes; ids outside of the vocabulary are an error. Columns besides those named are kept
by ``encode`` and ``decode`` unless they are called like a result column, which wins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit.llm.common import ragged, table, text_or_empty
from chargeaudit.llm.pieces import PieceEncoder

RANKS = "byte_bpe_multi_50k.tiktoken"
KNOWN_PIECES = 200_000  # pieces a worker remembers; it keeps them while other stages run


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def rank_tokenizer(path: str):
    """A tokenizer of the library that merges like the rank file says."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = ranks_of(path)
    letters = byte_characters()
    named = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((named[token[:cut]], named[token[cut:]]))
    model = models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer


@lru_cache(maxsize=1)
def rank_encoder(path: str) -> PieceEncoder:
    """Encoder of a rank file; the tasks of a worker share it and what it remembers."""
    return PieceEncoder(rank_tokenizer(path), most=KNOWN_PIECES)


class ByteTable:
    """Bytes of ids from one flat table."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.lengths):
            raise ValueError("an id is outside of the vocabulary")
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First character of each id in the decoded text; ids inside of one character share it."""
        data = self.flat[ragged(self.starts[ids], self.lengths[ids])]
        first = np.cumsum((data & 0xC0) != 0x80)
        at = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        return np.maximum(first[at] - 1, 0) if len(data) else np.zeros(len(ids), np.int64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype())))


def _encoded_fields(kept: DataFrame, text: str, offsets: bool) -> list[T.StructField]:
    fields = [f for f in kept.schema.fields if f.name != text] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.IntegerType())))
    return fields


def _encode_batches(path: str, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path)
        bytes_of = ByteTable(ranks_of(path)) if "offsets" in names else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = [i.astype(np.int32) for i in encoder.encode(batch.column(text).to_pylist())]
                columns = [batch.column(n) for n in names if n not in ("ids", "offsets")]
                columns.append(_lists(ids, pa.int32()))
                if bytes_of:
                    columns.append(_lists([bytes_of.offsets(i) for i in ids], pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decode_batches(path: str, ids: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = ByteTable(ranks_of(path))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
                decoded = [bytes_of.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names)

    return run


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` without ``text``, with ``ids`` and, if asked for, ``offsets`` (first character of each id)."""
    kept = df.drop("ids", "offsets").withColumn(text, text_or_empty(text))
    schema = T.StructType(_encoded_fields(kept, text, offsets))
    return kept.mapInArrow(_encode_batches(path, text, schema.names), schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids; ``cast("string")`` gives the text."""
    kept = df.drop("decoded").withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>")))
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])
    return kept.mapInArrow(_decode_batches(path, ids, schema.names), schema)


def encode_and_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``decode(encode(df))`` in one worker for each task instead of two, each of which holds its tables."""
    kept = df.drop("ids", "decoded").withColumn(text, text_or_empty(text))
    middle = [f.name for f in _encoded_fields(kept, text, False)]
    schema = T.StructType([*_encoded_fields(kept, text, False), T.StructField("decoded", T.BinaryType())])
    encoded, decoded = _encode_batches(path, text, middle), _decode_batches(path, "ids", schema.names)
    return kept.mapInArrow(lambda batches: decoded(encoded(batches)), schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of every document and of the bytes they decode to."""
    path = public_tokenizers.path(RANKS)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(documents, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text: the last stage's result."""
    path = public_tokenizers.path(RANKS)
    rows = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"), F.sha2(text_or_empty().cast("binary"), 256).alias("_sha"))
    return encode_and_decode(rows, path).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"),
    )
