"""Exact token counts at every prefix of a text.

``prefix_table`` stores, for each document, where its pieces end and how many tokens the
text up to there has; the last entry is the count of the whole text. Any other prefix
ends inside one piece, whose counts come from a dynamic program: the tokens of a prefix
are those of a shorter prefix and one last token, namely the one entry of the vocabulary
that ends there and that the tokenizer keeps apart from the last token before it. So
budget and truncation questions are answered without encoding the text again.

Defined results: a null text counts as empty and has 0 tokens; repeated rows are counted
each; columns besides those named are kept unless called like a result column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit.llm.common import table, text_or_empty
from chargeaudit.llm.pieces import PieceEncoder, json_tokenizer
from chargeaudit.llm.tokens_bpe import _lists, byte_characters

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
# Fixed values of the pattern: what follows an apostrophe in one match.
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")


class PrefixCounts:
    """Token counts of all prefixes of a piece of text, in characters."""

    def __init__(self, encoder: PieceEncoder, most: int = 100_000):
        self.tokenizer = encoder.tokenizer
        self.vocabulary = self.tokenizer.get_vocab()
        self.longest = max(map(len, self.vocabulary))
        self.letters = byte_characters()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.most = most

    def _apart(self, left: str, right: str) -> bool:
        """Whether the tokenizer leaves two neighbouring tokens as they are."""
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            self.pairs[key] = [t.value for t in self.tokenizer.model.tokenize(left + right)] == [left, right]
        return self.pairs[key]

    def of_match(self, text: str) -> list[int]:
        """Counts after each character of one match of the pattern, by the dynamic program."""
        data = [self.letters[b] for b in text.encode()]
        last, count = [""] * (len(data) + 1), [0] * (len(data) + 1)
        for end in range(1, len(data) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = "".join(data[begin:end])
                if token in self.vocabulary and (
                    self._apart(last[begin], token) if begin else self.tokenizer.model.tokenize(token)[0].value == token
                ):
                    last[end], count[end] = token, count[begin] + 1
                    break
        ends = np.cumsum([len(c.encode()) for c in text])
        return [count[e] for e in ends]

    def of_piece(self, text: str) -> list[int]:
        """Counts after each character of a piece, over its matches of the pattern.

        While a prefix ends within a run of white space, the run is one match; while it ends
        within a short form such as ``'re``, the apostrophe and the letter are two.
        """
        result: list[int] = []
        before = 0
        spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        at = 0
        while at < len(spans):
            start, end = spans[at]
            run = re.compile(r"[\s]+").match(text, start)
            if run and not text[start:end].strip():
                inside = self.of_match(text[start : run.end()])
                result += [before + n for n in inside[: end - start]]
                # the prefixes of the run's last character stand in the same match
                if end < run.end():
                    result += [before + n for n in inside[end - start :]]
                    before += self._whole(text[start:end])
                    start, end = spans[at + 1]
                    if text[start:end].strip():  # it leads a word: counted there from its second character
                        result += [before + n for n in self.of_match(text[start:end])[1:]]
                        before += self._whole(text[start:end])
                    else:
                        before += self._whole(text[start:end])
                    at += 2
                    continue
                before += inside[-1]
            else:
                inside = self.of_match(text[start:end])
                if text[start:end][:1] == "'" and text[start + 1 : end] in SHORT_FORMS and end - start == 3:
                    inside[1] = self._whole("'") + self._whole(text[start + 1])
                result += [before + n for n in inside]
                before += inside[-1]
            at += 1
        return result

    def _whole(self, match: str) -> int:
        return self.of_match(match)[-1]


def _runs(encoder: PieceEncoder, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for text, (counts, ends) in zip(texts, encoder.counted(texts), strict=True):
        yield text, counts, ends


def longest_prefix(text: str, counts: np.ndarray, ends: np.ndarray, budget: int, prefixes: PrefixCounts) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens, from the table of the text."""
    fit = int(np.searchsorted(counts, budget, "right"))
    if fit == len(counts):
        return len(text)
    begin = int(ends[fit - 1]) if fit else 0
    room = budget - (int(counts[fit - 1]) if fit else 0)
    inside = prefixes.of_piece(text[begin : int(ends[fit])])
    return begin + max((i + 1 for i, n in enumerate(inside) if n <= room), default=0)


def prefix_table(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ends`` (characters) and ``counts`` (tokens up to there), one entry for each piece."""
    kept = df.drop("ends", "counts").withColumn(text, text_or_empty(text))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept.schema.fields, T.StructField("ends", ints), T.StructField("counts", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                both = list(encoder.counted(batch.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, _lists([e for _, e in both], pa.int32()), _lists([c for c, _ in both], pa.int32())],
                    schema.names,
                )

    return kept.mapInArrow(run, schema)


def token_budget(df: DataFrame, path: str, budget: int, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``n_tokens`` and ``fit_chars`` (the longest prefix within ``budget`` tokens)."""
    kept = df.drop("n_tokens", "fit_chars").withColumn(text, text_or_empty(text))
    long = T.LongType()
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("n_tokens", long), T.StructField("fit_chars", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_tokenizer(path)
        prefixes = PrefixCounts(encoder)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                totals, fits = [], []
                for own, counts, ends in _runs(encoder, batch.column(text).to_pylist()):
                    totals.append(int(counts[-1]))
                    fits.append(_fit(encoder, prefixes, own, counts, ends, budget))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name) for f in fields), pa.array(totals, pa.int64()), pa.array(fits, pa.int64())],
                    schema.names,
                )

    return kept.mapInArrow(run, schema)


def _fit(encoder, prefixes, text, counts, ends, budget) -> int:
    if counts[-1] > budget and len(counts) == 1 and any(s in text for s in encoder.special):
        # a special string inside: tokens of the whole, cut at the ends the library reports
        whole = encoder.tokenizer.encode(text, add_special_tokens=False)
        return whole.offsets[budget][0] if budget < len(whole.ids) else len(text)
    return longest_prefix(text, counts, ends, budget, prefixes)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit of tokens."""
    path = public_tokenizers.path(TOKENIZER)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.octet_length(text_or_empty()).cast("long").alias("n_bytes")
    )
    return token_budget(rows, path, LIMIT).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars"
    )
