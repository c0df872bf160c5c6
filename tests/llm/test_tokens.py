"""Encoding, decoding, token files and prefix counts against the libraries."""

import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chargeaudit.llm import token_counts, token_files, tokens_bpe
from chargeaudit.llm.pieces import PieceEncoder, json_tokenizer

RANKS = public_tokenizers.path(tokens_bpe.RANKS)
JSON = public_tokenizers.path(token_files.TOKENIZER)
SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "a", "a   b", "a \n b", "\n\n x", "don't you're 'll I'd", "naïve — “q”", "中文字 漢", "\t\t a  b", "x" * 3000,
    "😀😀 👩‍👩‍👧", "a  ", "  a", "aaa aaaa aaaaa" * 30, "<|endoftext|> hi", "\x85 \x85 a", "1234 567  89", "!!!??? ...",
    "é́ ​ z", "a.\nB,\nc\n\nd", "word, Word. word; \nx", "a\x1c b", "\x00a \x00b", "end\n", "tab\tin word", "(a) [b] {c}",
]


@pytest.fixture(scope="module")
def ranks():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens_bpe.ranks_of(RANKS), special_tokens={}
    )


def _random_texts(n):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", " ", "\n", ".", ",", "'", "é", "ß", "漢", "7", "\t", "😀", "B", "re", "ve", "!"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_rank_encoding_equals_tiktoken(ranks):
    texts = ODD + _random_texts(800)
    ours = PieceEncoder(tokens_bpe.rank_tokenizer(RANKS), most=50).encode(texts)
    for text, ids in zip(texts, ours, strict=True):
        assert ids.tolist() == ranks.encode_ordinary(text)


def test_json_encoding_equals_library():
    library = Tokenizer.from_file(JSON)
    texts = ODD + _random_texts(800)
    for text, ids in zip(texts, json_tokenizer(JSON).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_prefix_counts_equal_encoding_every_prefix():
    encoder = json_tokenizer(JSON)
    prefixes = token_counts.PrefixCounts(encoder)
    for text in ODD + _random_texts(150):
        if len(text) > 200 or "<|" in text:
            continue
        expected = [len(encoder.tokenizer.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]
        if encoder.slots_of(text) is None:
            continue
        (counts, ends), = encoder.counted([text])
        found, at, before = [], 0, 0
        for count, end in zip(counts, ends, strict=True):
            found += [before + n for n in prefixes.of_piece(text[at:end])]
            at, before = end, count
        assert found == expected, repr(text)


def test_longest_prefix_keeps_the_budget():
    encoder = json_tokenizer(JSON)
    prefixes = token_counts.PrefixCounts(encoder)
    text = "The unbelievable internationalisation of words, again and again. " * 5
    (counts, ends), = encoder.counted([text])
    for budget in (0, 1, 5, 17, 40, 10_000):
        cut = token_counts.longest_prefix(text, counts, ends, budget, prefixes)
        assert len(encoder.tokenizer.encode(text[:cut], add_special_tokens=False).ids) <= budget
        assert cut == len(text) or len(encoder.tokenizer.encode(text[: cut + 1], add_special_tokens=False).ids) > budget


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for size in (0, 1, 3, 4, 5, 1000):
        values = rng.integers(0, 2 ** rng.choice([4, 8, 16, 24, 32], size), dtype=np.uint64).astype(np.uint32)
        control, data = token_files.pack(values)
        assert token_files.unpack(control, data, size).tolist() == values.tolist()


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")


def test_pack_takes_few_bytes_for_each_value():
    import tracemalloc

    values = np.arange(1_000_000, dtype=np.uint32) % 70_000
    tracemalloc.start()
    token_files.pack(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(values)


def test_files_hold_every_document_in_order(spark, tmp_path):
    rows = [(3, "c d", "x", "y"), (1, "a\n b", None, None), (2, None, None, None), (2, "again", None, None), (None, "no id", "", "")]
    token_files.write_tokens(_frame(spark, rows), f"{tmp_path}/t", JSON, block_ids=3)
    library = Tokenizer.from_file(JSON)
    read = sorted(token_files.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == [None, 1, 2, 2, 3]
    expected = {(d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for d, t, *_ in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in read} == expected
    start = 0
    for r in read:
        assert r.start == start
        start += len(r.ids)
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(spark, f"{tmp_path}/t").collect()}
    assert digests == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in read}
    token_files.write_tokens(_frame(spark, []), f"{tmp_path}/e", JSON)
    assert token_files.token_digests(spark, f"{tmp_path}/e").count() == 0


def test_encode_decode_keep_other_columns(spark, ranks):
    rows = [(i, t, "own", "own") for i, t in enumerate(ODD)] + [(None, None, None, None)]
    coded = tokens_bpe.encode(_frame(spark, rows), RANKS, offsets=True)
    back = tokens_bpe.decode(coded, RANKS).collect()
    assert len(back) == len(rows)
    for r in back:
        text = ODD[r.doc_id] if r.doc_id is not None else ""
        assert bytes(r.decoded).decode() == text and list(r.ids) == ranks.encode_ordinary(text)
        assert list(r.offsets) == (ranks.decode_with_offsets(list(r.ids))[1] if r.ids else [])
    assert tokens_bpe.decode(tokens_bpe.encode(_frame(spark, []), RANKS), RANKS).count() == 0


def test_split_characters_decode_to_their_bytes():
    table = tokens_bpe.ByteTable(tokens_bpe.ranks_of(RANKS))
    ids = np.array([i for i, t in ((r, t) for t, r in tokens_bpe.ranks_of(RANKS).items()) if t in (b"\xf0", b"\x9f")])
    assert len(table.decode(ids)) == 2
    with pytest.raises(ValueError):
        table.decode(np.array([10**7]))


def test_queries_on_the_smallest_tables(spark, ranks):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    library = Tokenizer.from_file(JSON)
    nine = {r.doc_id: r for r in tokens_bpe.op9_byte_bpe(spark, SF).collect()}
    ten = {r.doc_id: r for r in token_counts.op10_token_counts(spark, SF).collect()}
    four = {r.doc_id: r for r in token_files.op4_token_files(spark, SF).collect()}
    assert len(docs) == len(nine) == len(ten) == len(four)
    start = 0
    for d in docs:
        ids = ranks.encode_ordinary(d.text or "")
        assert nine[d.doc_id].n_tokens == len(ids)
        assert nine[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert nine[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
        own = library.encode(d.text or "", add_special_tokens=False).ids
        assert ten[d.doc_id].n_tokens == len(own) and ten[d.doc_id].over_limit == (len(own) > 512)
        assert ten[d.doc_id].n_bytes == len((d.text or "").encode())
        assert (four[d.doc_id].start, four[d.doc_id].n_tokens) == (start, len(own) + 1)
        assert four[d.doc_id].ids_crc32 == zlib.crc32(np.array([*own, 2], "<u4").tobytes())
        start += len(own) + 1


def test_token_budget_of_nulls_and_clashing_columns(spark):
    out = token_counts.token_budget(_frame(spark, [(1, None, "k", "mine"), (None, "a b", "k", "mine")]), JSON, 1).collect()
    assert {(r.doc_id, r.n_tokens, r.fit_chars, r.ids) for r in out} == {(1, 0, 0, "k"), (None, 2, 1, "k")}
    table = token_counts.prefix_table(_frame(spark, [(1, "a bc d", "k", "mine")]), JSON).first()
    assert table.ends == [1, 4, 6] and len(table.counts) == 3
    assert token_counts.prefix_table(_frame(spark, []).where(F.lit(False)), JSON).count() == 0


def test_worker_holds_one_model():
    # A worker holds the encoder while the stages after it run, so a second copy of the model counts.
    code = f"""
import re
import numpy, pyarrow
from chargeaudit.llm import tokens_bpe

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

before = held()
encoder = tokens_bpe.rank_encoder({RANKS!r})
print(held() - before)
"""
    root = tokens_bpe.__file__.rsplit("/chargeaudit/", 1)[0]
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert float(run.stdout) < 75
    assert tokens_bpe.rank_encoder(RANKS).most == tokens_bpe.KNOWN_PIECES


def test_stage_takes_one_worker_for_each_task(spark):
    docs = spark.createDataFrame([(i, "en", "web", t) for i, t in enumerate([*ODD, None])], "doc_id long, lang string, source string, text string")
    staged = tokens_bpe.bpe_stage(spark, docs, SF)
    assert staged._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = public_tokenizers.path(tokens_bpe.RANKS)
    plain = tokens_bpe.decode(tokens_bpe.encode(docs, path), path)
    assert {r.doc_id: r.ids for r in staged.collect()} == {r.doc_id: r.ids for r in plain.collect()}
    both = tokens_bpe.encode_and_decode(docs, path)
    assert both.columns == plain.columns and sorted(map(str, both.collect())) == sorted(map(str, plain.collect()))
    assert all(r.round_trip for r in staged.collect())
