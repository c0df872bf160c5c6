"""The Merkle manifest against trees built one hash after the other."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chargeaudit.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, root string"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def _brute(rows):
    """(doc_id, leaf) -> (subroot, root, siblings)."""
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    names = sorted(langs, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, _leaf(r), r[0]) for r in langs[name]))
        trees[name] = ([(o[3], o[2]) for o in own], _tree([o[2] for o in own]))
    top = _tree([trees[n][1][-1][0] for n in names])
    found = {}
    for rank, name in enumerate(names):
        order, levels = trees[name]
        for place, key in enumerate(order):
            proof = []
            for own, at in ((levels, place), (top, rank)):
                for level in own[:-1]:
                    proof.append(level[at ^ 1] if at ^ 1 < len(level) else "")
                    at //= 2
            found.setdefault(key, []).append((levels[-1][0], top[-1][0], proof))
    return found


def _rows(n, langs, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = None if rng.random() < 0.02 else "é" * rng.randrange(4) + "x" * rng.randrange(30)
        rows.append((i, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, len(text or "")]), text))
    rng.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "rows",
    [
        _rows(1, ["en"]),
        _rows(2, ["en", None]),
        _rows(700, ["en", "en", "en", "de", None, "ß", ""]),
        _rows(257, ["en"]) + [(None, "s", "en", 1, "a"), (None, "s", "en", 1, "b"), (5, "t", "xx", 9, "long " * 100_000)],
        _rows(513, [None]) + _rows(5, [None], 4) + [(7, "s", None, 2, "same")] * 3,
    ],
)
def test_proofs_equal_brute_force(spark, rows):
    expected = _brute(rows)
    ours = manifest.manifest(_frame(spark, rows)).collect()
    assert len(ours) == len(rows)
    seen = {}
    for r in ours:
        seen.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, r.siblings))
        assert r.verified and r.folded_root == r.root
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in expected.items()}


def test_changed_fields_are_found(spark):
    rows = _rows(300, ["en", "de"])
    claimed = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    chars = {r[0]: r[3] for r in rows}
    for r in manifest.manifest(_frame(spark, rows), {"n_chars": claimed}).collect():
        assert r.verified == (r.doc_id % 5 != 0 or chars[r.doc_id] is None)


def test_three_rounds_of_blocks(spark):
    n = 70_000
    nodes = spark.range(n).select(
        F.lit("t").alias("tree"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("n"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("node")
    )
    levels = _tree([_h(str(i)) for i in range(n)])
    rows = manifest.merkle_trees(nodes).where("pos in (0, 255, 256, 65535, 65536, 69999)").collect()
    assert len(rows) == 6
    for r in rows:
        assert r.root == levels[-1][0]
        assert r.siblings == [v[(r.pos >> i) ^ 1] if (r.pos >> i) ^ 1 < len(v) else "" for i, v in enumerate(levels[:-1])]


def test_empty_table_and_query(spark):
    assert manifest.manifest(_frame(spark, _rows(3, ["en"])).where("false")).count() == 0
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    expected = _brute([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.values()])
    rows = manifest.op12_merkle_manifest(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ((subroot, root, siblings),) = expected[r.doc_id, r.leaf]
        assert (r.subroot, r.root, r.proof_sha256) == (subroot, root, _h("".join(siblings)))
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
