"""Near-duplicate join, substring dedup, components and the pipeline against brute force."""

import collections
import hashlib
import random

import numpy as np

import corpus_pipeline
from chargeaudit.llm import decontaminate, near_join, repeats, secrets
from chargeaudit.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row string, symbol string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], DOCS)


def _varied(seed, n):
    """Texts with exact copies, copies with few and many changed words, shared passages and runs."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = []
    for i in range(n):
        kind = rng.randrange(8)
        if texts and kind < 3:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 2, 4, 10])):
                if words:
                    words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append(" ".join([*(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))), passage, f"end{i}"]))
        elif kind == 4:
            texts.append("la " * rng.randrange(130) + "li lo " * rng.randrange(60))
        else:
            texts.append(" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 260))))
    return texts


def _near(texts):
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    group = {i: i for i in sets}
    links = collections.Counter()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                    links[a] += 1
                    links[b] += 1
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group = {i: new if g == old else g for i, g in group.items()}
    return {i: (group[i], links[i]) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found.get(v, v) == r for v, r in root.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    texts = dict(enumerate([*_varied(1, 170), None, "", "one two", "one two", "two one"]))
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(_docs(spark, texts.items())).collect()}
    assert found == _near(texts)


def test_blocks_of_large_components_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_CLASSES", 7)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(base[:i] + [f"c{i}"] + base[i + 1 :]) for i in range(90)}
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(_docs(spark, texts.items())).collect()}
    assert found == _near(texts)


def test_a_large_group_leaves_the_runs_early(spark, monkeypatch):
    """Near copies are tied to the least class of their node at once; what is near only to some of them isn't lost."""
    rows = []
    split = near_join._split
    monkeypatch.setattr(near_join, "_split", lambda members, runs: rows.append(split(members, runs)) or rows[-1])
    base = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(base[:i] + [f"c{i}"] + base[i + 1 :]) for i in range(300)}
    texts |= {300 + i: " ".join([*base[: 364 - 4 * i], *(f"d{i}.{j}" for j in range(4 * i))]) for i in range(12)}
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(_docs(spark, texts.items())).collect()}
    assert found == _near(texts)
    first, second = (frame.where("node IS NOT NULL").count() for frame in rows[:2])
    assert second < first / 4


def test_near_rows_without_ids_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = _docs(spark, [(7, text), (7, text + " more"), (None, text), (9, "other words here today now"), (None, None)])
    rows = near_join.near_duplicates(docs).collect()
    assert sorted((r.class_id, r.n_links) for r in rows if r.class_id is not None) == [(7, 2)] * 3 + [(9, 0)]
    assert len(rows) == 5
    kept = near_join.near_stage(spark, docs, SF)
    assert kept.count() == 3 and kept.columns == [c for c in docs.columns if c != "row"] or kept.columns == docs.columns
    assert near_join.near_duplicates(docs.where("false")).count() == 0


def test_runs_follow_from_the_recall():
    assert near_join.runs_needed(0.9) < near_join.runs_needed(0.99999)
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 62, 100).astype(np.uint64)])) for _ in range(2))
    equal = (near_join.signature(a) == near_join.signature(b)).mean()
    assert abs(equal - 900 / 1100) < 0.15


def _removed(texts):
    owner = {}
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(words):
        for j in range(len(words[i]) - 49):
            owner.setdefault(tuple(words[i][j : j + 50]), i)
    result = {}
    for i, own in words.items():
        gone = set()
        for j in range(len(own) - 49):
            if owner[tuple(own[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        kept = [w for k, w in enumerate(own) if k not in gone]
        result[i] = (len(own), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return result


def test_substring_dedup_equals_brute_force(spark):
    for seed in (1, 2):
        texts = dict(enumerate([*_varied(seed, 160), None, "", "a b " * 400, "b a " * 300, "c " * 51, "c " * 50]))
        rows = repeats.without_repeats(_docs(spark, texts.items())).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == _removed(texts)


def test_every_equal_window_has_an_equal_anchor():
    rng = random.Random(7)
    from chargeaudit.llm.common import WordHashes

    hashes = WordHashes()
    window = [str(rng.randrange(4)).encode() for _ in range(50)]
    seen = set()
    for _ in range(60):
        left = [str(rng.randrange(4)).encode() for _ in range(rng.randrange(40))]
        right = [str(rng.randrange(4)).encode() for _ in range(rng.randrange(40))]
        seen.add(int(repeats.anchors(hashes.of(left + window + right))[len(left)]))
    assert len(seen) == 1


def test_substring_rows_without_ids_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = repeats.without_repeats(_docs(spark, [(2, text), (2, text), (None, text), (5, text + " z")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (2, 0), (2, 0), (5, 60)]
    assert repeats.without_repeats(_docs(spark, [])).count() == 0


def test_queries_on_the_smallest_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_join.op8_near_join(spark, SF).collect()}
    assert found == _near(texts)
    rows = repeats.op7_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == _removed(texts)


def test_pipeline_stages_on_the_smallest_tables(spark):
    """Each stage on its own input: one of each group, no leaks, no fixed-pattern secrets, ids of the whole text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        held[name] = {r.doc_id: r.text for r in docs.collect()}
    quality, near, clean, masked = held.values()
    groups = _near(quality)
    assert set(near) == {i for i, (group, _) in groups.items() if i == group}
    assert clean.keys() == near.keys() - {r.doc_id for r in decontaminate.op2_decontaminate(spark, SF).collect()}
    assert masked.keys() == clean.keys()
    spans = {r.doc_id: r.spans for r in secrets.op6_secret_scan(spark, SF).collect()}
    assert all((masked[i] == clean[i]) == (spans[i] == "") for i in clean)
    last = steps["byte-level BPE"](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(masked) and all(r.round_trip for r in last)
