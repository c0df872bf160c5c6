"""Search by words against scoring all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from chargeaudit.constants import MAX_TOOL_TOP_K
from chargeaudit.operators import textsearch as ts


def _vectors(texts, idf):
    out = {}
    for key, text in texts.items():
        raw = {w: n * idf[w] for w, n in Counter(re.findall(r"\w+", text.lower())).items() if w in idf}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out[key] = {w: x / length for w, x in raw.items()}
    return out


def _brute(queries, catalog, k):
    words = [set(re.findall(r"\w+", text.lower())) for text in catalog.values()]
    count = Counter(w for ws in words for w in ws)
    idf = {w: math.log1p(len(catalog) / n) for w, n in count.items()}
    codes, asked = _vectors(catalog, idf), _vectors(queries, idf)
    found = {}
    for query, mine in asked.items():
        scores = {c: round(sum(x * v.get(w, 0) for w, x in mine.items()), 9) for c, v in codes.items()}
        best = sorted((c for c in scores if scores[c] > 0), key=lambda c: (-scores[c], c))[:k]
        found[query] = [(c, round(scores[c], 4)) for c in best]
    return found


def _catalog(n, seed=1):
    rng = random.Random(seed)
    common, rare = ["visit", "office", "new", "x", "scan"], [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(n):
        words = rng.choices(common, k=rng.randrange(1, 4)) + rng.choices(rare, k=rng.randrange(4))
        texts[f"C{i:04d}"] = " ".join(words)
    texts["C0001"] = texts["C0000"]
    return texts


def _frame(spark, texts):
    return spark.createDataFrame([(c, t, 1.0) for c, t in texts.items()], "code string, document string, total_rvu double")


def _queries(n, seed=2):
    rng = random.Random(seed)
    words = ["visit", "office", "new", "x", "scan", "unseen"] + [f"w{i}" for i in range(60)]
    return {str(i): " ".join(rng.choices(words, k=rng.randrange(1, 6))) for i in range(n)} | {"one": "visit", "two": "Visit, VISIT!"}


@pytest.mark.parametrize(("k", "block"), [(1, 8), (5, 8), (5, 1024), (500, 8)])
def test_equals_scoring_all_pairs(spark, k, block):
    texts, queries = _catalog(240), _queries(40)
    frame = spark.createDataFrame([(q, t, "own", -1) for q, t in queries.items()], "id string, text string, word string, query int")
    rows = ts.search_text(frame, _frame(spark, texts), k=k, block=block).collect()
    ours = {}
    for r in sorted(rows, key=lambda r: r.rank or 0):
        assert r.word == "own" and r.query == -1
        ours.setdefault(r.id, []).extend([(r.code, r.similarity_score)] if r.code else [])
        assert r.status == ("ok" if r.code else "no_match")
    expected = _brute(queries, texts, k)
    for query, found in expected.items():
        assert [c for c, _ in ours[query]] == [c for c, _ in found]
        assert [s for _, s in ours[query]] == pytest.approx([s for _, s in found], abs=1.1e-4)


def test_status_and_bound_of_k(spark):
    catalog = _frame(spark, {f"A{i:04d}": "visit" for i in range(30)} | {"B0001": ""})
    asked = spark.createDataFrame(
        [(1, " \t\n"), (2, None), (3, ""), (4, "nothing like it"), (5, "visit"), (6, "visit"), (7, "?!")], "id int, text string"
    )
    rows = ts.search_text(asked, catalog, k=99, max_k=MAX_TOOL_TOP_K).collect()
    status = {i: {r.status for r in rows if r.id == i} for i in range(1, 8)}
    assert status == {1: {"blank_query"}, 2: {"blank_query"}, 3: {"blank_query"}, 4: {"no_match"}, 5: {"ok"}, 6: {"ok"}, 7: {"no_match"}}
    assert [sum(r.id == i for r in rows) for i in (4, 5, 6)] == [1, 10, 10]
    assert sorted(r.code for r in rows if r.id == 5) == [f"A{i:04d}" for i in range(10)]
    assert ts.search_text(asked, catalog, k=0).where("id = 5").count() == 1
    assert ts.search_text(asked.where("false"), catalog).count() == 0
    assert {r.status for r in ts.search_text(asked, catalog.where("false")).collect()} == {"blank_query", "no_match"}


def test_bounds_leave_most_pairs_unread(spark):
    rng = random.Random(6)
    texts = {f"C{i:05d}": f"visit office part{rng.randrange(300)} kind{rng.randrange(40)}" for i in range(3_000)}
    asked = spark.createDataFrame([(t,) for t in list(texts.values())[:200]], "text string")
    cost = ts.search_cost(asked, _frame(spark, texts), k=1).first()
    assert cost.n_codes == 3_000 and cost.all_pairs == cost.n_queries * 3_000
    assert 0 < cost.compared_pairs < 0.05 * cost.all_pairs


def test_facts_for_the_rules(spark):
    schema = "code string, document string, medicare_reference_price double, has_price_data boolean"
    catalog = spark.createDataFrame(
        [("A0001", "A0001: brief visit", 10.0, True), ("B0002", "B0002: long visit", 90.0, True), ("C0003", "C0003: brief visit", 5.0, False)], schema
    )
    lines = spark.createDataFrame(
        [("B0002", "brief visit"), ("A0001", "long visit"), ("B0002", "long visit"), (None, "spoon"), ("C0003", "brief visit"), (None, None)],
        "code string, description string",
    )
    facts = ts.text_facts(lines, catalog, margin=0.05, min_score=0.1)
    assert [tuple(r) for r in facts.fits.collect()] == [("B0002", "brief visit", "A0001", 90.0)]
    assert sorted(r.description for r in facts.close.collect()) == ["brief visit", "long visit"]
