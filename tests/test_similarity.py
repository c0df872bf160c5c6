import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit.constants import MAX_TOP_K
from chargeaudit.operators.similarity import resolve_lines, search_similar, unresolved_descriptions
from chargeaudit.functions.vectors import cosine, score
from chargeaudit.operators import similarity


def _frame(spark, key, vectors):
    rows = pd.DataFrame({key: [f"c{n:04d}" for n in range(len(vectors))], "embedding": list(vectors)})
    return spark.createDataFrame(rows, f"{key} string, embedding array<double>")


def _brute(queries, codes, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(queries) @ unit(codes).T, 9)
    out = set()
    for q, row in enumerate(sims):
        for rank, c in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k], 1):
            out.add((f"c{q:04d}", f"c{c:04d}", rank))
    return out


@pytest.mark.parametrize("block_rows", [1000, 32])
def test_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 4
    codes = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))
    codes[100:200] = codes[0]  # a third of the catalog is one and the same vector
    queries = np.vstack([centres + 0.1, rng.normal(size=(20, 8)), codes[:1]])
    found = search_similar(
        _frame(spark, "query_id", queries), _frame(spark, "code", codes), k=5, block_rows=block_rows
    )
    assert {(r.query_id, r.code, r.rank) for r in found.collect()} == _brute(queries, codes, 5)


def test_clamps_and_small_catalog(spark):
    codes = np.eye(3)
    found = search_similar(_frame(spark, "query_id", codes[:1]), _frame(spark, "code", codes), k=99)
    assert found.count() == 3
    assert found.where("rank = 1").first().similarity_score == 1.0
    assert search_similar(_frame(spark, "query_id", codes), _frame(spark, "code", codes), k=0).count() == 3


@pytest.mark.parametrize("max_k, expected", [(None, 30), (MAX_TOP_K, 20)])
def test_bound_of_k_is_an_option(spark, max_k, expected):
    codes = _frame(spark, "code", np.random.default_rng(2).normal(size=(40, 4)))
    one = _frame(spark, "query_id", np.ones((1, 4)))
    assert search_similar(one, codes, k=30, max_k=max_k).count() == expected


def test_known_codes_need_no_search(spark):
    catalog = spark.createDataFrame(
        [("A0001", "a", "a", 1.0, 1.0, True), ("B0002", "b", "b", 2.0, 1.0, True)],
        "code string, long_description string, short_description string, medicare_reference_price double, "
        "total_rvu double, has_price_data boolean",
    )
    lines = spark.createDataFrame(
        [(1, " a0001", "x"), (2, "Z9999", "x"), (3, None, "y"), (4, None, None), (5, "B0002", None)],
        "line_no int, code string, description string",
    )
    best = spark.createDataFrame([("x", "B0002", 0.5)], "description string, code string, similarity_score double")
    rows = {r.line_no: (r.matched_code, r.match_kind, r.similarity_score) for r in resolve_lines(lines, catalog, best).collect()}
    assert rows == {
        1: ("A0001", "exact", None),
        2: ("B0002", "similar", 0.5),
        3: (None, "none", None),
        4: (None, "none", None),
        5: ("B0002", "exact", None),
    }
    assert [r.description for r in unresolved_descriptions(lines, catalog).orderBy("description").collect()] == ["x", "y"]


def test_a_block_holds_a_bounded_number_of_scores():
    rng = np.random.default_rng(5)
    stack, match = similarity.block_kernels(3)
    queries, codes = (stack(pd.Series(list(rng.normal(size=(n, 8)).astype("float32")))) for n in (3000, 8192))
    names = np.array([f"{n:05d}" for n in range(len(codes))], dtype=object)
    tracemalloc.start()
    try:
        found = match(np.arange(len(queries)), queries, names, codes)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 3 * len(queries) and peak < 64e6


def test_few_scores_take_double_precision(monkeypatch):
    rng = np.random.default_rng(9)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    centres = rng.normal(size=(60, 16))
    # Codes nearer to each other than single precision tells, and equal ones that go by name.
    codes = unit(np.vstack([np.repeat(centres, 30, axis=0) + rng.normal(size=(1800, 16)) * 1e-8, np.repeat(centres[:9], 9, axis=0), rng.normal(size=(700, 16))]))
    queries = unit(np.vstack([centres + rng.normal(size=(60, 16)) * 0.01, rng.normal(size=(90, 16))]))
    names = np.array([f"{n:05d}" for n in rng.permutation(len(codes))], dtype=object)
    scored, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, one, two: scored.append(len(one)) or einsum(how, one, two))
    row, at, scores = similarity.nearest_kernel(4, scores=1 << 14)(
        queries, codes, names, [(np.arange(len(queries)), 0, 1000), (np.arange(len(queries))[::2], 1000, 2300), (np.arange(len(queries)), 2300, len(codes))]
    )
    assert sum(scored) < 0.1 * len(queries) * len(codes)
    for q in range(len(queries)):
        seen = [n for n in range(len(codes)) if q % 2 == 0 or not 1000 <= n < 2300]
        exact = {n: round(float(queries[q] @ codes[n]), 9) for n in seen}
        wanted = sorted(seen, key=lambda n: (-exact[n], names[n]))[:4]
        assert np.allclose(sorted(scores[row == q], reverse=True), [exact[n] for n in wanted], atol=2e-9)
        if exact[wanted[-1]] - max(exact[n] for n in seen if n not in wanted) > 2e-9:
            assert set(at[row == q]) == set(wanted)


def test_vectors_do_not_travel_with_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    known = _frame(spark, "code", np.vstack([rng.normal(size=(70, 5)), np.zeros((1, 5))])).withColumn("price", F.lit(2.5))
    texts = _frame(spark, "text", rng.normal(size=(30, 5))).select(F.substring("text", 2, 9).cast("long").alias("text_id"), "embedding")
    pairs = known.select("code").crossJoin(texts.select("text_id")).where(F.xxhash64("code", "text_id") % 3 != 0)
    pairs = pairs.unionByName(spark.createDataFrame([("unknown", 1)], "code string, text_id long"))
    plain = pairs.join(texts, "text_id").join(known.withColumnRenamed("embedding", "_known"), "code").select(
        "code", "text_id", "price", score(cosine(F.col("embedding"), F.col("_known"))).alias("own_score")
    )
    for bounds in ((1 << 16, 1 << 19), (16, 100)):
        monkeypatch.setattr(similarity, "CELL_VECTORS", bounds[0])
        monkeypatch.setattr(similarity, "CELL_PAIRS", bounds[1])
        ours = similarity.own_scores(pairs, texts, known)
        assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect())) and ours.where("own_score is null").count() > 5
    # A billion pairs: 10,000 cells of 100, and few copies of the vectors: each of them less than a thousand times.
    rows, columns = similarity._grid(10**9 // 100_000, 10**6 // 1000, 100, 24)
    assert rows * columns >= 100 and rows >= 1000 // 16 and columns >= 100 // 16 and max(rows, columns) < 1000


def test_copies_are_not_searched(spark):
    rng = np.random.default_rng(8)
    queries, distinct = rng.normal(size=(15, 5)), rng.normal(size=(9, 5))
    codes = np.repeat(distinct, 7, axis=0)
    catalog = _frame(spark, "code", codes)
    coded = similarity.first_copies(similarity.usable_vectors(catalog.unionByName(catalog), "code", "embedding", "code"), 4)
    kept = coded.toPandas()
    assert len(kept) == 9 * 4 and kept["vector"].notna().sum() == kept["leader"].nunique() == 9
    for block_rows in (4, 1000):
        found = search_similar(_frame(spark, "query_id", queries), catalog, k=6, block_rows=block_rows)
        assert {(r.query_id, r.code, r["rank"]) for r in found.collect()} == _brute(queries, codes, 6)


def test_a_large_catalog_with_copies_is_computed_once(spark):
    rng = np.random.default_rng(5)
    queries, codes = rng.normal(size=(12, 6)), np.repeat(rng.normal(size=(20, 6)), 4, axis=0)
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    catalog = _frame(spark, "code", codes)
    found = search_similar(
        _frame(spark, "query_id", queries), catalog.mapInArrow(counted, catalog.schema), k=3, block_rows=32
    )
    assert {(r.query_id, r.code, r["rank"]) for r in found.collect()} == _brute(queries, codes, 3)
    assert rows.value == len(codes)


def test_small_cells_share_a_pack(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 8))
    pack_of = similarity.packed(np.arange(60), np.full(60, 10), centres, 100)
    assert np.bincount(pack_of).tolist() == [10] * 6
    codes = [(f"c{i}", rng.normal(size=8).tolist(), i % 60) for i in range(600)]
    asked = [(q, rng.normal(size=8).tolist(), sorted(rng.choice(60, 7, replace=False).tolist())) for q in range(40)]
    visits = spark.createDataFrame(asked, "query_id long, vector array<double>, cells array<int>")
    known = spark.createDataFrame(codes, "code string, vector array<double>, cell int")
    found = similarity.compare_packs(
        visits,
        known,
        pd.DataFrame({"cell": range(60), "n": 10}),
        centres,
        40,
        3,
        T.StructType([visits.schema["query_id"], known.schema["code"], T.StructField("similarity", T.DoubleType())]),
        block_rows=40,
    ).toPandas()
    # At most three rows from each of the packs of 160 codes, not from each of the seven cells.
    assert found.groupby("query_id").size().max() <= 3 * 4
    best = found.sort_values(["query_id", "similarity"], ascending=[True, False]).groupby("query_id")["code"].agg(lambda x: list(x)[:3])
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q, vector, cells in asked:
        scores = {code: unit(vector) @ unit(own) for code, own, cell in codes if cell in cells}
        assert best[q] == sorted(scores, key=scores.get, reverse=True)[:3]
