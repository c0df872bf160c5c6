"""Approximate search of vectors: cells around centres, a measured number of them read for each query.

The centres are fitted by k-means on a bounded sample of the codes; then every code goes to
the cell of its nearest centre. A query reads the cells of its nearest centres and is compared
with their codes, in blocks of bounded size. Small cells share a block: a query goes there once
with the list of its cells, and its best codes of all of them come back. How many cells that takes is measured and not
guessed: for a bounded sample of queries the true neighbours are found by comparing with all
codes, and the number of probes is the smallest one that reaches the share ``target`` of them.
Vectors without structure need many probes, and the report says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit import constants as c
from chargeaudit.functions.vectors import score
from chargeaudit.operators.numbering import top_per_key
from chargeaudit.operators.similarity import block_kernels, compare_packs, usable_vectors
from chargeaudit.session import materialise

FIT_ROWS = 100_000   # codes that the centres are fitted on
MAX_CELLS = 16_384   # centres travel with every task
SAMPLE_QUERIES = 256
FIT_ROUNDS = 8


class DenseIndex(NamedTuple):
    """``codes(code, vector, cell)`` of all codes, the centres, probes of a query, recall on the sample."""

    codes: DataFrame
    centres: np.ndarray
    probes: int
    recall: float


class ProbedSearch(NamedTuple):
    """``matches(query_id, code, similarity_score, rank)`` and the one-row ``report`` of the work done."""

    matches: DataFrame
    report: DataFrame


def _sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of their key."""
    return df.orderBy(F.xxhash64(key, F.lit("sample")), key).limit(rows)


def _centres(codes: DataFrame, n_cells: int) -> np.ndarray:
    """Unit centres, fitted on a sample of at most ``FIT_ROWS`` codes."""
    fitted = _sample(codes, "code", FIT_ROWS).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=n_cells, distanceMeasure="cosine", initMode="random", maxIter=FIT_ROUNDS, seed=7).fit(fitted)
    centres = np.stack(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def _with_cell(codes: DataFrame, centres: np.ndarray) -> DataFrame:
    stack, _ = block_kernels(1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=(stack(batch["vector"]) @ centres.T).argmax(axis=1).astype("int32"))

    return codes.mapInPandas(assign, T.StructType([*codes.schema.fields, T.StructField("cell", T.IntegerType())]))


def _neighbours(codes: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, cell) of the true neighbours of at most ``SAMPLE_QUERIES`` queries, found among all codes."""
    stack, match = block_kernels(k)
    numbers, units = np.arange(len(queries)), stack(queries["vector"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                best = match(numbers, units, batch["code"].to_numpy(), stack(batch["vector"]))
                cell = dict(zip(batch["code"], batch["cell"], strict=True))
                yield best.assign(query_id=best["query_id"].astype("int64"), cell=[cell[code] for code in best["code"]])

    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            codes.schema["code"],
            T.StructField("similarity", T.DoubleType()),
            T.StructField("cell", T.IntegerType()),
        ]
    )
    best = top_per_key(codes.mapInPandas(compare, schema), ["query_id"], [F.desc("similarity"), "code"], k, "_n")
    return best.select("query_id", "cell").toPandas()


def build_dense_index(
    codes: DataFrame, queries: DataFrame, k: int, target: float, n_cells: int | None = None
) -> DenseIndex:
    """Index ``codes(code, vector)`` and measure the probes on a sample of ``queries(query_id, vector)``."""
    n_cells = n_cells or min(MAX_CELLS, max(1, math.ceil(math.sqrt(codes.count()))))
    centres = _centres(codes, n_cells)
    celled = materialise(_with_cell(codes, centres))
    asked = _sample(queries, "query_id", SAMPLE_QUERIES).toPandas()
    if asked.empty:
        return DenseIndex(celled, centres, 1, 1.0)
    true = _neighbours(celled, asked, k)
    stack, _ = block_kernels(1)
    order = np.argsort(-(stack(asked["vector"]) @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort(place[true["query_id"], true["cell"]] + 1)
    probes = int(needed[max(0, math.ceil(target * len(needed)) - 1)]) if len(needed) else 1
    return DenseIndex(celled, centres, probes, float((needed <= probes).mean()) if len(needed) else 1.0)


def probe(queries: DataFrame, index: DenseIndex, k: int, block_rows: int = c.VECTOR_BLOCK_ROWS) -> ProbedSearch:
    """Compare every row of ``queries(query_id, vector)`` with the codes of its nearest cells."""
    stack, _ = block_kernels(1)
    centres, probes = index.centres, min(index.probes, len(index.centres))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sims = stack(batch["vector"]) @ centres.T
                cells = np.argpartition(-sims, probes - 1, axis=1)[:, :probes]
                yield batch.assign(cells=list(cells.astype("int32")))

    visit_schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    visits = materialise(queries.mapInPandas(nearest, visit_schema))
    codes = index.codes.groupBy("cell").agg(F.count("*").alias("n"))
    asked = visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"))
    # One row for each cell, of which there are at most ``MAX_CELLS``.
    sizes = materialise(codes.join(asked, "cell"))
    schema = T.StructType(
        [queries.schema["query_id"], index.codes.schema["code"], T.StructField("similarity", T.DoubleType())]
    )
    found = compare_packs(visits, index.codes, sizes.toPandas(), centres, visits.count(), k, schema, block_rows)
    ranked = top_per_key(found, ["query_id"], [F.desc("similarity"), "code"], k, "rank")
    matches = ranked.select("query_id", "code", score(F.col("similarity")).alias("similarity_score"), "rank")
    report = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("compared_pairs")).select(
        F.lit(len(centres)).cast("bigint").alias("n_cells"),
        F.lit(probes).cast("bigint").alias("probes"),
        F.lit(index.recall).alias("sample_recall"),
        "compared_pairs",
    )
    return ProbedSearch(matches, report)


def search_probed(
    queries: DataFrame,
    catalog: DataFrame,
    k: int = c.DEFAULT_TOP_K,
    target: float = 0.95,
    query_key: str = "query_id",
    query_vector: str = "embedding",
    catalog_key: str = "code",
    catalog_vector: str = "embedding",
    n_cells: int | None = None,
    block_rows: int = c.VECTOR_BLOCK_ROWS,
) -> ProbedSearch:
    """About ``target`` of the ``k`` most similar codes of every query; see ``search_similar`` for all of them.

    Codes with the very same vector lie in one cell and are all compared.
    """
    wanted = materialise(usable_vectors(queries, query_key, query_vector, "query_id"))
    known = materialise(usable_vectors(catalog, catalog_key, catalog_vector, "code"))
    if known.isEmpty():
        schema = T.StructType([wanted.schema["query_id"], known.schema["code"]])
        none = wanted.sparkSession.createDataFrame([], schema)
        matches = none.withColumn("similarity_score", F.lit(0.0)).withColumn("rank", F.lit(1))
        zero = wanted.sparkSession.range(1).select(*[F.lit(0).cast("bigint").alias(n) for n in ("n_cells", "probes")])
        return ProbedSearch(
            matches, zero.select("*", F.lit(1.0).alias("sample_recall"), F.lit(0).cast("bigint").alias("compared_pairs"))
        )
    return probe(wanted, build_dense_index(known, wanted, k, target, n_cells), k, block_rows)
