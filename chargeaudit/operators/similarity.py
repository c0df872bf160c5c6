"""Similarity search of descriptions in the catalog, and the rules built on it.

Search is exact. Inside a task a block of queries is compared with a block of
at most ``VECTOR_BLOCK_ROWS`` codes as matrices, and only ``k`` rows per query
leave the task. A larger catalog is cut into cells around pivot vectors, and a
query visits only the cells that can still hold one of its ``k`` nearest codes;
in many dimensions the bounds leave most cells, so that exact search comes
close to comparing all pairs. ``densesearch`` has the approximate index for
such catalogs. The pivot scheme follows W. Lu et al., "Efficient Processing of
k Nearest Neighbor Joins using MapReduce", VLDB 2012.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chargeaudit import constants as c
from chargeaudit.functions.text import is_blank, normalise_code, ws_trim
from chargeaudit.functions.vectors import score
from chargeaudit.operators.lookup import RECORD
from chargeaudit.operators.numbering import top_per_key
from chargeaudit.operators.rules import FINDING, LINE, finding_columns
from chargeaudit.session import broadcast_if_small, materialise, staged_if_small

Embedder = Callable[[list[str]], np.ndarray]

MAX_PIVOTS = 256
QUERY_BLOCK_ROWS = 65_536
PACK_BLOCKS = 4         # blocks of codes that a pack of cells holds at most
TASK_SCORES = 1 << 26   # scores that are worth a task of their own
DEAL_ROWS = 512         # queries that are dealt to packs at a time
FOUND_ROWS = 1_000_000  # matches a task holds before it keeps the best of them
BLOCK_SCORES = 1 << 20  # scores a task holds at a time, 4 MB
PIECE_CODES = 512       # codes that a block of queries is compared with at a time
EXACT_ROWS = 1 << 14    # pairs that are scored in double precision at a time
CELL_VECTORS = 1 << 16  # codes, and texts, of a cell of the grid of charged pairs
CELL_PAIRS = 1 << 19    # pairs of a cell
# Scores that differ by less are ties and go to the smaller code.
TIE_DIGITS = 9


def word_embedder(texts: DataFrame, text_col: str, dims: int = 256) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function that adds unit vectors, fitted once on ``texts``.

    Words are hashed into ``dims`` buckets and weighted by how rare they are in
    ``texts``. Returns ``embed(df, text_col, out_col)``.
    """
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit"),
    ]

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    model = Pipeline(stages=stages).fit(texts.select(filled(text_col).alias("_text")))

    def embed(df: DataFrame, column: str, out_col: str = "embedding") -> DataFrame:
        return (
            model.transform(df.withColumn("_text", filled(column)))
            .withColumn(out_col, vector_to_array("_unit", "float32"))
            .drop("_text", "_words", "_counts", "_weights", "_unit")
        )

    return embed


def embed_text(
    df: DataFrame,
    text_col: str,
    out_col: str = "embedding",
    embedder: Embedder | None = None,
    dims: int = 256,
) -> DataFrame:
    """Add a unit vector for the text.

    By default the hashed words of the text, weighted over ``df`` itself. An
    ``embedder`` takes a list of texts and returns one vector per text.
    """
    if embedder is not None:
        return _embed_with(df, text_col, out_col, embedder)
    return word_embedder(df, text_col, dims)(df, text_col, out_col)


def _embed_with(df: DataFrame, text_col: str, out_col: str, embedder: Embedder) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder([text or "" for text in batch[text_col]])
            batch[out_col] = [np.asarray(v, dtype="float32") for v in vectors]
            yield batch

    return df.mapInPandas(run, schema)


def usable_vectors(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name, vector); rows without a direction match nothing and go."""
    return df.select(F.col(key).alias(name), F.col(vector).alias("vector")).where(
        F.exists("vector", lambda x: x != 0)
    )


def first_copies(codes: DataFrame, k: int) -> DataFrame:
    """Of the codes with the very same ``vector`` the first ``k``, each with the first one as ``leader``.

    Only leaders keep their vector. Equal vectors are told by two 64-bit hashes with seeds of their
    own: sorting by the vectors themselves compares number by number, and copies to the last one.
    """
    hashes = ["_one", "_two"]
    hashed = codes.withColumn("_one", F.xxhash64("vector")).withColumn("_two", F.xxhash64(F.lit(1), "vector"))
    leader = F.min("code").over(Window.partitionBy(*hashes))
    return (
        top_per_key(hashed, hashes, ["code"], k, "_copy")
        .withColumn("leader", leader)
        .select("code", F.when(F.col("_copy") == 1, F.col("vector")).alias("vector"), "leader")
    )


def with_copies(found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """The best ``k`` codes of every query out of its best leaders ``found(query_id, code, similarity, rank)``.

    Codes of one vector have one similarity, so that the ``k`` best codes are among those of the
    ``k`` best leaders. ``copies(leader, code)`` has the others, at most ``k - 1`` of a leader.
    """
    if copies.isEmpty():
        return found
    others = copies.groupBy("leader").agg(F.collect_list("code").alias("_others"))
    every = F.concat(F.array("code"), F.coalesce("_others", F.array().cast(others.schema["_others"].dataType)))
    all_of = found.join(others, F.col("code") == F.col("leader"), "left").select("query_id", "similarity", F.explode(every).alias("code"))
    return top_per_key(all_of, ["query_id"], [F.desc("similarity"), "code"], k, "rank")


def block_kernels(k: int, digits: int = TIE_DIGITS, scores: int = BLOCK_SCORES):
    """What runs inside a task: (stack vectors, match a block).

    Local functions, so that the workers get them along with the task. At most ``scores`` scores
    are held at a time, whatever the sizes of the two blocks.
    """
    nearest = nearest_kernel(k, digits, scores)

    def stack(vectors: pd.Series) -> np.ndarray:
        """Rows of unit length."""
        matrix = np.stack(vectors.to_numpy()).astype("float64")
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix

    def match(ids: np.ndarray, queries: np.ndarray, codes: np.ndarray, units: np.ndarray) -> pd.DataFrame:
        """The best ``k`` codes of every query of a block."""
        row, at, similarity = nearest(queries, units, codes, [(np.arange(len(ids)), 0, len(codes))])
        return pd.DataFrame({"query_id": ids[row], "code": codes[at], "similarity": similarity})

    return stack, match


def nearest_kernel(k: int, digits: int = TIE_DIGITS, scores: int = BLOCK_SCORES):
    """A function that finds the best ``k`` codes of every query, of the codes that the query visits.

    All scores are taken in single precision, which only tells what can't be among the best: below
    the ``k``-th best so far by more than such a score errs. The few others are scored again in
    double precision, rounded and ranked.
    """

    def first_of_row(row: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs in ``order`` the first ``k`` of each row, and their places."""
        sorted_row = row[order]
        starts = np.flatnonzero(np.diff(sorted_row, prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        return order[place < k], place[place < k]

    def nearest(
        queries: np.ndarray, units: np.ndarray, codes: np.ndarray, visits: Iterable[tuple[np.ndarray, int, int]]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``queries`` and of ``units``, and their similarity.

        A visit is rows of ``queries``, and where the codes that they are compared with start and
        stop. Rows of both have unit length.
        """
        rank = np.unique(codes, return_inverse=True)[1]
        short_queries, short_units = queries.astype("float32"), units.astype("float32")
        # Rounding both vectors, each product and each sum errs by half a last place of 24 bits.
        slack = (queries.shape[1] + 8) * 2.0**-23 + 10.0**-digits
        best = np.full((len(queries), k), -np.inf)
        found, held = [], 0

        def compare(asking: np.ndarray, start: int, stop: int, asked: np.ndarray) -> None:
            nonlocal held
            bar = best[asking].min(axis=1)
            sims = asked @ short_units[start:stop].T
            if stop - start > k and np.isneginf(bar).any():
                bar = np.maximum(bar, np.partition(sims, stop - start - k, axis=1)[:, stop - start - k])
            row, col = np.divmod(np.flatnonzero(sims >= (bar - slack)[:, None].astype("float32")), stop - start)
            if not len(row):
                return
            exact = np.empty(len(row))
            for at in range(0, len(row), EXACT_ROWS):
                part = slice(at, at + EXACT_ROWS)
                exact[part] = np.einsum("ij,ij->i", queries[asking[row[part]]], units[start + col[part]])
            np.round(exact, digits, out=exact)
            kept, place = first_of_row(row, np.lexsort((rank[start + col], -exact, row)))
            row, col, exact = row[kept], start + col[kept], exact[kept]
            own = np.full((len(asking), k), -np.inf)
            own[row, place] = exact
            touched = np.unique(row)
            both = np.concatenate([best[asking[touched]], own[touched]], axis=1)
            best[asking[touched]] = np.partition(both, k, axis=1)[:, k:]
            wanted = exact >= best[asking[row], 0:k].min(axis=1)
            found.append((asking[row[wanted]], col[wanted], exact[wanted]))
            held += int(wanted.sum())

        def pruned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, at, exact = (np.concatenate(parts) for parts in zip(*found, strict=True))
            good = np.flatnonzero(exact >= best[row].min(axis=1))
            row, at, exact = row[good], at[good], exact[good]
            kept, _ = first_of_row(row, np.lexsort((rank[at], -exact, row)))
            return row[kept], at[kept], exact[kept]

        rows = max(1, scores // PIECE_CODES)
        for asking, start, stop in visits:
            for first in range(0, len(asking), rows):
                block = asking[first : first + rows]
                asked = short_queries[block]
                for piece in range(start, stop, PIECE_CODES):
                    compare(block, piece, min(piece + PIECE_CODES, stop), asked)
            if held > max(FOUND_ROWS, 2 * k * len(queries)):
                found = [pruned()]
                held = len(found[0][0])
        return pruned() if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    return nearest


def _search_one_block(queries: DataFrame, codes: pd.DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Catalog of at most one block: it travels with the tasks."""
    stack, match = block_kernels(k)
    names = codes["code"].to_numpy()
    units = stack(codes["vector"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield match(batch["query_id"].to_numpy(), stack(batch["vector"]), names, units)

    return queries.mapInPandas(run, schema)


def packed(cells: np.ndarray, sizes: np.ndarray, centres: np.ndarray, rows: int) -> np.ndarray:
    """The pack of each of ``cells``: neighbours share one up to ``rows`` codes.

    Cells are taken in the order of their ``centres`` along the direction in which these differ most.
    """
    own = centres - centres.mean(axis=0)
    along = own @ np.linalg.eigh(own.T @ own)[1][:, -1]
    pack_of = np.zeros(len(cells), np.int64)
    pack, held = 0, 0
    for at in np.lexsort((cells, along)):
        if held and held + sizes[at] > rows:
            pack, held = pack + 1, 0
        pack_of[at] = pack
        held += sizes[at]
    return pack_of


def compare_packs(
    visits: DataFrame,
    codes: DataFrame,
    sizes: pd.DataFrame,
    centres: np.ndarray,
    n_queries: int,
    k: int,
    schema: T.StructType,
    block_rows: int,
) -> DataFrame:
    """The best ``k`` codes of each pack for every row of ``visits(query_id, vector, cells)``.

    ``codes(code, vector, cell)`` lie in cells of ``sizes(cell, n)``, which are numbers of rows of
    ``centres``; ``m``, the queries of a cell, may be there too. Neighbouring cells make a pack. A query goes to a pack once, with the list of its
    cells there, and is compared with the codes of these cells only. So what is shuffled follows
    from the number of packs and not from the number of cells.
    """
    stack, _ = block_kernels(k)
    nearest = nearest_kernel(k)
    spark = visits.sparkSession
    if sizes.empty:
        return spark.createDataFrame([], schema)
    asked = sizes["m"] if "m" in sizes else n_queries
    scores = int((sizes["n"] * asked).sum())
    tasks = min(2 * spark.sparkContext.defaultParallelism, math.ceil(scores / TASK_SCORES))
    even = math.ceil(int(sizes["n"].sum()) / math.ceil(math.sqrt(tasks)))
    rows = min(max(even, block_rows), PACK_BLOCKS * block_rows)
    cells = sizes["cell"].to_numpy()
    pack_of = np.full(len(centres), -1, np.int64)
    pack_of[cells] = packed(cells, sizes["n"].to_numpy(), centres[cells], rows)
    plan = sizes.assign(pack=pack_of[cells])
    plan["blocks"] = -(-plan.groupby("pack")["n"].transform("sum") // rows)
    n_packs = int(pack_of.max()) + 1
    parts = max(1, math.ceil(n_queries / QUERY_BLOCK_ROWS), min(math.ceil(tasks / n_packs), n_packs))
    plan = plan[["cell", "pack", "blocks"]].astype("int32")
    of_cell = spark.createDataFrame(plan, "cell int, pack int, blocks int")
    of_pack = spark.createDataFrame(plan[["pack", "blocks"]].drop_duplicates(), "pack int, blocks int")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), DEAL_ROWS):
                batch = whole.iloc[start : start + DEAL_ROWS]
                row = np.repeat(np.arange(len(batch)), batch["cells"].map(len))
                cell = np.concatenate(batch["cells"].to_numpy())
                pack = pack_of[cell]
                order = np.lexsort((pack, row))
                order = order[pack[order] >= 0]
                row, cell, pack = row[order], cell[order], pack[order]
                first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(pack, prepend=-1) != 0))
                if len(first):
                    lists = pd.Series(np.split(cell, first[1:]), dtype=object)
                    dealt = batch.iloc[row[first]].reset_index(drop=True)
                    yield dealt.assign(cells=lists, pack=pack[first].astype("int32"))

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "code": [], "similarity": []})
        row = np.repeat(np.arange(len(mine)), mine["cells"].map(len))
        cell = np.concatenate(mine["cells"].to_numpy())
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        theirs = theirs.sort_values("_cell", kind="stable")
        numbers, starts = np.unique(theirs["_cell"].to_numpy(), return_index=True)
        asked = [row[np.searchsorted(cell, n) : np.searchsorted(cell, n, "right")] for n in numbers]
        visits = zip(asked, starts, [*starts[1:], len(theirs)], strict=True)
        codes = theirs["code"].to_numpy()
        row, at, similarity = nearest(stack(mine["vector"]), stack(theirs["_vector"]), codes, visits)
        return pd.DataFrame({"query_id": mine["query_id"].to_numpy()[row], "code": codes[at], "similarity": similarity})

    left = (
        visits.select("query_id", "vector", "cells")
        .mapInPandas(deal, T.StructType([*(visits.schema[n] for n in ("query_id", "vector", "cells")), T.StructField("pack", T.IntegerType())]))
        .join(F.broadcast(of_pack), "pack")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        .select("pack", "block", "part", "query_id", "vector", "cells")
    )
    right = (
        codes.join(F.broadcast(of_cell), "cell")
        .withColumn("_block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .select(F.col("pack").alias("_pack"), "_block", "_part", F.col("cell").alias("_cell"), "code", F.col("vector").alias("_vector"))
    )
    return (
        left.groupBy("pack", "block", "part").cogroup(right.groupBy("_pack", "_block", "_part")).applyInPandas(compare, schema)
    )


def _search_cells(
    queries: DataFrame,
    codes: DataFrame,
    n_codes: int,
    k: int,
    schema: T.StructType,
    block_rows: int,
) -> DataFrame:
    """Catalog of any size: cells around pivots, visited as the bounds demand."""
    stack, _ = block_kernels(k)
    n_pivots = min(MAX_PIVOTS, 2 * math.ceil(n_codes / block_rows))
    pivot_rows = codes.orderBy(F.xxhash64("code"), "code").limit(n_pivots).toPandas()
    pivots = stack(pivot_rows["vector"])

    cell_schema = T.StructType(
        [
            codes.schema["code"],
            codes.schema["vector"],
            T.StructField("cell", T.IntegerType()),
            T.StructField("far", T.DoubleType()),
        ]
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sims = stack(batch["vector"]) @ pivots.T
            best = sims.argmax(axis=1)
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sims[np.arange(len(batch)), best]))
            yield batch.assign(cell=best.astype("int32"), far=gap)

    celled = codes.mapInPandas(assign, cell_schema)
    # At most MAX_PIVOTS rows of at most k numbers: radius, size, nearest members.
    nearest = top_per_key(celled, ["cell"], ["far", "code"], k, "_n").groupBy("cell").agg(
        F.sort_array(F.collect_list("far")).alias("near")
    )
    stats = (
        celled.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        .join(nearest, "cell")
        .orderBy("cell")
        .toPandas()
    )
    cells = stats["cell"].to_numpy()
    radius = stats["radius"].to_numpy()
    near = np.full((len(stats), k), np.inf)
    for at, members in enumerate(stats["near"]):
        near[at, : len(members)] = members
    centres = pivots[cells]
    slack = 1e-6

    visit_schema = T.StructType(
        [
            queries.schema["query_id"],
            queries.schema["vector"],
            T.StructField("cells", T.ArrayType(T.IntegerType())),
        ]
    )

    def plan_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sims = stack(batch["vector"]) @ centres.T
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sims))
            # The k nearest codes are no farther than the k-th smallest bound.
            bound = (gap[:, :, None] + near[None, :, :]).reshape(len(batch), -1)
            kth = np.partition(bound, k - 1, axis=1)[:, k - 1]
            wanted = gap - radius[None, :] <= kth[:, None] + slack
            yield batch.assign(cells=[cells[row].astype("int32") for row in wanted])

    visits = queries.mapInPandas(plan_visits, visit_schema)
    return compare_packs(visits, celled, stats[["cell", "n"]], pivots, queries.count(), k, schema, block_rows)


def search_similar(
    queries: DataFrame,
    catalog: DataFrame,
    k: int = c.DEFAULT_TOP_K,
    query_key: str = "query_id",
    query_vector: str = "embedding",
    catalog_key: str = "code",
    catalog_vector: str = "embedding",
    max_k: int | None = None,
    block_rows: int = c.VECTOR_BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` most similar codes of every query, best first.

    Returns ``query_id, code, similarity_score, rank``. ``k`` is at least 1, and
    at most ``max_k`` if that is given (the published bound is ``MAX_TOP_K``).
    Equal scores go to the smaller code.
    """
    k = max(1, k if max_k is None else min(k, max_k))
    wanted = usable_vectors(queries, query_key, query_vector, "query_id")
    # Of several codes with the very same vector only the first k can be found, and one of them is
    # searched. Written once: the look at the first rows needs all of it already.
    coded = materialise(first_copies(usable_vectors(catalog, catalog_key, catalog_vector, "code"), k))
    known = coded.where("vector is not null").select("code", "vector")
    copies = coded.where("vector is null").select("leader", "code")
    schema = T.StructType(
        [
            wanted.schema["query_id"],
            known.schema["code"],
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    head = known.limit(block_rows + 1).toPandas()
    if head.empty:
        found = wanted.sparkSession.createDataFrame([], schema)
    elif len(head) <= block_rows:
        found = _search_one_block(wanted, head, k, schema)
    else:
        # The queries are read several times from here on.
        found = _search_cells(materialise(wanted), known, known.count(), k, schema, block_rows)
    ranked = with_copies(top_per_key(found, ["query_id"], [F.desc("similarity"), "code"], k, "rank"), copies, k)
    return ranked.select("query_id", "code", score(F.col("similarity")).alias("similarity_score"), "rank")


def with_records(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Matches with the catalog record of their code."""
    return matches.join(catalog.select("code", *RECORD), "code")


def resolve_lines(lines: DataFrame, catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """Catalog record of every line: by its code if known, else by description.

    ``matches`` holds the best match per description and needs to cover only
    the lines without an exact hit.
    """
    records = broadcast_if_small(catalog.select(F.col("code").alias("matched_code"), *RECORD))
    known = normalise_code(F.col("code")) == F.col("matched_code")
    columns = ["matched_code", *lines.columns, "match_kind", "similarity_score", *RECORD]
    exact = (
        lines.join(records, known)
        .withColumn("match_kind", F.lit("exact"))
        .withColumn("similarity_score", F.lit(None).cast("double"))
    )
    best = matches.select(
        "description", F.col("code").alias("matched_code"), F.col("similarity_score").cast("double").alias("similarity_score")
    )
    # Exact hits take no part in the second join, so they do not meet in one key there.
    similar = (
        lines.join(records.select("matched_code"), known, "left_anti")
        .join(staged_if_small(best), "description", "left")
        .join(records, "matched_code", "left")
        .withColumn("match_kind", F.when(F.col("matched_code").isNotNull(), "similar").otherwise("none"))
    )
    return exact.select(*columns).unionByName(similar.select(*columns))


def unresolved_descriptions(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct descriptions of lines without an exact hit: all that needs search."""
    return (
        lines.join(
            catalog.select(F.col("code").alias("_exact")),
            normalise_code(F.col("code")) == F.col("_exact"),
            "left_anti",
        )
        .select("description")
        .where(ws_trim(F.col("description")) != "")
        .distinct()
    )


def _grid(n_pairs: int, n_codes: int, n_texts: int, tasks: int) -> tuple[int, int]:
    """Rows (of codes) and columns (of texts) of a grid whose cells hold a bounded number of pairs and vectors.

    Of all such grids one that needs few copies of the vectors: a code goes to each column, a text to each row.
    """
    rows, columns = math.ceil(n_codes / CELL_VECTORS), math.ceil(n_texts / CELL_VECTORS)
    cells = max(tasks, math.ceil(n_pairs / CELL_PAIRS))
    columns = max(1, columns, min(n_texts, round(math.sqrt(cells * n_texts / max(1, n_codes)))))
    return max(1, rows, math.ceil(cells / columns)), columns


def own_scores(pairs: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(code, text_id, price, own_score) of all ``pairs(code, text_id)`` with a known code.

    ``texts(text_id, embedding)``; ``known(code, embedding, price)``. No vector travels with a pair:
    pairs are dealt by code and text to the cells of a grid, and a vector goes once to each cell of
    its row or column.
    """
    tasks = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    rows, columns = _grid(pairs.count(), known.count(), texts.count(), tasks)

    def dealt(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    text_key = F.col("text_id").cast("string")
    asked = pairs.select(dealt("code", rows).alias("row"), dealt("text_id", columns).alias("column"), "code", "text_id", text_key.alias("_text"))
    # Vectors of both kinds in one table: a text has no price and another flag.
    vectors = known.select(
        dealt("code", rows).alias("_row"), every(columns).alias("_column"), F.lit(True).alias("_is_code"), F.col("code").alias("_key"), "embedding", "price"
    ).unionByName(
        texts.select(
            every(rows).alias("_row"), dealt("text_id", columns).alias("_column"), F.lit(False).alias("_is_code"), text_key.alias("_key"),
            "embedding", F.lit(None).cast(known.schema["price"].dataType).alias("price"),
        )
    )
    schema = T.StructType([pairs.schema["code"], pairs.schema["text_id"], known.schema["price"], T.StructField("cosine", T.DoubleType())])
    step = EXACT_ROWS

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        is_code = theirs["_is_code"].to_numpy(dtype=bool)
        theirs = theirs.assign(_at=np.arange(len(theirs)))
        found = mine.merge(theirs.loc[is_code, ["_key", "price", "_at"]], left_on="code", right_on="_key").merge(
            theirs.loc[~is_code, ["_key", "_at"]], left_on="_text", right_on="_key", suffixes=("", "_of_text")
        )
        if not len(found):
            return pd.DataFrame({name: [] for name in schema.names})
        matrix = np.stack(theirs["embedding"].to_numpy())
        one, two, cosine = found["_at"].to_numpy(), found["_at_of_text"].to_numpy(), np.empty(len(found))
        for start in range(0, len(found), step):
            part = slice(start, start + step)
            a, b = matrix[one[part]].astype("float64"), matrix[two[part]].astype("float64")
            lengths = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
            # No direction, no similarity: such a pair comes back with a null.
            cosine[part] = np.divide(np.einsum("ij,ij->i", a, b), lengths, out=np.full(len(a), np.nan), where=lengths > 0)
        return found.assign(cosine=cosine)[schema.names]

    scored = asked.groupBy("row", "column").cogroup(vectors.groupBy("_row", "_column")).applyInPandas(compare, schema)
    return scored.select("code", "text_id", "price", score(F.col("cosine")).alias("own_score"))


def cheaper_fits(
    charges: DataFrame, catalog: DataFrame, margin: float = 0.05, k: int = c.DEFAULT_TOP_K
) -> DataFrame:
    """Charged (code, text) pairs whose text fits a cheaper code better.

    ``charges(code, text_id, embedding)`` and ``catalog(code, embedding,
    medicare_reference_price, has_price_data)``. The best cheaper code among
    the ``k`` most similar ones is kept when it beats the billed code's own
    similarity by ``margin``. Every distinct text is searched once.
    """
    pairs = materialise(charges.select("code", "text_id").distinct())
    texts = materialise(charges.select("text_id", "embedding").dropDuplicates(["text_id"]))
    priced = catalog.where("has_price_data").select(
        "code", "embedding", F.col("medicare_reference_price").alias("price")
    )
    near = search_similar(texts, priced, k=k, query_key="text_id").select(
        F.col("query_id").alias("text_id"), F.col("code").alias("other_code"), "similarity_score"
    )
    offers = near.join(
        priced.select(F.col("code").alias("other_code"), F.col("price").alias("other_price")), "other_code"
    )
    own = own_scores(pairs, texts, priced)
    better = own.join(offers, "text_id").where(
        (F.col("other_price") < F.col("price"))
        & (F.round(F.col("similarity_score") - F.col("own_score"), 4) >= margin)
    )
    return top_per_key(
        better, ["code", "text_id"], [F.desc("similarity_score"), "other_code"], 1, "_n"
    ).drop("_n")


def upcoded_lines(
    lines: DataFrame, catalog: DataFrame, margin: float = 0.05, k: int = c.DEFAULT_TOP_K
) -> DataFrame:
    """Lines whose description fits a cheaper code better than the billed one.

    ``lines`` carries, next to the line itself, ``text_id`` (equal for equal
    descriptions) and the description's ``embedding``.
    """
    coded = lines.where(normalise_code(F.col("code")).isNotNull()).withColumn(
        "_code", normalise_code(F.col("code"))
    )
    charges = coded.select(F.col("_code").alias("code"), "text_id", "embedding")
    fits = cheaper_fits(charges, catalog, margin, k).select(
        F.col("code").alias("_code"), "text_id", "other_code", "price"
    )
    return (
        coded.join(fits, ["_code", "text_id"])
        .select(
            *[F.col(name) for name in LINE],
            *finding_columns("upcoding", c.UPCODING_SEVERITY, price=F.col("price"), related=F.col("other_code")),
        )
        .select(*FINDING)
    )
