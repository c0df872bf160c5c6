"""Search of descriptions in the catalog by weighted words: an inverted index with score bounds.

A text is a sparse unit vector: each word weighs its count times how rare it is in the
catalog, and the score of two texts is their cosine. The index keeps, for each word, the
list of codes that hold it, heaviest first and cut into blocks of at most ``LIST_BLOCK``
entries, each with its largest weight. So the list of a common word is many rows of the
index and many tasks, and most of its blocks are never read.

The search is exact. The words of a query are put in order of what they can add to a score at
most; a code that holds the i-th word and none before it scores at most the block's weight
plus the rest of the bounds. Each query first reads the leading block of its first word, which
gives the score its ``k``-th result must reach, and after that only the blocks whose bound
reaches it. Inside a task a group of queries is compared with a block of codes as small
matrices over the words of these queries. Prefix and block bounds follow R. Bayardo et al.,
"Scaling Up All Pairs Similarity Search", WWW 2007, and S. Ding and T. Suel, "Faster Top-k
Document Retrieval Using Block-Max Indexes", SIGIR 2011.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chargeaudit import constants as c
from chargeaudit.functions.text import is_blank
from chargeaudit.functions.vectors import score
from chargeaudit.operators.numbering import number_rows, top_per_key
from chargeaudit.session import materialise

WORD = r"[\p{L}\p{N}]+"
LIST_BLOCK = 1_024
QUERY_GROUP = 256
# Scores are compared after rounding to nine digits; ties go to the smaller code.
SLACK = 1e-8


class TextIndex(NamedTuple):
    """``words(word, idf, most)``, ``lists(word, block, top, n, codes)`` with the vectors of the codes, number of codes."""

    words: DataFrame
    lists: DataFrame
    n_codes: int


def word_counts(df: DataFrame, key: str, text_col: str, name: str) -> DataFrame:
    """(name, word, tf) of every text, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    return (
        df.select(F.col(key).alias(name), F.explode(words).alias("word"))
        .groupBy(name, "word")
        .agg(F.count("*").cast("double").alias("tf"))
    )


def word_vectors(counts: DataFrame, idf: DataFrame, name: str) -> DataFrame:
    """(name, word, weight): unit vectors of the counted words that ``idf(word, idf)`` knows.

    Unknown words would lengthen a query's vector for all codes alike, so they are left out.
    """
    weighted = counts.join(idf, "word").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(name)))
    return weighted.select(name, "word", (F.col("raw") / length).alias("weight"))


def catalog_vectors(catalog: DataFrame, text_col: str = "document") -> tuple[DataFrame, DataFrame, int]:
    """(code, word, weight) of all codes, (word, idf), number of codes."""
    n_codes = catalog.count()
    counts = materialise(word_counts(catalog, "code", text_col, "code"))
    idf = counts.groupBy("word").agg(F.log1p(F.lit(float(n_codes)) / F.count("*")).alias("idf"))
    return word_vectors(counts, idf, "code"), idf, n_codes


def build_index(catalog: DataFrame, text_col: str = "document", block: int = LIST_BLOCK) -> TextIndex:
    """Index the texts of ``catalog(code, text)``; its tables are written once."""
    vectors, idf, n_codes = catalog_vectors(catalog, text_col)
    vectors = materialise(vectors)
    whole = vectors.groupBy("code").agg(F.collect_list("word").alias("vw"), F.collect_list("weight").alias("vx"))
    # Lists of very common words are numbered in ranges, see ``number_rows``.
    ordered = number_rows(
        vectors.select("word", "code", (-F.col("weight")).alias("minus")), "word", ["minus", "code"], "place"
    )
    lists = (
        ordered.withColumn("block", F.floor((F.col("place") - 1) / block).cast("int"))
        .join(whole, "code")
        .groupBy("word", "block")
        .agg(
            (-F.min("minus")).alias("top"),
            F.count("*").alias("n"),
            F.collect_list(F.struct("code", "vw", "vx")).alias("codes"),
        )
    )
    most = vectors.groupBy("word").agg(F.max("weight").alias("most"))
    return TextIndex(materialise(idf.join(most, "word")), materialise(lists), n_codes)


def _bounded(queries: DataFrame, index: TextIndex) -> DataFrame:
    """(query, word, weight, place, rest): words by what they can add, and what those behind can add."""
    vectors = word_vectors(word_counts(queries, "query", "text", "query"), index.words.select("word", "idf"), "query")
    gains = vectors.join(index.words.select("word", "most"), "word").withColumn("gain", F.col("weight") * F.col("most"))
    order = Window.partitionBy("query").orderBy(F.desc("gain"), "word")
    behind = order.rowsBetween(1, Window.unboundedFollowing)
    return gains.select(
        "query",
        "word",
        "weight",
        F.row_number().over(order).alias("place"),
        F.coalesce(F.sum("gain").over(behind), F.lit(0.0)).alias("rest"),
    )


def _compare(k: int):
    """What a task does with the queries that visit a block: their best ``k`` codes of it."""

    def run(visits: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "code": [], "similarity": []})
        if not len(visits) or not len(blocks):
            return empty
        codes = blocks["codes"].iloc[0]
        names = np.array([r["code"] for r in codes], dtype=object)
        sizes = [len(r["vw"]) for r in codes]
        row_of = np.repeat(np.arange(len(codes)), sizes)
        words = np.concatenate([r["vw"] for r in codes])
        weights = np.concatenate([r["vx"] for r in codes])
        found = []
        for start in range(0, len(visits), QUERY_GROUP):
            part = visits.iloc[start : start + QUERY_GROUP]
            place: dict[str, int] = {}
            for qw in part["qw"]:
                for word in qw:
                    place.setdefault(word, len(place))
            at = np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))
            known = at >= 0
            codes_by_word = np.zeros((len(codes), len(place)))
            codes_by_word[row_of[known], at[known]] = weights[known]
            queries_by_word = np.zeros((len(part), len(place)))
            for i, (qw, qx) in enumerate(zip(part["qw"], part["qx"], strict=True)):
                queries_by_word[i, [place[w] for w in qw]] = qx
            sims = np.round(queries_by_word @ codes_by_word.T, 9)
            keep = min(k, len(codes))
            kth = np.partition(sims, len(codes) - keep, axis=1)[:, len(codes) - keep]
            row, col = np.nonzero((sims >= kth[:, None]) & (sims > 0))
            found.append(pd.DataFrame({"query": part["query"].to_numpy()[row], "code": names[col], "similarity": sims[row, col]}))
        best = pd.concat(found).sort_values(["query", "similarity", "code"], ascending=[True, False, True], kind="stable")
        return best.groupby("query", sort=False).head(k)

    return run


def _read_blocks(visits: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(query, code, similarity) of the best ``k`` codes in every visited block.

    Queries of a block are dealt to groups, so a block that many queries visit is many tasks.
    """
    schema = "query bigint, code string, similarity double"
    sizes = visits.groupBy("word", "block").agg(F.ceil(F.count("*") / (16 * QUERY_GROUP)).cast("int").alias("parts"))
    mine = visits.join(sizes, ["word", "block"]).withColumn("part", F.pmod("query", F.col("parts")).cast("int"))
    theirs = lists.join(sizes, ["word", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["word", "block", "part"]
    # Both sides stem from the same tables: names of their own keep the columns apart.
    theirs = theirs.select(*[F.col(key).alias(f"_{key}") for key in keys], "codes")
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*[f"_{key}" for key in keys])).applyInPandas(_compare(k), schema)


class TextSearch(NamedTuple):
    """``matches(query, code, similarity, rank)`` and ``visits(query, word, block, n)``, the work done."""

    matches: DataFrame
    visits: DataFrame


def search_index(queries: DataFrame, index: TextIndex, k: int) -> TextSearch:
    """The best ``k`` codes of every row of ``queries(query bigint, text)`` that shares a word with one."""
    words = materialise(_bounded(queries, index))
    vectors = words.groupBy("query").agg(F.collect_list("word").alias("qw"), F.collect_list("weight").alias("qx"))
    stats = index.lists.select("word", "block", "top", "n")
    first = words.where("place = 1").join(stats.where("block = 0"), "word").select("query", "word", "block", "n")
    seen = materialise(_read_blocks(first.join(vectors, "query"), index.lists, k))
    ranked = top_per_key(seen, ["query"], [F.desc("similarity"), "code"], k, "rank")
    bars = ranked.where(F.col("rank") == k).select("query", F.col("similarity").alias("bar"))
    more = (
        words.join(bars, "query", "left")
        .withColumn("bar", F.coalesce("bar", F.lit(0.0)))
        # No block of a word can reach the bar if the word and all behind it can't.
        .join(index.words.select("word", "most"), "word")
        .where(F.col("weight") * F.col("most") + F.col("rest") >= F.col("bar") - SLACK)
        .join(stats, "word")
        .where((F.col("place") > 1) | (F.col("block") > 0))
        .where(F.col("weight") * F.col("top") + F.col("rest") >= F.col("bar") - SLACK)
        .select("query", "word", "block", "n")
    )
    more = materialise(more)
    rest = _read_blocks(more.join(vectors, "query"), index.lists, k)
    both = seen.unionByName(rest).groupBy("query", "code").agg(F.max("similarity").alias("similarity"))
    matches = top_per_key(both, ["query"], [F.desc("similarity"), "code"], k, "rank")
    return TextSearch(matches, first.unionByName(more))


def _numbered_texts(queries: DataFrame, text_col: str) -> DataFrame:
    """(query, text): each distinct text that isn't blank, with a number of its own."""
    texts = queries.select(F.col(text_col).alias("text")).where(~is_blank(F.col(text_col))).distinct()
    return materialise(texts.withColumn("query", F.monotonically_increasing_id()))


def top_k(k: int, max_k: int | None) -> int:
    return max(1, k if max_k is None else min(k, max_k))


def search_text(
    queries: DataFrame,
    catalog: DataFrame,
    k: int = c.DEFAULT_TOP_K,
    text_col: str = "text",
    max_k: int | None = None,
    block: int = LIST_BLOCK,
) -> DataFrame:
    """The ``k`` best codes of every query text, with a status.

    ``queries`` keeps its columns; added are ``status``, ``code``, ``similarity_score`` and
    ``rank``. A query of white space or null has one row with the status ``blank_query``, one
    that shares no word with the catalog a row with ``no_match``; all others have up to ``k``
    rows with ``ok``. Equal texts are searched once. ``max_k`` bounds ``k`` if it is given
    (the published bound of the search tool is ``MAX_TOOL_TOP_K``).
    """
    texts = _numbered_texts(queries, text_col)
    index = build_index(catalog.select("code", "document"), block=block)
    found = search_index(texts, index, top_k(k, max_k)).matches
    matches = found.join(texts, "query").select(
        "text", "code", score(F.col("similarity")).alias("similarity_score"), F.col("rank").cast("int").alias("rank")
    )
    return with_status(queries, matches, text_col)


def with_status(queries: DataFrame, matches: DataFrame, text_col: str) -> DataFrame:
    """Queries with their rows of ``matches(text, code, similarity_score, rank)`` and a status."""
    asked = queries.join(matches.withColumnRenamed("text", "_text"), F.col(text_col) == F.col("_text"), "left").drop("_text")
    status = (
        F.when(is_blank(F.col(text_col)), "blank_query").when(F.col("code").isNull(), "no_match").otherwise("ok")
    )
    return asked.select(*queries.columns, status.alias("status"), "code", "similarity_score", "rank")


def search_cost(queries: DataFrame, catalog: DataFrame, k: int = c.DEFAULT_TOP_K, text_col: str = "text") -> DataFrame:
    """One row: distinct queries, codes, all pairs of them, and the pairs that the search compared."""
    texts = _numbered_texts(queries, text_col)
    index = build_index(catalog.select("code", "document"))
    compared = search_index(texts, index, k).visits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared_pairs"))
    n_queries = texts.agg(F.count("*").alias("n_queries"))
    return compared.join(n_queries).select(
        "n_queries",
        F.lit(index.n_codes).cast("bigint").alias("n_codes"),
        (F.col("n_queries") * index.n_codes).alias("all_pairs"),
        "compared_pairs",
    )


def best_matches(descriptions: DataFrame, catalog: DataFrame, text_col: str = "description") -> DataFrame:
    """Best match of every distinct description that shares a word with the catalog."""
    texts = _numbered_texts(descriptions, text_col)
    found = search_index(texts, build_index(catalog.select("code", "document")), 1).matches
    return found.join(texts, "query").select(
        F.col("text").alias(text_col), "code", score(F.col("similarity")).alias("similarity_score")
    )


def word_weights(catalog: DataFrame) -> DataFrame:
    """(code, word, weight): the sparse vectors of the catalog's search documents."""
    vectors, _, _ = catalog_vectors(catalog.select("code", "document"))
    return vectors


class TextFacts(NamedTuple):
    """What the similarity rules need of the lines' descriptions, see ``detect_anomalies``."""

    fits: DataFrame
    close: DataFrame


def text_facts(
    lines: DataFrame, catalog: DataFrame, margin: float, min_score: float, k: int = c.DEFAULT_TOP_K
) -> TextFacts:
    """Judge all descriptions by one search: which are close to a code, and which fit a cheaper one better.

    ``fits(code, description, other_code, price)``: for a charged code with a price, the best of
    the ``k`` most similar codes that costs less and beats the charged code's own score by
    ``margin``. ``close(description)``: descriptions whose best score is at least ``min_score``.
    """
    texts = _numbered_texts(lines.select("description"), "description")
    index = build_index(catalog.select("code", "document"))
    found = materialise(search_index(texts, index, k).matches.withColumn("score", score(F.col("similarity"))))
    named = texts.withColumnRenamed("text", "description")
    close = found.where((F.col("rank") == 1) & (F.col("score") >= min_score)).join(named, "query").select("description")

    prices = catalog.where("has_price_data").select("code", F.col("medicare_reference_price").alias("price"))
    offers = found.join(prices, "code").select(
        "query", F.col("code").alias("other_code"), F.col("price").alias("other_price"), F.col("score").alias("other_score"), "similarity"
    )
    pairs = materialise(
        lines.select("code", "description").distinct().join(prices, "code").join(named, "description")
    )
    mine = word_vectors(word_counts(texts, "query", "text", "query"), index.words.select("word", "idf"), "query")
    theirs = word_vectors(word_counts(catalog, "code", "document", "code"), index.words.select("word", "idf"), "code")
    asked, known = pairs.select("code", "query"), theirs.withColumnRenamed("weight", "_weight")
    own = (
        asked.join(mine, "query")
        .join(known, ["code", "word"])
        .groupBy("code", "query")
        .agg(score(F.round(F.sum(F.col("weight") * F.col("_weight")), 9)).alias("own_score"))
    )
    better = (
        pairs.join(offers, "query")
        .where(F.col("other_price") < F.col("price"))
        .join(own, ["code", "query"], "left")
        .where(F.round(F.col("other_score") - F.coalesce("own_score", F.lit(0.0)), 4) >= margin)
    )
    best = top_per_key(better, ["code", "query"], [F.desc("similarity"), "other_code"], 1, "_n")
    return TextFacts(best.select("code", "description", "other_code", "price"), close)
