"""Merkle manifest of a dataset: levels of aligned blocks as concatenated hex strings.

Rows of a tree are numbered by ranges, so no task holds a whole tree. ``BLOCK`` consecutive
nodes make an aligned block, which keeps each of its levels as one string of 64-digit
hashes: parents are hashes of fixed-width substrings of 128 digits, the last one perhaps
shorter, and the sibling of a node is the substring beside its own. The roots of the blocks
are the leaves of the next round, until one block holds what is left; going back down, the
siblings of a block's root follow those of its rows. A tree for each language gives the
subroots, and a tree over the subroots gives the root.

Defined results: null fields are hashed as ``-``; null ids come first, rows with the same id
stand in the order of their leaf hash; the null language is a tree of its own and the first;
a lone leaf is its own subroot, and a lone subroot the root; a node without a sibling adds
nothing to the proof and is hashed alone; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chargeaudit.llm.common import beside, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
STEPS = 8
BLOCK = 1 << STEPS
TAMPERED_ONE_IN = 7

# The levels of a block as strings. A whole block of a larger tree always has STEPS of them
# above its nodes, even if a single node is left; the last block of a tree ends at its root.
LEVELS = f"""
aggregate(sequence(1, {STEPS}), array(array_join(transform(rows, r -> r.node), '')), (a, l) ->
    if(n > {BLOCK} or length(element_at(a, -1)) > {HEX},
        concat(a, array(array_join(transform(
            sequence(0, cast(ceil(length(element_at(a, -1)) / {2 * HEX}) as int) - 1),
            j -> sha2(cast(substring(element_at(a, -1), j * {2 * HEX} + 1, {2 * HEX}) as binary), 256)), ''))),
        a))
"""

# The siblings of the node at place ``at`` of a block, level by level; empty where there is none.
SIBLINGS = f"""
transform(slice(levels, 1, size(levels) - 1),
    (s, l) -> substring(s, ((shiftright(at, l) ^ 1) * {HEX}) + 1, {HEX}))
"""


def digest(parts: Column) -> Column:
    return F.sha2(parts.cast("binary"), 256)


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hash of the fields in order, each ``-`` if null, else its bytes after their number and a colon."""
    texts = [c.cast("string") for c in fields.values()]
    return digest(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    )


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its ``tree`` from 0, and ``n``, the rows of the tree."""
    by = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = (
        nodes.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    # Range bounds come from a sample: counts and numbers must see the very same ranges.
    ranged = written(ranged, "manifest-rows")
    parts = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
    )
    return (
        beside(ranged, parts, ["tree", "_part"])
        .withColumn("pos", F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, block, n, rows, levels) of nodes (tree, pos, n, node, payload)."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "node", *payload)))
    grouped = nodes.groupBy("tree", F.shiftright("pos", STEPS).alias("block")).agg(F.max("n").alias("n"), rows.alias("rows"))
    return grouped.withColumn("levels", F.expr(LEVELS))


def _down(blocks: DataFrame, upper: DataFrame | None, payload: list[str]) -> DataFrame:
    """Rows of the blocks with their siblings up to the root of the tree, and that root."""
    if upper is None:
        above = blocks.withColumn("_above", F.array().cast("array<string>")).withColumn(
            "root", F.element_at("levels", -1)
        )
    else:
        above = blocks.join(
            upper.select("tree", F.col("pos").alias("block"), F.col("siblings").alias("_above"), "root"), ["tree", "block"]
        )
    rows = above.select("tree", "n", "levels", "_above", "root", F.explode("rows").alias("r"))
    return rows.withColumn("at", (F.col("r.pos") % BLOCK).cast("int")).select(
        "tree",
        F.col("r.pos").alias("pos"),
        F.col("r.node").alias("node"),
        *[F.col(f"r.{c}").alias(c) for c in payload],
        F.concat(F.expr(SIBLINGS), "_above").alias("siblings"),
        "root",
    )


def merkle_trees(nodes: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Siblings of every node up to the root of its tree.

    ``nodes`` has ``tree``, ``pos`` from 0, ``n`` (nodes of the tree), ``node`` (hash) and the
    columns of ``payload``. Returns ``tree``, ``pos``, ``node``, the payload, ``siblings`` (an
    array from the node upwards, empty text where a node stands alone) and ``root``.
    """
    payload = payload or []
    rounds = [written(_blocks(nodes, payload), "manifest-blocks")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        roots = rounds[-1].select(
            "tree",
            F.col("block").alias("pos"),
            F.ceil(F.col("n") / BLOCK).cast("long").alias("n"),
            F.element_at("levels", -1).alias("node"),
        )
        rounds.append(written(_blocks(roots, []), "manifest-blocks"))
    upper = None
    for blocks in reversed(rounds[1:]):
        upper = _down(blocks, upper, [])
    return _down(rounds[0], upper, payload)


def folded(start: str, pos: str, siblings: str) -> Column:
    """The root that a node's hash, its place and its siblings lead to."""
    return F.expr(
        f"""
        aggregate({siblings}, struct({start} as h, {pos} as p), (a, s) -> struct(
            sha2(cast(if(a.p & 1 = 1, concat(s, a.h), concat(a.h, s)) as binary), 256) as h,
            shiftright(a.p, 1) as p)).h
        """
    )


def manifest(documents: DataFrame, now: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its present fields lead to.

    ``now`` gives fields as they are found when the manifest is checked; by default they are
    unchanged. Returns ``doc_id, lang, leaf, pos, siblings, subroot, root, folded_root, verified``;
    ``siblings`` goes from the leaf to the root.
    """
    fields = {c: F.col(c) for c in FIELDS}
    leaves = documents.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        "doc_id",
        "lang",
        leaf_hash(fields).alias("node"),
        leaf_hash(fields | (now or {})).alias("found"),
    )
    own = merkle_trees(numbered(leaves, ["doc_id", "node"]), ["doc_id", "lang", "found"]).withColumnRenamed("root", "subroot")
    own = written(own, "manifest-leaves")
    subroots = own.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node"))
    top = merkle_trees(numbered(subroots, ["name"]), ["name"]).select(
        F.col("name").alias("tree"), F.col("pos").alias("_rank"), F.col("siblings").alias("_above"), "root"
    )
    joined = beside(own, written(top, "manifest-top"), ["tree"]).withColumn("_sub", folded("found", "pos", "siblings"))
    return joined.withColumn("folded_root", folded("_sub", "_rank", "_above")).select(
        "doc_id",
        "lang",
        F.col("node").alias("leaf"),
        "pos",
        F.concat("siblings", "_above").alias("siblings"),
        "subroot",
        "root",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, checked after one more character is claimed for some of them."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_ONE_IN == 0
    claimed = F.when(F.coalesce(changed, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(table(spark, sf_dir, "documents"), {"n_chars": claimed}).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(F.array_join("siblings", "")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


# The crc of the id goes over the table of its 256 steps; trees grow level by level.
OP12_SQL = """
with recursive steps(i, k, v) as (
    select cast(i as bigint), 0, cast(i as bigint) from range(256) r(i)
    union all
    select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from steps where k < 8
),
crc_table as (select list(v order by i) as t from steps where k = 8),
fields as (
    select doc_id, lang, n_chars,
        coalesce(strlen(cast(doc_id as varchar)) || ':' || cast(doc_id as varchar), '-')
            || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') as head,
        coalesce(strlen(text) || ':' || text, '-') as tail,
        xor(4294967295, list_reduce(
            list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
            lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 7 = 0 as changed
    from documents, crc_table
),
hashed as (
    select doc_id, lang, coalesce('=' || lang, '') as tree,
        sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') || tail) as leaf,
        case when changed
            then sha256(head || coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || cast(n_chars + 1 as varchar), '-') || tail)
            else sha256(head || coalesce(strlen(cast(n_chars as varchar)) || ':' || cast(n_chars as varchar), '-') || tail) end as found
    from fields
),
leaves as (
    select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n
    from hashed
),
nodes(tree, lvl, pos, node, n) as (
    select tree, 0, pos, leaf, n from leaves
    union all
    select tree, lvl + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (max(n) + 1) // 2
    from nodes where n > 1 group by tree, lvl, pos // 2
),
subroots as (
    select tree, node, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1
),
tops(lvl, pos, node, n) as (
    select 0, pos, node, n from subroots
    union all
    select lvl + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (max(n) + 1) // 2
    from tops where n > 1 group by lvl, pos // 2
),
low as (
    select l.tree, l.pos, list(coalesce(s.node, '') order by o.lvl) as sibs,
        list(case when o.pos % 2 = 1 then 'l' else 'r' end || coalesce(s.node, '') order by o.lvl) as moves
    from leaves l
    join nodes o on o.tree = l.tree and o.n > 1 and o.pos = l.pos // (cast(1 as bigint) << o.lvl)
    left join nodes s on s.tree = o.tree and s.lvl = o.lvl and s.pos = xor(o.pos, 1)
    group by l.tree, l.pos
),
high as (
    select u.tree, list(coalesce(s.node, '') order by o.lvl) as sibs,
        list(case when o.pos % 2 = 1 then 'l' else 'r' end || coalesce(s.node, '') order by o.lvl) as moves
    from subroots u
    join tops o on o.n > 1 and o.pos = u.pos // (cast(1 as bigint) << o.lvl)
    left join tops s on s.lvl = o.lvl and s.pos = xor(o.pos, 1)
    group by u.tree
),
proofs as (
    select l.doc_id, l.leaf, u.node as subroot, (select node from tops where n = 1) as root,
        sha256(coalesce(array_to_string(w.sibs, ''), '') || coalesce(array_to_string(h.sibs, ''), '')) as proof_sha256,
        list_reduce(list_prepend(l.found, coalesce(w.moves, []) || coalesce(h.moves, [])),
            lambda a, m: sha256(case when m[1] = 'l' then m[2:] || a else a || m[2:] end)) as folded_root
    from leaves l
    join subroots u on u.tree = l.tree
    left join low w on w.tree = l.tree and w.pos = l.pos
    left join high h on h.tree = l.tree
)
select *, folded_root = root as verified from proofs
"""
