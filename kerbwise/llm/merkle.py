"""Merkle manifest of a dataset: trees per source under one root, proofs and a check of every leaf.

Built levels are stored as node rows linked to their parents. A recursive query then climbs from each leaf, one level a
step: it meets the node's siblings, folds them with the hash that comes from below and hands both to the parent. In the
upper levels, which many leaves share, it climbs once from each node where leaves enter, and they fold what it met.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.llm.store import ordered_sums, small, stored

FANOUT = 3
#: A node is named by its first leaf and its level; levels of the upper tree, over the sources, count from UPPER on.
UPPER, LEVELS = 64, 128
#: Up to this many nodes above a level travel to every task; below it they are met by a shuffle, and there a node has
#: at most FANOUT ** levels leaves, so no key is hot. A level of no more nodes is built in one task, not in a shuffle of
#: as many tasks as the whole table gets.
TOP_NODES = 20_000


def field(value: Column) -> Column:
    """UTF-8 length, colon and text of a value; a dash for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """SHA-256 as bytes; inputs are given as text."""
    return F.unhex(F.sha2(text, 256))


def as_text(hashes: Column) -> Column:
    return F.lower(F.hex(hashes))


def leaf_hash(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def name_of(first: Column, level: Column | int) -> Column:
    return first * LEVELS + (F.lit(level) if isinstance(level, int) else level)


def levels(leaves: DataFrame, base: int, sizes: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves`` (tree, place, size, first, id, hash): ``size`` nodes of a tree at places from 0, each with its
    first leaf; ``sizes`` has the size of the largest tree and the numbers of leaves and trees. Returns the node rows below
    the tops, (id, level, parent, lefts, rights): hashes of the other nodes of its run, and the tops (tree, first, id,
    hash). Every level is one aggregation that combines its runs of three before they move, so a tree that holds a third
    of all leaves is no hot key; a level has a third of the rows of the one below."""
    nodes, tops, level = None, None, base
    largest, rows, trees = sizes
    now = leaves
    while True:
        done = now.filter("size = 1").select("tree", "first", "id", "hash")
        tops = done if tops is None else tops.unionByName(done)
        if largest <= 1:
            return nodes, tops
        going = now.filter("size > 1")
        if rows <= TOP_NODES:
            going = going.coalesce(1)
        run = F.floor(F.col("place") / FANOUT).alias("run")
        child = [F.max(F.when(F.col("place") % FANOUT == i, F.struct("id", "hash"))).alias(f"c{i}") for i in range(FANOUT)]
        runs = going.groupBy("tree", run).agg(F.first("size").alias("size"), F.min("first").alias("first"), *child)
        hashes = [F.coalesce(F.col(f"c{i}.hash"), F.lit(b"")) for i in range(FANOUT)]
        level += 1
        runs = runs.withColumns({"parent": name_of(F.col("first"), level), "hash": digest(as_text(F.concat(*hashes)))})
        runs = stored(runs, "runs")
        members = F.array(*[
            F.struct(F.col(f"c{i}.id").alias("id"), F.concat(F.lit(b""), *hashes[:i]).alias("lefts"), F.concat(F.lit(b""), *hashes[i + 1 :]).alias("rights"))
            for i in range(FANOUT)
        ])
        below = runs.select("parent", F.lit(level - 1).alias("level"), F.explode(members).alias("c")).filter("c.id is not null").select("c.id", "level", "parent", "c.lefts", "c.rights")
        nodes = below if nodes is None else nodes.unionByName(below)
        now = runs.select("tree", F.col("run").alias("place"), F.ceil(F.col("size") / FANOUT).alias("size"), "first", F.col("parent").alias("id"), "hash")
        largest, rows = -(-largest // FANOUT), (rows + (FANOUT - 1) * trees) // FANOUT  # rows at most


@contextmanager
def unlimited_recursion(spark: SparkSession):
    """Recursive queries of any number of rows; the levels of a tree stay far below the limit of steps."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def climb(start: DataFrame, nodes: DataFrame, name: str, columns: dict[str, str], result: str, hint: str = "") -> DataFrame:
    """A recursive query over the node rows, stored: ``start`` has node and the names of ``columns``, whose values say how each
    goes on when the climb (c) meets the row (n) of its node. ``result`` is what is selected from all rows met, with
    the number of the step."""
    spark = start.sparkSession
    views = {f"{name}_start": start, f"{name}_nodes": nodes}
    for view, frame in views.items():
        frame.createOrReplaceTempView(view)
    try:
        with unlimited_recursion(spark):
            met = spark.sql(f"""
                WITH RECURSIVE climb(step, node, {", ".join(columns)}) AS (
                    SELECT 0, node, {", ".join(columns)} FROM {name}_start
                    UNION ALL
                    SELECT {hint} c.step + 1, n.parent, {", ".join(columns.values())} FROM climb c JOIN {name}_nodes n ON c.node = n.id
                )
                SELECT {result}
            """)
            return stored(met, "climb")
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


FOLD = "unhex(sha2(lower(hex(concat(n.lefts, c.folded, n.rights))), 256))"
CHAIN = "array<struct<lefts: binary, rights: binary>>"


def folded(start: Column, chain: Column) -> Column:
    """The hash at the end of a chain of siblings, from below up, that ``start`` is folded with."""
    return F.aggregate(chain, start, lambda below, n: digest(as_text(F.concat(n["lefts"], below, n["rights"]))))


def joined_text(siblings: Column) -> Column:
    """Text of an array of bytes, in order."""
    return F.array_join(F.transform(siblings, as_text), "")


def build(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
          tampered: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves, node rows and the trees' tops: leaves (leaf, key, hash, after, tree), where ``after`` is the hash with the
    columns of ``tampered`` in place of those of the table."""
    column = {f: F.col(f"`{f}`") for f in {*fields, key, source}}
    changed = column | (tampered or {})
    rows = docs.select(
        column[source].alias("tree"), column[key].alias("key"),
        leaf_hash(*[column[f] for f in fields]).alias("hash"), leaf_hash(*[changed[f] for f in fields]).alias("after"),
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("tree").isNotNull(), "tree", F.col("key").isNull(), "key", "hash", "row"]
    placed = stored(ordered_sums(rows, order, {"leaf": F.lit(1).cast("long")}, "placed"), "placed")
    trees = stored(placed.groupBy("tree").agg(F.min("leaf").alias("start"), F.count(F.lit(1)).alias("size")), "trees")
    trees_small = small(trees)
    leaves = placed.alias("l").join(trees_small.alias("t"), F.col("l.tree").eqNullSafe(F.col("t.tree")))
    leaves = leaves.select(F.col("l.tree").alias("tree"), (F.col("leaf") - F.col("start")).alias("place"), "size", F.col("leaf").alias("first"), name_of(F.col("leaf"), 0).alias("id"), "hash")
    largest, total, sources = trees.agg(F.max("size"), F.sum("size"), F.count(F.lit(1))).first()
    nodes, subroots = levels(leaves, 0, (largest or 0, total or 0, sources))
    subroots = stored(subroots, "subroots")
    ranked = ordered_sums(subroots, ["first"], {"place": F.lit(1).cast("long")}, "sources")
    ranked = stored(ranked.select(F.lit(0).alias("tree"), "place", F.lit(sources).cast("long").alias("size"), "first", "id", "hash"), "sources")
    upper, roots = levels(ranked, UPPER, (sources, sources, 1))
    found = [n for n in (nodes, upper) if n is not None]
    empty = rows.sparkSession.createDataFrame([], "id long, level int, parent long, lefts binary, rights binary")
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1]) if found else empty
    subroots = subroots.select("tree", F.col("first").alias("tree_first"), F.col("hash").alias("subroot"))
    root = roots.select(as_text(F.col("hash")).alias("hash")).first()
    return placed, stored(both, "nodes"), subroots.withColumn("root", F.lit(root["hash"] if root else None).cast("string"))


def prove(leaves: DataFrame, nodes: DataFrame, top_nodes: int = TOP_NODES) -> DataFrame:
    """(leaf, proof_sha256, folded_root) of every leaf.

    Levels with at most ``top_nodes`` nodes in all, from the root down, travel to every task; below them the climb meets
    its nodes by shuffles, handing on the siblings of a step as a row. What is met above an entry to the upper levels is the
    same for all leaves below it, so the upper climb starts from the entries, not from the leaves, and hands on the chain of
    siblings; each leaf folds that of its entry in one pass.
    """
    sizes = sorted((r["level"], r["count"]) for r in nodes.groupBy("level").count().collect())  # a row a level
    above, split = 0, (sizes[-1][0] + 1 if sizes else 0)
    for level, count in reversed(sizes):
        if above + count > top_nodes:
            break
        above, split = above + count, level
    start = leaves.select("leaf", name_of(F.col("leaf"), 0).alias("node"), F.col("after").alias("folded"))
    if sizes and sizes[0][0] < split:
        steps = climb(
            start.withColumn("siblings", F.lit(b"")), nodes.filter(F.col("level") < split), "low",
            {"leaf": "c.leaf", "folded": FOLD, "siblings": "concat(n.lefts, n.rights)"}, "leaf, step, node, folded, siblings FROM climb",
        )
        met = steps.groupBy("leaf").agg(F.collect_list(F.struct("step", "siblings")).alias("s"), F.max(F.struct("step", "node", "folded")).alias("l"))  # a row a level
        start = met.select("leaf", "l.node", "l.folded", joined_text(F.array_sort("s")["siblings"]).alias("low"))
    else:
        start = start.withColumn("low", F.lit(""))
    top = nodes.filter(F.col("level") >= split)
    # Leaves enter at the lowest of these levels or, from a tree that ends below it, at the lowest over the sources.
    entries = top.filter(F.col("level").isin(split, UPPER)).select(F.col("id").alias("entry"), F.col("id").alias("node"), F.array().cast(CHAIN).alias("chain"))
    wide = "/*+ BROADCAST(n) */"
    append = {"entry": "c.entry", "chain": "concat(c.chain, array(named_struct('lefts', n.lefts, 'rights', n.rights)))"}
    chains = climb(entries, top, "entry", append, f"{wide} entry, chain FROM climb LEFT ANTI JOIN entry_nodes n ON climb.node = n.id", wide)  # at the root
    met = start.join(small(chains), start["node"] == chains["entry"], "left")  # at the root already: no chain
    chain = F.coalesce("chain", F.array().cast(CHAIN))
    high = joined_text(F.transform(chain, lambda n: F.concat(n["lefts"], n["rights"])))
    return met.select("leaf", F.sha2(F.concat("low", high), 256).alias("proof_sha256"), as_text(folded(F.col("folded"), chain)).alias("folded_root"))


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes ``fields``, a null as a dash; nulls, empty and very long texts are values like others. Leaves ascend by
    key within a source (null keys last, then by hash; equal rows in any order, which changes no column), sources
    by their bytes, null first. Runs of three nodes are hashed until one is left; a single leaf is its source's
    subroot, a single subroot the root. ``tampered`` gives other values for columns: the leaf made of them is folded with the
    untampered siblings, and ``verified`` tells whether that meets the root. An empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    leaves, nodes, tops = build(docs, key, source, fields, tampered)
    proofs = prove(leaves, nodes)
    joined = leaves.alias("l").join(small(stored(tops, "tops")).alias("t"), F.col("l.tree").eqNullSafe(F.col("t.tree"))).select("leaf", "key", "hash", "subroot", "root")
    return joined.join(proofs, "leaf").select(
        F.col("key").alias(key), as_text(F.col("hash")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def without_line_feeds(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The texts with their line feeds deleted where 2 divides the checksum of the decimal key."""
    hit = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 2 == 0
    return {text: F.when(hit, F.replace(F.col(f"`{text}`"), F.lit("\n"), F.lit(""))).otherwise(F.col(f"`{text}`"))}
