"""Merkle manifest of a dataset: hash trees by group, their roots under one root, and a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import free_name
from barloom.session import cut_lineage

#: Nodes that are hashed together, and digits of a rank that are grouped away within a block of FAN ** DIGITS nodes.
FAN, DIGITS = 3, 5
BLOCK = FAN**DIGITS


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value of a leaf: `-` for null, else its bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*(field(v) for v in values)))


# Ranks


def ranked(rows: DataFrame, tree: str, order: list[str], pos: str, n: str) -> DataFrame:
    """rows, written, with `pos`, the place in its tree from 0 in the order, and `n`, the rows of its tree.

    The rows are dealt by ranges of tree and order, so no task holds a tree as a whole; rows that tie are told apart by
    their place in the scan. A range's totals by tree are few rows, and running sums of these tell where it begins.
    """
    part, tie, here, before = free_name(rows, "range_no", "tie_no", "rows_here", "rows_before")
    keys = [tree, *order, tie]
    dealt = cut_lineage(rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part, tree).agg(F.count(F.lit(1)).alias(here))
    earlier = Window.partitionBy(tree).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn(before, F.coalesce(F.sum(here).over(earlier), F.lit(0))).withColumn(n, F.sum(here).over(Window.partitionBy(tree)))
    inside = Window.partitionBy(part, tree).orderBy(*order, tie)
    placed = dealt.join(starts.drop(here), [part, tree]).withColumn(pos, F.col(before) + F.row_number().over(inside) - 1)
    return placed.select(*rows.columns, F.col(pos).cast("bigint").alias(pos), F.col(n).cast("bigint").alias(n))


# Blocks of nested nodes


def width(n: Column, level: int) -> Column:
    """Nodes of a tree of n leaves at a level, the leaves' being 0."""
    return F.ceil(n / FAN**level)


def rolled(nodes: DataFrame) -> DataFrame:
    """tree, n, block, node and kids of every block of nodes (tree, n, pos, node, held).

    Digits of the rank are grouped away one after another, the last first: each time up to FAN structs (at, node, held or
    the kids below) become the kids of one struct. All groupings hold tree and block, so the rows move once. A level that
    has one node in the whole tree hands it on as it is, any other hashes its runs, even a run of one.
    """
    digits = [F.expr(f"cast(pos div {FAN**k} % {FAN} as int)").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("tree", "n", F.expr(f"pos div {BLOCK}").alias("block"), *digits, "node", F.col("held").alias("below"))
    for k in range(DIGITS):
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("at"), "node", "below"))).alias("below")
        rows = rows.groupBy("tree", "n", "block", *(f"d{j}" for j in range(k + 1, DIGITS))).agg(kids)
        joined = digest(F.array_join(F.col("below.node"), ""))
        rows = rows.withColumn("node", F.when(width(F.col("n"), k) > 1, joined).otherwise(F.col("below")[0]["node"]))
    return rows.withColumnRenamed("below", "kids")


def siblings(kids: Column, own: Column) -> Column:
    """The other nodes of a run, joined: those left and right of the own place."""

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(kids, keep), lambda x: x["node"]), "")

    return F.struct(side(lambda x: x["at"] < own["at"]).alias("left"), side(lambda x: x["at"] > own["at"]).alias("right"))


def unrolled(kids: Column, n: Column, level: int) -> Column:
    """Array of a block's nodes, each with its place in the block, what it holds, and its steps up to the block's node."""

    def one(kid: Column) -> Column:
        step = F.when(width(n, level) > 1, F.array(siblings(kids, kid))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
        if level == 0:
            return F.array(F.struct(kid["at"].cast("bigint").alias("place"), kid["node"].alias("node"), kid["below"].alias("held"), step.alias("path")))
        place = lambda x: (kid["at"] * FAN**level + x["place"]).alias("place")
        return F.transform(
            unrolled(kid["below"], n, level - 1),
            lambda x: F.struct(place(x), x["node"].alias("node"), x["held"].alias("held"), F.concat(x["path"], step).alias("path")),
        )

    return F.flatten(F.transform(kids, one))


def proved(nodes: DataFrame, most: int, above=None) -> DataFrame:
    """tree, pos, node, held, path (steps of left and right siblings up to the top), subroot and root of every node.

    A block holds at most BLOCK nodes. Where a tree (of at most `most` nodes) has more, its blocks' nodes are the leaves of
    the next round, and each block gets its one row of the path above by tree and block. Inside a block, proofs are made
    from the nested structs by one transform and one explode. `above` adds the path over the subroots and the root.
    """
    blocks = cut_lineage(rolled(nodes))
    if most > BLOCK:
        tops = blocks.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), "node", F.lit(None).cast("int").alias("held"))
        upper = proved(tops, -(-most // BLOCK), above).select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"), "subroot", "root")
        whole = blocks.join(upper, ["tree", "block"])
    elif above:
        whole = blocks.join(above(blocks.select("tree", "node")), "tree").withColumn("subroot", F.col("node"))
    else:
        empty = F.array().cast("array<struct<left:string,right:string>>")
        whole = blocks.withColumns({"upper": empty, "subroot": F.col("node"), "root": F.col("node")})
    flat = whole.select("tree", "block", "upper", "subroot", "root", F.explode(unrolled(F.col("kids"), F.col("n"), DIGITS - 1)).alias("x"))
    return flat.select(
        "tree", (F.col("block") * BLOCK + F.col("x.place")).alias("pos"), F.col("x.node").alias("node"), F.col("x.held").alias("held"),
        F.concat("x.path", "upper").alias("path"), "subroot", "root",
    )


def over_subroots(subroots: DataFrame) -> DataFrame:
    """tree, upper (path from its subroot) and root of every tree (tree, node), in the trees' order."""
    rows = cut_lineage(subroots.select(F.lit(b"").alias("whole"), "tree", "node"))
    placed = ranked(rows, "whole", ["tree"], "pos", "n")
    nodes = placed.select(F.col("whole").alias("tree"), "n", "pos", "node", F.struct("tree").alias("held"))
    return proved(nodes, rows.count()).select(F.col("held.tree").alias("tree"), F.col("path").alias("upper"), "root")


def manifest(rows: DataFrame, leaf: str, group: str, order: list[str]) -> DataFrame:
    """rows with their proof: `path`, `subroot` and `root` (with underscores where a column has the name already).

    leaf: a column of digests. A tree's leaves are the rows of one group in the order (null first), then by digest, so ties
    and repeated rows are defined; the subroots follow the groups' values (null first, then by bytes). Every FAN
    consecutive nodes become their hash until one is left. An empty table gives no rows.
    """
    path, sub, root = free_name(rows, "path", "subroot", "root")
    tree = F.when(F.col(group).isNull(), F.lit(b"")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")).cast("binary"))
    packed = rows.select(tree.alias("tree"), F.col(leaf).alias("node"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("held"))
    keys = {f"key{i}": F.col("held")[c] for i, c in enumerate(order)}
    placed = cut_lineage(ranked(cut_lineage(packed.withColumns(keys)), "tree", [*keys, "node"], "pos", "n"))
    most = placed.agg(F.max("n")).first()[0] or 0  # one number
    out = proved(placed.select("tree", "n", "pos", "node", "held"), most, over_subroots)
    return out.select("held.*", F.col("path").alias(path), F.col("subroot").alias(sub), F.col("root").alias(root))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def verify_documents(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and the check of it for every document, some with a tampered text.

    A tree for each source, its leaves by doc_id (null first; then by digest). A document is tampered with if 2 divides the
    unsigned crc32 of its decimal doc_id (never for a null id): its text loses all \\n, which changes nothing where there are
    none. Null fields are leaf values like any other; a null text stays null. Repeated rows are leaves each. An empty table
    gives no rows. Only the five columns of a leaf are read.
    """
    kinds = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
    rows = docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()))
    values = [F.col(c) for c in kinds]
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    leaves = rows.select("doc_id", "source", leaf_of(*values).alias("leaf"), F.when(changed, leaf_of(*values[:-1], F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))
    out = manifest(leaves, "leaf", "source", ["doc_id"])
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), back.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
