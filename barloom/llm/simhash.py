"""SimHash groups: fingerprints, links by the generalised pigeonhole principle, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import free_name, pieces, raw_texts
from barloom.session import cut_lineage

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42

#: A bucket of more fingerprints is not paired; its fingerprints meet at common neighbours instead.
HEAVY = 64


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of a text: bit is set if it is set in over half of the hashes of its word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = starts[: max(1, len(words) - SHINGLE + 1)].tolist()
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 50_000):
        part = hashes[at : at + 50_000].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp of every document, from whole texts; a text without words has fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text")).alias("text_hash"), F.col("text").cast("string").alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            fp = pa.array([fingerprint(x) for x in raw_texts(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(make, "doc_id bigint, text_hash bigint, fp bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Partitions of the bits


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set: 64 x 64 sums over all of them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = bits_of(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, both.ravel().astype(np.int64), np.full(BITS * BITS, n))], ["i", "j", "both", "n"])

    total = fps.mapInArrow(sums, "i bigint, j bigint, both bigint, n bigint").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n"))
    rows, both = total.collect(), np.zeros((BITS, BITS))  # 4096 rows whatever the input
    for r in rows:
        both[r["i"], r["j"]] = r["both"]
    return (rows[0]["n"] if rows else 0), both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of near equal size, correlated bits together, by greedy growth from the strongest bit."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def values_in(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The group's bits of each fingerprint as one number."""
    return bits_of(fps)[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def variants(width: int, radius: int) -> np.ndarray:
    """Masks of at most `radius` of `width` bits; none for a radius under 0."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]
    return np.array(masks, np.int64)


def allocate(counts: np.ndarray, widths: list[int], n: int, radius: int = RADIUS) -> np.ndarray:
    """Thresholds of each fingerprint's partitions, by dynamic programming on estimated costs.

    If two fingerprints differ in at most `radius` bits, some partition differs in no more bits than its threshold, for any
    thresholds of -1 or more (-1: not probed) that add up to radius - m + 1. The cost of a threshold is the buckets it
    probes plus the fingerprints expected there: the bucket's own count, and the average bucket for each neighbour.
    counts: a row for each fingerprint, the size of its bucket in each partition.
    """
    rows, m = counts.shape
    steps = range(-1, radius + 1)
    total = radius - m + 1
    low, high = -m, radius * m
    best = np.full((rows, high - low + 1), np.inf)
    best[:, -low] = 0
    picks = []
    for i in range(m):
        own = np.minimum(counts[:, i], HEAVY + 1)
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for t in steps:
            probes = len(variants(widths[i], t))
            cost = 0 if t < 0 else own + probes + (probes - 1) * n / 2 ** widths[i]
            moved = np.full_like(best, np.inf)
            a, b = max(0, t), best.shape[1] + min(0, t)
            moved[:, a:b] = best[:, a - t : b - t] + (cost if t < 0 else cost[:, None])
            better = moved < new
            new[better], pick[better] = moved[better], t
        best = new
        picks.append(pick)
    out, at = np.zeros((rows, m), np.int8), np.full(rows, total - low)
    for i in reversed(range(m)):
        out[:, i] = picks[i][np.arange(rows), at]
        at = at - out[:, i]
    return out


def partitions_for(n: int) -> int:
    """3 partitions probe 3 buckets of a fingerprint, 2 probe 34 far smaller ones: the cheaper for n fingerprints."""
    cost = {3: 3 + 3 * n / 2**21, 2: 34 + 34 * n / 2**32}
    return min(cost, key=cost.get)


# Links


def links(fps: DataFrame, m: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) between different fingerprints that join all those within RADIUS bits of each other.

    fps: distinct fingerprints, written. Every fingerprint is in the index once for each partition and probes the index as
    its own thresholds tell; a pair found is checked on all bits, from the larger side only. No pairs are made in a bucket
    of more than `heavy` fingerprints. Its members, and all that probe it, are spread to the values one bit away instead:
    two fingerprints are within 2 bits exactly if they share such a value, a value has at most 65 fingerprints, and each is
    linked to the least of them. So that part is exact too, and linear.
    """
    n, both = bit_moments(fps)
    m = m or partitions_for(n)
    groups = correlated_groups(n, both, m)
    widths = [len(g) for g in groups]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            i = np.repeat(np.arange(m, dtype=np.int32), len(fp))
            v = np.concatenate([values_in(fp, g) for g in groups])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(fp, m)), pa.array(i), pa.array(v)], ["fp", "i", "v"])

    parts = fps.mapInArrow(split, "fp bigint, i int, v bigint")
    sizes = parts.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    index = cut_lineage(parts.join(sizes, ["i", "v"]))
    sized = index.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("i", "v", "n"))).alias("s"))
    columns = [F.col("s")[i][c].alias(f"{c}{i}") for i in range(m) for c in ("v", "n")]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                cols = {c: batch.column(c).to_numpy(zero_copy_only=False)[k : k + 20_000] for c in batch.schema.names}
                thresholds = allocate(np.stack([cols[f"n{i}"] for i in range(m)], axis=1), widths, n)
                for i in range(m):
                    for t in range(RADIUS + 1):
                        mine = thresholds[:, i] == t
                        masks = variants(widths[i], t)
                        if mine.any():
                            v = (cols[f"v{i}"][mine][:, None] ^ masks).ravel()
                            fp = np.repeat(cols["fp"][mine], len(masks))
                            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.full(len(v), i, np.int32)), pa.array(v)], ["q", "i", "v"])

    probes = cut_lineage(sized.select("fp", *columns).mapInArrow(probe, "q bigint, i int, v bigint"))
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= RADIUS
    light = index.filter(F.col("n") <= heavy).join(probes, ["i", "v"]).filter((F.col("q") > F.col("fp")) & near).select(F.col("fp").alias("a"), F.col("q").alias("b"))

    crowded = index.filter(F.col("n") > heavy)
    buckets = crowded.select("i", "v").distinct()
    crowd = crowded.select("fp").union(probes.join(buckets, ["i", "v"], "left_semi").select(F.col("q").alias("fp"))).distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(BITS)))
    spread = crowd.select("fp", F.explode(flips).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    met = spread.groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    meet = met.select("a", F.explode("all").alias("b")).filter(F.col("a") != F.col("b"))
    return light.union(meet).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (least node reachable) of every node of the undirected edges (a, b), by alternating stars.

    Each round links the larger neighbours of a node to the least, then the smaller ones; both shorten all chains, so
    rounds grow with the logarithm of the longest. A node with very many edges is a sum and a join, never a list. The
    edges are written after every round. They only change while a chain is longer than one edge.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.u", "s.v")
        e = cut_lineage(small.filter("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(e.select("v", "v").distinct())
        state = now


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and fp of every document; and fp, `first` (least doc_id and text hash, null first) and component_id
    (least doc_id) of every fingerprint's component.

    The least is taken per fingerprint, then per component, and written: what the documents then join is a row for each
    fingerprint, so Spark can split a fingerprint that very many documents have.
    """
    rows = cut_lineage(fingerprints(docs))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"))).select(F.col("node").alias("fp"), "root")
    member = fps.join(roots, "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    whole = member.groupBy("group").agg(F.min("first").alias("first"), F.min("least").alias("component_id"))
    named = cut_lineage(member.select("fp", "group").join(whole, "group").drop("group"))
    return rows, named


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    A null or wordless text has fingerprint zero and is linked like any other; repeated rows are returned each; ties need
    no rule, as the least doc_id names the component (null only if all its ids are null). An empty table gives no rows.
    Only doc_id and text are read.
    """
    rows, named = grouped(docs)
    return rows.join(named, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: the least doc_id (null first), then the least text hash; with docs' columns."""
    doc, hash_, number = free_name(docs, "kept_id", "kept_hash", "kept_number")
    _, named = grouped(docs)
    chosen = named.select(F.col("first.doc_id").alias(doc), F.col("first.text_hash").alias(hash_)).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(chosen[doc]) & (F.xxhash64(docs["text"]) == chosen[hash_])
    met = docs.join(chosen, same)
    # Repeated rows of the same id and text are all met; the rows lie together already.
    ties = Window.partitionBy(doc, hash_).orderBy(F.lit(0))
    return met.withColumn(number, F.row_number().over(ties)).filter(F.col(number) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
