"""Mixing overlapping sources to token targets: minimum-cost flow, then a seeded choice of documents."""

from __future__ import annotations

import heapq
from collections.abc import Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import WORD, free_name

#: Weights of the sources in order, repeating; share of all words that the mix takes; most words taken of a source and a
#: document, as a multiple of its own.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2

#: Bound of what the driver holds: one node for each pattern of sources that documents have.
MAX_PATTERNS = 50_000

#: Rows of a pattern in a bucket of the choice, about, and most buckets of a pattern.
BUCKET_ROWS, MAX_BUCKETS = 4_096, 65_536


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> dict[str | None, float]:
    """Words wanted of each source: by weight in code-point order (null last), at most `epochs` times its size.

    What a source cannot give is shared among the others by weight, until none is above its bound.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > epochs * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def min_cost_flow(patterns: dict[Hashable, int], members: dict[Hashable, tuple], quotas: dict[Hashable, int], epochs: int = EPOCHS) -> dict[tuple, int]:
    """Tokens routed from each pattern to each source: as much as the quotas take, at least cost.

    A pattern gives its tokens once for nothing; the k-th repetition of a token costs k * k, so repetition is spread before
    it is deepened. Successive shortest paths with potentials, over arcs start - pattern (one for each epoch) - source -
    end; each path fills an arc, so there are about as many paths as arcs.
    """
    start, end = ("start",), ("end",)
    graph: dict[Hashable, list[list]] = {start: [], end: []}

    def arc(u: Hashable, v: Hashable, room: int, cost: int) -> None:
        a, b = graph.setdefault(u, []), graph.setdefault(v, [])
        a.append([v, room, cost, len(b)])
        b.append([u, 0, -cost, len(a) - 1])

    for p, tokens in patterns.items():
        for k in range(epochs):
            arc(start, ("p", p), tokens, k * k)
        for s in members[p]:
            arc(("p", p), ("s", s), tokens * epochs, 0)
    for s, q in quotas.items():
        arc(("s", s), end, q, 0)
    potential = dict.fromkeys(graph, 0)
    while True:
        dist, back, heap, tick = {start: 0}, {}, [(0, 0, start)], 0
        done = set()
        while heap:
            d, _, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for i, (v, room, cost, _) in enumerate(graph[u]):
                if room > 0 and v not in done:
                    new = d + cost + potential[u] - potential[v]
                    if new < dist.get(v, float("inf")):
                        dist[v], back[v], tick = new, (u, i), tick + 1
                        heapq.heappush(heap, (new, tick, v))
        if end not in dist:
            break
        far = dist[end]
        for v in graph:
            potential[v] += min(dist.get(v, far), far)
        path, v = [], end
        while v != start:
            u, i = back[v]
            path.append(graph[u][i])
            v = u
        flow = min(a[1] for a in path)
        for a in path:
            a[1] -= flow
            graph[a[0]][a[3]][1] += flow
    return {(p, a[0][1]): tokens * epochs - a[1] for p, tokens in patterns.items() for a in graph[("p", p)] if a[0][0] == "s" and tokens * epochs > a[1]}


def select(rows: DataFrame, pattern: str, size: str, key: list[str], wanted: DataFrame, seed: int = 7) -> DataFrame:
    """The rows with `epochs_taken`: how often each is taken so that a pattern gives the words wanted of it.

    wanted: pattern (null allowed), full (times every row is taken) and rest (words of one more pass). One more pass takes
    rows in the order of a seeded hash of `key`, whole ones, until the rest is reached. The order is cut in buckets of the
    hash: running sums of bucket totals tell the bucket where the rest ends, and only that bucket's rows are put in order.
    Of its rows beyond the end, the one whose size is nearest to the gap is taken too, if that makes the gap smaller.
    """
    counts = rows.groupBy(pattern).agg(F.count(F.lit(1)).alias("__n"))
    plan = counts.join(wanted, counts[pattern].eqNullSafe(wanted["__p"])).select(
        "__p", "full", "rest", F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("__n") / BUCKET_ROWS)).cast("bigint").alias("__buckets")
    )
    # As many rows as patterns, which the caller has bounded.
    dealt = rows.join(F.broadcast(plan), rows[pattern].eqNullSafe(plan["__p"])).withColumn("__order", F.xxhash64(F.lit(seed), *key))
    dealt = dealt.withColumn("__bucket", F.pmod(F.shiftrightunsigned("__order", 20), F.col("__buckets")))
    totals = dealt.groupBy("__p", "__bucket", "rest").agg(F.sum(size).alias("__words"))
    run = Window.partitionBy("__p").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = totals.withColumn("__upto", F.sum("__words").over(run)).withColumn("__from", F.col("__upto") - F.col("__words"))
    cut = ends.filter((F.col("__from") <= F.col("rest")) & (F.col("rest") < F.col("__upto"))).select(F.col("__p").alias("__q"), F.col("__bucket").alias("__cut"), "__from")
    at = dealt.join(F.broadcast(cut), dealt["__p"].eqNullSafe(cut["__q"]), "left")

    # No cut: the rest is all that there is (or nothing is there).
    whole = F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut"))
    easy = at.filter(F.col("__cut").isNull() | (F.col("__bucket") != F.col("__cut")))
    easy = easy.withColumn("epochs_taken", F.col("full") + F.when(whole & (F.col("rest") > 0), 1).otherwise(0))
    inside = Window.partitionBy("__p").orderBy("__order", *key)
    hard = at.filter(F.col("__bucket") == F.col("__cut")).withColumn("__sum", F.col("__from") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    hard = hard.withColumn("__in", F.col("__sum") <= F.col("rest"))
    taken = F.max(F.when(F.col("__in"), F.col("__sum"))).over(Window.partitionBy("__p"))
    hard = hard.withColumn("__gap", F.col("rest") - F.coalesce(taken, F.col("__from")))
    worth = ~F.col("__in") & (F.abs(F.col("__gap") - F.col(size)) < F.col("__gap"))
    nearest = Window.partitionBy("__p").orderBy(F.when(worth, F.abs(F.col("__gap") - F.col(size))).asc_nulls_last(), "__order", *key)
    hard = hard.withColumn("__best", worth & (F.row_number().over(nearest) == 1))
    hard = hard.withColumn("epochs_taken", F.col("full") + F.when(F.col("__in") | F.col("__best"), 1).otherwise(0))
    keep = [*rows.columns, "epochs_taken"]
    return easy.select(*keep).unionByName(hard.select(*keep))


def mix(rows: DataFrame, sources: str, size: str, key: list[str], quotas: dict | None = None, seed: int = 7, **rule) -> tuple[DataFrame, dict]:
    """The rows with `epochs_taken`, and the words wanted of each source.

    sources: the array of sources that a row belongs to; words of rows with several go to whichever source needs them.
    Rows are summed by their pattern of sources, the flow from patterns to quotas is solved on these sums (an error
    beyond MAX_PATTERNS patterns), and each pattern then gives its words by the seeded choice. quotas: by default those
    of `targets`, from the words of all rows in a source. A row without sources is never taken.
    """
    pattern, flow_of = F.array_sort(F.array_distinct(sources)), {}
    rows = rows.withColumn("__pattern", F.to_json(F.struct(pattern.alias("s"))))
    sums = rows.groupBy("__pattern").agg(F.first(pattern).alias("s"), F.sum(size).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    tokens = {r["__pattern"]: r["n"] or 0 for r in sums}
    members = {r["__pattern"]: tuple(r["s"] or ()) for r in sums}
    sizes: dict = {}
    for p, n in tokens.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes, **rule) if quotas is None else quotas
    routed = min_cost_flow(tokens, members, {s: round(t) for s, t in wanted.items()}, rule.get("epochs", EPOCHS))
    for (p, _), flow in routed.items():
        flow_of[p] = flow_of.get(p, 0) + flow
    plan = [(p, flow_of.get(p, 0) // n if n else 0, flow_of.get(p, 0) % n if n else 0) for p, n in sorted(tokens.items())]
    table = rows.sparkSession.createDataFrame(plan, "__p string, full bigint, rest bigint")
    return select(rows, "__pattern", size, key, table, seed).drop("__pattern"), {"sizes": sizes, "targets": wanted}


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    A document belongs to its own source; a null source is a source, the last. Only whole documents are taken, once or
    twice, so a source is off its target by at most half of its largest document. A null or wordless text has size 0 and gives nothing. Repeated rows are taken each for itself; ties of the seeded
    hash are settled by doc_id and text. An empty table gives no rows. Reads doc_id, text and source.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
    )
    mixed, sums = mix(rows.withColumn("sources", F.array("source")), "sources", "size", ["doc_id", "text_hash"], seed=seed)
    # One row for each source; the flow has bounded them.
    known = rows.sparkSession.createDataFrame(
        [(s, sums["sizes"][s], float(sums["targets"][s])) for s in sums["sizes"]], "s string, source_size bigint, target double"
    )
    out = mixed.join(F.broadcast(known), mixed["source"].eqNullSafe(known["s"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs_taken") * F.col("size")).cast("bigint").alias("taken"))


def sample(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, with the columns of docs.

    A document without words is in the mix if its source is taken whole. Sources and sizes as in `mix_documents`.
    """
    size, sources, key = free_name(docs, "mix_size", "mix_sources", "mix_key")
    rows = docs.withColumns({size: word_count(F.col("text")), sources: F.array(F.col("source").cast("string")), key: F.xxhash64("text")})
    mixed, _ = mix(rows, sources, size, ["doc_id", key], seed=seed)
    copies = F.explode(F.sequence(F.lit(1), F.col("epochs_taken").cast("int"))).alias("copy")
    return mixed.filter("epochs_taken > 0").select(*(F.col(f"`{c}`") for c in docs.columns), copies).select(*(F.col(f"`{c}`") for c in docs.columns))
