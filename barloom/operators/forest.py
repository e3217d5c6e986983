"""Trees of every series at once, grown level by level from histograms.

A model belongs to a series and a fold and learns from the rows of earlier folds. The models of all series and folds, and all
their trees, share one pass a level: a histogram over (series, fold, tree, node, feature, bin), which Spark adds up before it
shuffles, gives each node its best split. No row is copied for a tree: a row carries the number of its node in every tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import KEYS
from barloom.session import cut_lineage

#: A modulus under 2**31 and the factors of the draws; squares stay under 2**63.
PRIME, FACTORS = 2147483647, (48271, 69621)

#: Nodes of a tree are numbered from the root 1; a tree's numbers stay under this.
STRIDE = 1 << 16

#: Chances that a row is drawn at most 0, 1, 2, 3, 4 times by a bootstrap of as many rows.
BOOTSTRAP = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)

Terms = Callable[[Column], tuple[Column, Column, Column]]


def draw(x: Column) -> Column:
    """A number from 0 up to 1 that depends on x alone, so retried tasks draw alike."""
    for factor in FACTORS:
        v = (x.cast("bigint") % PRIME) * factor % PRIME
        x = v * v % PRIME + 7
    return x.cast("double") / float(PRIME + 7)


@dataclass(frozen=True)
class Growth:
    """How trees grow. mtry: share of the features that a node looks at; random_cut: one drawn bin a feature instead of all."""

    depth: int = 8
    bins: int = 32
    trees: int = 300
    min_leaf: int = 5
    mtry: float = 1.0
    bootstrap: bool = False
    random_cut: bool = False
    seed: int = 42


FOREST = Growth(bootstrap=True, mtry=0.115)
EXTRA = Growth(random_cut=True, mtry=0.115, seed=43)
TREE = Growth(depth=5, trees=1)


def fold_models(rows: DataFrame, names: Sequence[str], bins: int, folds: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row for each model that learns from it (its fold is earlier) or is tested on it (its fold).

    Columns: keys, k (the model's fold), rn, bar_start, label, train and binned: each feature's bin between its least and greatest
    value in the model's training rows; values beyond go to the outer bins, null counts as 0. Needs fold and label.
    """
    values = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    base = rows.select(*keys, "bar_start", "rn", "fold", "label", values.alias("x"))
    ends = base.groupBy(*keys, "fold").agg(*[F.array(*[f(F.col("x")[i]) for i in range(len(names))]).alias(n) for n, f in (("low", F.min), ("high", F.max))])
    # A series has folds + 1 rows here.
    models = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(folds)))).filter("fold < k")
    reach = models.groupBy(*keys, "k").agg(
        *[F.array(*[f(F.col(n)[i]) for i in range(len(names))]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    )
    wide = base.withColumn("k", F.explode(F.sequence(F.greatest(F.col("fold"), F.lit(1)), F.lit(folds)))).join(reach, [*keys, "k"])
    spans = F.zip_with("low", "high", lambda a, b: F.struct(a.alias("a"), (b - a).alias("w")))
    binned = F.zip_with(
        "x", spans, lambda x, s: F.when(s["w"] > 0, F.least(F.greatest(F.floor((x - s["a"]) / s["w"] * bins), F.lit(0)), F.lit(bins - 1))).otherwise(0).cast("int")
    )
    return wide.select(*keys, "k", "bar_start", "rn", "label", (F.col("fold") < F.col("k")).alias("train"), binned.alias("binned"))


def _impurity(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, (a * a + b * b) / (a + b)).otherwise(0.0)


def grow(rows: DataFrame, terms: Terms, growth: Growth, n_features: int, score=_impurity, keys: Sequence[str] = KEYS, salt: int = 0) -> DataFrame:
    """rows (of `fold_models`, with what terms reads) with `nodes`, the leaf of every tree.

    terms: of a tree's number, the times a training row counts (0: not drawn) and its two sums a and b; a split is the better
    the greater score(a, b) of its two sides is together; ties go to the first feature, then the lowest bin. A side needs
    `min_leaf` rows, and the split must gain. Scores are rounded, so the order of additions decides nothing.
    """
    g = [*keys, "k"]
    first = rows.withColumn("nodes", F.transform(F.sequence(F.lit(1), F.lit(growth.trees)), lambda _: F.lit(1)))
    number = (F.col("tree") + salt) * STRIDE * 128 + F.col("node") * 128 + growth.seed * 977
    for level in range(growth.depth):
        seen = first.filter("train").select(*g, *[c for c in first.columns if c not in (*g, "nodes", "train")], F.posexplode("nodes").alias("tree", "node"))
        times, a, b = terms(F.col("tree"))
        open_ = seen.filter(F.col("node") >= 1 << level).select(*g, "tree", "node", "binned", times.alias("_n"), a.alias("_a"), b.alias("_b")).filter("_n > 0")
        looked = F.filter(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda f: draw(number + f) < growth.mtry) if growth.mtry < 1 else F.sequence(F.lit(0), F.lit(n_features - 1))
        long = open_.withColumn("f", F.explode(looked)).withColumn("bin", F.element_at("binned", F.col("f") + 1))
        counted = long.groupBy(*g, "tree", "node", "f", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("a"), F.sum("_b").alias("b"))
        side = Window.partitionBy(*g, "tree", "node", "f")  # a row for each bin
        left, whole = side.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), side.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        both = {f"{c}_{s}": F.sum(c).over(w) for c in "nab" for s, w in (("left", left), ("all", whole))}
        ends = {"low": F.min("bin").over(whole), "high": F.max("bin").over(whole)}
        cuts = counted.withColumns(both | ends)
        if growth.random_cut:
            drawn = F.col("low") + F.floor(draw(number + F.col("f") + 64 * STRIDE * STRIDE) * (F.col("high") - F.col("low")))
            # The drawn bin may be empty: the cut is the last bin at or below it.
            following = F.lead("bin").over(side.orderBy("bin"))
            cuts = cuts.withColumn("_next", following).filter((F.col("bin") <= drawn) & (F.col("_next") > drawn))
        right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in "nab"}
        gain = score(F.col("a_left"), F.col("b_left")) + score(right["a"], right["b"]) - score(F.col("a_all"), F.col("b_all"))
        fit = (F.col("n_left") >= growth.min_leaf) & (right["n"] >= growth.min_leaf)
        best = F.max_by(F.struct("f", "bin"), F.struct("gain", -F.col("f"), -F.col("bin")))
        splits = cuts.filter(fit).withColumn("gain", F.round(gain, 9)).filter("gain > 1e-7").groupBy(*g, "tree", "node").agg(best.alias("split"))
        listed = splits.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct((F.col("tree") * STRIDE + F.col("node")).alias("at"), "split"))).alias("splits"))

        def move(node: Column, tree: Column) -> Column:
            split = F.try_element_at("splits", tree * STRIDE + node)
            below = (F.element_at("binned", split["f"] + 1) > split["bin"]).cast("int")
            return F.when(split.isNull(), node).otherwise(node * 2 + below)

        # One row a model, with at most trees x 2 ** level entries.
        first = cut_lineage(first.join(listed, g, "left").withColumn("nodes", F.when(F.col("splits").isNull(), F.col("nodes")).otherwise(F.transform("nodes", move))).drop("splits"))
    return first


def leaf_values(grown: DataFrame, terms: Terms, value, keys: Sequence[str] = KEYS) -> DataFrame:
    """grown with `values`: value(a, b) of the row's leaf in every tree."""
    g = [*keys, "k"]
    seen = grown.filter("train").select(*g, *[c for c in grown.columns if c not in (*g, "nodes", "train")], F.posexplode("nodes").alias("tree", "node"))
    times, a, b = terms(F.col("tree"))
    sums = seen.select(*g, "tree", "node", times.alias("_n"), a.alias("_a"), b.alias("_b")).filter("_n > 0").groupBy(*g, "tree", "node").agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    entry = F.struct((F.col("tree") * STRIDE + F.col("node")).alias("at"), value(F.col("a"), F.col("b")).alias("v"))
    leaves = sums.groupBy(*g).agg(F.map_from_entries(F.collect_list(entry)).alias("leaves"))
    found = F.transform("nodes", lambda node, tree: F.try_element_at("leaves", tree * STRIDE + node))
    return grown.join(leaves, g).withColumn("values", found).drop("leaves")


def drawn_terms(growth: Growth) -> Terms:
    """Terms of a classifier: rows drawn by bootstrap or all once, classes weighted to balance; needs class_weight."""

    def terms(tree: Column) -> tuple[Column, Column, Column]:
        u = draw((tree + 1) * 1000003 + F.col("rn") + growth.seed)
        times = F.lit(len(BOOTSTRAP))
        for n in reversed(range(len(BOOTSTRAP))):
            times = F.when(u < BOOTSTRAP[n], n).otherwise(times)
        times = times if growth.bootstrap else F.lit(1)
        weight = times * F.col("class_weight")
        return times, F.when(F.col("label") == 1, weight).otherwise(0.0), F.when(F.col("label") == 0, weight).otherwise(0.0)

    return terms


def _mean(values: Column) -> Column:
    known = F.array_compact(values)
    return F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known), 9)).otherwise(0.5)


def forest_probability(models: DataFrame, growth: Growth, n_features: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, k, bar_start, rn, label and prob of every test row: the mean over trees of the share of label 1 in its leaf.

    A model whose training rows have one class only gives its share, 0 or 1, as all its trees are leaves. A tree that drew no row
    has no say; without any, prob is 0.5.
    """
    g = [*keys, "k"]
    counts = models.filter("train").groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1"))
    own = F.when(F.col("label") == 1, F.col("n1")).otherwise(F.col("n") - F.col("n1"))
    weighted = cut_lineage(models.join(counts, g).withColumn("class_weight", F.when(own > 0, F.col("n") / (2 * own)).otherwise(1.0)).drop("n", "n1"))
    terms = drawn_terms(growth)
    grown = grow(weighted, terms, growth, n_features, keys=keys)
    done = leaf_values(grown, terms, lambda a, b: a / (a + b), keys)
    return done.filter("NOT train").select(*g, "bar_start", "rn", "label", _mean(F.col("values")).alias("prob"))


@dataclass(frozen=True)
class Boost:
    """Boosting: rounds follow each other, so a round costs depth + 1 passes over the rows."""

    rounds: int = 400
    depth: int = 5
    bins: int = 32
    rate: float = 0.03
    penalty: float = 1.0
    min_leaf: int = 5
    share: float = 0.8
    seed: int = 44


def boosted_probability(models: DataFrame, boost: Boost, n_features: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, k, bar_start, rn, label and prob of every test row, by gradient boosting on the logistic loss.

    Each round draws a share of the rows, grows one tree of every model on the gradients, and adds its leaves' Newton steps. The
    margin starts at the log odds of the training rows, bounded where one class is missing.
    """
    g = [*keys, "k"]
    counts = models.filter("train").groupBy(*g).agg(((F.count_if(F.col("label") == 1) + 0.5) / (F.count_if(F.col("label") == 0) + 0.5)).alias("odds"))
    rows = cut_lineage(models.join(counts, g).withColumn("margin", F.log("odds")).drop("odds"))

    def score(a: Column, b: Column) -> Column:
        return a * a / (b + boost.penalty)

    for r in range(boost.rounds):
        growth = Growth(boost.depth, boost.bins, 1, boost.min_leaf, 1.0, seed=boost.seed)

        def terms(tree: Column, r=r) -> tuple[Column, Column, Column]:
            p = 1 / (1 + F.exp(-F.col("margin")))
            drawn = draw(F.col("rn") + 1000003 * (r + 1) + boost.seed) < boost.share
            return drawn.cast("int"), F.col("label") - p, p * (1 - p)

        grown = grow(rows, terms, growth, n_features, score, keys, r)
        done = leaf_values(grown, terms, lambda a, b: a / (b + boost.penalty), keys)
        # A node that no drawn row reaches cannot be: every split leaves drawn rows on both sides.
        rows = cut_lineage(done.withColumn("margin", F.round(F.col("margin") + boost.rate * F.coalesce(F.col("values")[0], F.lit(0.0)), 12)).drop("nodes", "values"))
    return rows.filter("NOT train").select(*g, "bar_start", "rn", "label", F.round(1 / (1 + F.exp(-F.col("margin"))), 9).alias("prob"))


def accuracy(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tested rows and the share predicted right, per series and fold."""
    right = (F.col("prob") > 0.5) == (F.col("label") == 1)
    return scored.groupBy(*keys, F.col("k").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))
