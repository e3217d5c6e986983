"""Logistic regressions of every series at once: sums per (series, model) are all that a step of fitting shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.joins import asof_join
from barloom.operators.series import KEYS, grouped_positions, time_block
from barloom.session import cut_lineage


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _array(n: int, value) -> Column:
    return F.array(*[value(i) for i in range(n)])


def scales(train: DataFrame, g: Sequence[str], n: int) -> DataFrame:
    """g with mean and sd (1 where a feature does not vary) of the n values of x."""
    x = F.col("x")
    sums = train.groupBy(*g).agg(F.count(F.lit(1)).alias("n_train"), _array(n, lambda i: F.avg(x[i])).alias("mean"), _array(n, lambda i: F.stddev_pop(x[i])).alias("sd"))
    usable = F.transform("sd", lambda s: F.when(s > 1e-9, s).otherwise(1.0))
    return sums.select(*g, "n_train", F.transform("mean", lambda m: F.round(m, 12)).alias("mean"), F.transform(usable, lambda s: F.round(s, 12)).alias("sd"))


def scaled(rows: DataFrame, scale: DataFrame, g: Sequence[str]) -> DataFrame:
    """rows with z: x standardised by its model's training rows, and a leading 1."""
    z = F.zip_with(F.zip_with("x", "mean", lambda x, m: x - m), "sd", lambda d, s: d / s)
    return rows.join(scale, list(g)).withColumn("z", F.concat(F.array(F.lit(1.0)), z)).drop("x", "mean", "sd")


# ---------------------------------------------------------------- many features, gradient steps


def fold_values(rows: DataFrame, names: Sequence[str], folds: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row for each model that learns from it (its fold is earlier) or is tested on it; x: its features, null as 0."""
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    k = F.explode(F.sequence(F.greatest(F.col("fold"), F.lit(1)), F.lit(folds)))
    wide = rows.select(*keys, "bar_start", "rn", "fold", "label", x.alias("x")).withColumn("k", k)
    return wide.withColumn("train", F.col("fold") < F.col("k")).drop("fold")


def gradient_probability(values: DataFrame, n: int, steps: int = 200, rate: float = 0.05, penalty: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, k, bar_start, rn, label and prob of every test row, after so many steps down the mean logistic loss.

    A step sums n + 1 numbers per model, added up before the shuffle; all models of all series take it together.
    """
    g = [*keys, "k"]
    rows = cut_lineage(scaled(values, scales(values.filter("train"), g, n), g))
    train = rows.filter("train")
    weights = train.select(*g).distinct().withColumn("w", _array(n + 1, lambda i: F.lit(0.0)))
    for _ in range(steps):
        miss = sigmoid(dot(F.col("w"), F.col("z"))) - F.col("label")
        sums = train.join(weights, g).select(*g, "w", "z", miss.alias("miss")).groupBy(*g).agg(F.first("w").alias("w"), _array(n + 1, lambda i: F.avg(F.col("miss") * F.col("z")[i])).alias("grad"))
        moved = F.zip_with("w", "grad", lambda w, d: F.round(w - rate * (d + penalty * w), 9))
        weights = cut_lineage(sums.select(*g, moved.alias("w")))
    scored = rows.filter("NOT train").join(weights, g)
    return scored.select(*g, "bar_start", "rn", "label", F.round(sigmoid(dot(F.col("w"), F.col("z"))), 9).alias("prob"))


# ---------------------------------------------------------------- few features, Newton steps


def solved(sums: DataFrame, g: Sequence[str], m: int, kept: Sequence[str]) -> DataFrame:
    """g, kept and `step`: the solution of each row's own m x m system of columns h{i}_{j} (i <= j) and right side b{i}.

    The matrices are symmetric and positive definite, so elimination needs no exchange of rows.
    """
    df = sums.withColumns({f"h{j}_{i}": F.col(f"h{i}_{j}") for i in range(m) for j in range(i + 1, m)})
    for k in range(m):
        update = {}
        for i in range(k + 1, m):
            share = F.col(f"h{i}_{k}") / F.col(f"h{k}_{k}")
            update |= {f"h{i}_{j}": F.col(f"h{i}_{j}") - share * F.col(f"h{k}_{j}") for j in range(k + 1, m)}
            update[f"b{i}"] = F.col(f"b{i}") - share * F.col(f"b{k}")
        df = df.withColumns(update) if update else df
    for i in reversed(range(m)):
        rest = F.col(f"b{i}")
        for j in range(i + 1, m):
            rest = rest - F.col(f"h{i}_{j}") * F.col(f"s{j}")
        df = df.withColumn(f"s{i}", rest / F.col(f"h{i}_{i}"))
    return df.select(*g, *kept, F.array(*[F.col(f"s{i}") for i in range(m)]).alias("step"))


def newton_weights(train: DataFrame, g: Sequence[str], n: int, steps: int = 8, penalty: float = 1.0) -> DataFrame:
    """g and w: logistic regression of label on z (n values after the 1), penalty on all but the first, by full Newton steps.

    A step sums the gradient and the upper half of a small Hessian per model.
    """
    m, g = n + 1, list(g)
    weights = train.select(*g).distinct().withColumn("w", _array(m, lambda i: F.lit(0.0)))
    for _ in range(steps):
        p = sigmoid(dot(F.col("w"), F.col("z")))
        seen = train.join(weights, g).select(*g, "w", "z", p.alias("p"), "label").withColumns({"miss": F.col("label") - F.col("p"), "curve": F.col("p") * (1 - F.col("p"))})
        z = F.col("z")
        sums = seen.groupBy(*g).agg(
            F.first("w").alias("w"),
            *[F.sum(F.col("miss") * z[i]).alias(f"b{i}") for i in range(m)],
            *[F.sum(F.col("curve") * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(m) for j in range(i, m)],
        )
        held = {f"b{i}": F.col(f"b{i}") - penalty * F.col("w")[i] for i in range(1, m)} | {f"h{i}_{i}": F.col(f"h{i}_{i}") + (penalty if i else 1e-9) for i in range(m)}
        moved = F.zip_with("w", "step", lambda w, s: F.round(w + s, 9))
        weights = cut_lineage(solved(sums.withColumns(held), g, m, ["w"]).select(*g, moved.alias("w")))
    return weights


def stacked_walk_forward(rows: DataFrame, n: int, every: int = 25, least: int = 50, most: int = 2000, steps: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """rows with n_known, cohort, n_train and stacked: the probability of label 1 by the stack that was newest at the bar's close.

    rows: keys, bar_start, x (n member probabilities), label (null: not decided), settled_at. A series refits after every
    `every` decided rows, from `least` on, on its newest `most`; the models of all series and refits are fitted together, and a
    row takes part in most / every of them. A row before the first refit, or whose model saw one class, gets the mean of x.
    """
    keys = list(keys)
    decided = rows.filter("label IS NOT NULL AND settled_at IS NOT NULL").select(*keys, "bar_start", "x", "label", "settled_at")
    numbered = cut_lineage(grouped_positions(decided, keys, ["settled_at", "bar_start"], time_block("settled_at", 86400 * 30), "i"))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    reach = F.least(F.floor(F.col("_all") / every), F.floor((F.col("i") + most) / every))
    first = F.greatest(F.floor(F.col("i") / every) + 1, F.lit(-(-least // every)))
    fanned = numbered.join(sizes, keys).filter(first <= reach).withColumn("cohort", F.explode(F.sequence(first, reach))).drop("_all")
    g = [*keys, "cohort"]
    both = fanned.groupBy(*g).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select(*g)
    train = cut_lineage(fanned.join(both, g).select(*g, "x", "label"))
    scale = cut_lineage(scales(train, g, n))
    weights = newton_weights(cut_lineage(scaled(train, scale, g)), g, n, steps)

    counted = numbered.groupBy(*keys, "settled_at").agg((F.max("i") + 1).alias("known"))
    ended = rows.withColumn("_end", F.timestamp_seconds(F.unix_timestamp("bar_start") + F.col("tf_sec")))
    placed = asof_join(ended, counted, keys, "_end", "settled_at", 86400 * 30, name="_seen")
    n_known = F.coalesce("_seen.known", F.lit(0))
    placed = placed.withColumn("n_known", n_known.cast("bigint")).withColumn("cohort", F.floor(F.col("n_known") / every)).drop("_seen", "_end")
    joined = placed.join(scale.join(weights, g), g, "left")
    z = F.concat(F.array(F.lit(1.0)), F.zip_with(F.zip_with("x", "mean", lambda x, m: x - m), "sd", lambda d, s: d / s))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n
    stacked = F.when(F.col("w").isNotNull(), sigmoid(dot(F.col("w"), z))).otherwise(mean)
    return joined.withColumns({"stacked": stacked, "mean_prob": mean, "n_train": F.coalesce("n_train", F.lit(0))}).drop("mean", "sd", "w")


# ---------------------------------------------------------------- isotonic calibration


def _merged(stack: Column, block: Column) -> Column:
    """A stack of blocks (lo, hi, n, s) with one more on top; blocks whose means fall are joined from the top down.

    Each new block is pooled with all blocks below it that have no smaller mean. What is joined lies at the end, so the
    first block to join and the sums behind it tell the result; pooling goes on until means rise.
    """
    pooled = F.aggregate(
        F.reverse(stack),
        F.struct(block.alias("b"), F.lit(0).alias("k"), F.lit(False).alias("stop")),
        lambda acc, e: F.when(
            ~acc["stop"] & (e["s"] * acc["b"]["n"] >= acc["b"]["s"] * e["n"]),
            F.struct(
                F.struct(e["lo"].alias("lo"), acc["b"]["hi"].alias("hi"), (e["n"] + acc["b"]["n"]).alias("n"), (e["s"] + acc["b"]["s"]).alias("s")).alias("b"),
                (acc["k"] + 1).alias("k"), F.lit(False).alias("stop"),
            ),
        ).otherwise(F.struct(acc["b"].alias("b"), acc["k"].alias("k"), F.lit(True).alias("stop"))),
    )
    return F.concat(F.slice(stack, F.lit(1), F.size(stack) - pooled["k"]), F.array(pooled["b"]))


def _stack_of(sorted_blocks: Column) -> Column:
    empty = F.slice(sorted_blocks, 1, 0)
    return F.aggregate(sorted_blocks, empty, lambda stack, block: _merged(stack, block))


def isotonic_blocks(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, lo, hi, n, s: the pools of the isotonic regression of label on prob (0 to 1), in every series.

    Pooling adjacent violators is mergeable: rows of equal prob are one block; the blocks of a narrow cell of prob become a stack
    of blocks with rising means, and the stacks of neighbouring cells merge the same way as cells widen, until a series is one
    cell. Probabilities count to 9 digits, so the first cells hold under a thousand blocks; later ones hold the pools that are
    left, whose means are different fractions: of the order of n ** (2 / 3) for n rows at the very most.
    """
    keys = list(keys)
    blocks = rows.groupBy(*keys, F.round("prob", 9).alias("lo")).agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("label").cast("bigint").alias("s"))
    state, width = blocks.select(*keys, "lo", F.col("lo").alias("hi"), "n", "s"), 2.0**-20
    while width <= 32:
        listed = F.array_sort(F.collect_list(F.struct("lo", "hi", "n", "s")))
        joined = state.groupBy(*keys, F.floor(F.col("lo") / width).alias("cell")).agg(_stack_of(listed).alias("stack"))
        state, width = joined.select(*keys, F.inline("stack")), width * 32
    return state


def calibrated(rows: DataFrame, blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """rows with `calibrated`: the isotonic value of prob, between two pools on the line from one to the other, beyond them the
    end's; prob itself for a series without pools."""
    keys = list(keys)
    pool = F.struct("lo", "hi", (F.col("s") / F.col("n")).alias("y"))
    listed = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(pool)).alias("pools"))
    joined = rows.join(listed, keys, "left").withColumn("_p", F.round("prob", 9)).withColumn("_at", F.size(F.filter("pools", lambda b: b["lo"] <= F.col("_p"))))
    here, after = F.get("pools", F.col("_at") - 1), F.get("pools", F.col("_at"))
    between = here["y"] + (after["y"] - here["y"]) * (F.col("_p") - here["hi"]) / (after["lo"] - here["hi"])
    value = F.when(F.col("pools").isNull(), F.col("prob")).when(F.col("_at") == 0, after["y"]).when((F.col("_p") <= here["hi"]) | after.isNull(), here["y"]).otherwise(between)
    return joined.withColumn("calibrated", value).drop("pools", "_p", "_at")
