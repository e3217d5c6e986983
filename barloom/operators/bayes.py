"""Gaussian class models of every series and of every point in time, from running sums.

A model needs only counts, means and squared deviations per class and feature. Merged per part of a series (a fold, or the bars
between two retrainings) and added up over the earlier parts, one pass over the rows yields the models of all series and
all parts, each of which has seen earlier rows only. There is no loop over series, folds or retrainings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import KEYS, prefix_scan

#: Least variance of a class, as a share of the feature's variance over both classes.
SMOOTHING = 1e-3

#: A feature whose variance is less than this share of its squared mean is constant.
CONSTANT = 1e-20


def earlier_models(rows: DataFrame, names: Sequence[str], part: str, keys: Sequence[str] = KEYS, parts_per_block: int = 4096) -> DataFrame:
    """Per series and part: `n_red`, `n_green` (training rows) and `model`, from all rows of earlier parts.

    Rows without a label add nothing. `model` has one entry per feature with mean and variance of each class. A feature
    that is constant over both classes tells nothing and gets the same entry for both.
    """
    keys = list(keys)
    values = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    long = rows.select(*keys, part, "label", F.posexplode(values).alias("_i", "_x"))
    sums = []
    for side in (0, 1):
        mine = F.when(F.col("label") == side, F.col("_x"))
        sums += [F.count(mine).alias(f"n{side}"), F.avg(mine).alias(f"m{side}"), F.var_pop(mine).alias(f"v{side}")]
    per_part = long.groupBy(*keys, part, "_i").agg(*sums)
    # Means and squared deviations merge about the feature's first mean, so a price level far from 0 costs no digits.
    block = F.floor(F.col(part) / parts_per_block)
    centred = prefix_scan(per_part, [*keys, "_i"], block, [part], {"_c": ("first", F.coalesce("m0", "m1"))})
    measures = {}
    for side in (0, 1):
        n_own, off = F.col(f"n{side}"), F.col(f"m{side}") - F.col("_c")
        measures |= {f"_n{side}": ("sum", n_own), f"_d{side}": ("sum", n_own * off), f"_e{side}": ("sum", n_own * (off * off + F.col(f"v{side}")))}
    so_far = prefix_scan(centred, [*keys, "_i"], block, [part], measures, inclusive=False)
    n, d, e = ([F.coalesce(F.col(f"_{c}{side}"), F.lit(0.0)) for side in (0, 1)] for c in "nde")

    def variance(n: Column, d: Column, e: Column) -> Column:
        return F.greatest(e / n - (d / n) * (d / n), F.lit(0.0))

    both = variance(n[0] + n[1], d[0] + d[1], e[0] + e[1])
    mean = F.col("_c") + (d[0] + d[1]) / (n[0] + n[1])
    tells = both > CONSTANT * mean * mean
    entry = F.struct(
        F.col("_i"),
        *[F.when(tells, F.col("_c") + d[i] / n[i]).otherwise(0.0).alias(f"m{i}") for i in (0, 1)],
        *[F.when(tells, F.greatest(variance(n[i], d[i], e[i]), SMOOTHING * both)).otherwise(1.0).alias(f"v{i}") for i in (0, 1)],
    )
    trained = (n[0] > 0) & (n[1] > 0)
    # As many entries as features.
    return so_far.groupBy(*keys, part).agg(
        F.max(n[0]).cast("bigint").alias("n_red"), F.max(n[1]).cast("bigint").alias("n_green"),
        F.array_sort(F.collect_list(F.when(trained, entry))).alias("model"),
    )


def earlier_probability(
    rows: DataFrame, names: Sequence[str], part: str, min_rows: int = 1, default: float = 0.5, keys: Sequence[str] = KEYS
) -> DataFrame:
    """`prob` of label 1 by the model of all earlier parts of the row's own series, with `n_train` and `trained`.

    A model is trained if it has seen both classes and at least `min_rows` rows; without one, `prob` is `default`.
    """
    models = earlier_models(rows, names, part, keys)
    joined = rows.join(models, [*keys, part])
    values = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])

    def term(x: Column, m: Column) -> Column:
        far0, far1 = x - m["m0"], x - m["m1"]
        return 0.5 * F.log(m["v0"] / m["v1"]) + far0 * far0 / (2 * m["v0"]) - far1 * far1 / (2 * m["v1"])

    odds = F.aggregate(F.zip_with(values, F.col("model"), term), F.lit(0.0), lambda a, t: a + t) + F.log(F.col("n_green") / F.col("n_red"))
    trained = (F.col("n_red") > 0) & (F.col("n_green") > 0) & (F.col("n_red") + F.col("n_green") >= min_rows)
    prob = F.when(trained, 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-500.0)), F.lit(500.0))))).otherwise(default)
    return joined.withColumns({"prob": prob, "n_train": F.col("n_red") + F.col("n_green"), "trained": trained}).drop("model", "n_red", "n_green")


def fold_accuracy(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series and fold: tested rows and the share of them predicted right."""
    right = (F.col("prob") > 0.5) == (F.col("label") == 1)
    tested = scored.filter((F.col("fold") > 0) & F.col("label").isNotNull())
    return tested.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def series_status(rows: DataFrame, folds: DataFrame, min_rows: int = 150, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series: labelled rows, whether they suffice, and the mean accuracy over its folds (0 if there are too few rows)."""
    counts = rows.groupBy(*keys).agg(F.count("label").alias("n_rows"))
    means = folds.groupBy(*keys).agg(F.avg("accuracy").alias("accuracy"))
    ready = F.col("n_rows") >= min_rows
    return counts.join(means, list(keys), "left").select(
        *keys, "n_rows", ready.alias("trained"), F.when(ready, F.coalesce("accuracy", F.lit(0.0))).otherwise(0.0).alias("accuracy")
    )
