"""Class models from running sums against a plain loop over the earlier rows."""

import numpy as np
import pandas as pd

from barloom.operators import bayes as Y


def plain(rows, part):
    """Probability and training rows of each row by a model of the rows of earlier parts."""
    out = []
    for _, row in rows.iterrows():
        seen = rows[(rows["key"] == row["key"]) & (rows[part] < row[part]) & rows["label"].notna()]
        green, red = seen[seen["label"] == 1], seen[seen["label"] == 0]
        if not len(green) or not len(red):
            out.append((0.5, len(seen)))
            continue
        odds = np.log(len(green) / len(red))
        for c in ("a", "b", "flat"):
            both = np.var(seen[c])
            if both <= 1e-12 * np.mean(seen[c]) ** 2:
                continue
            v1, v0 = max(np.var(green[c]), 1e-3 * both), max(np.var(red[c]), 1e-3 * both)
            odds += 0.5 * np.log(v0 / v1) + (row[c] - np.mean(red[c])) ** 2 / (2 * v0) - (row[c] - np.mean(green[c])) ** 2 / (2 * v1)
        out.append((1 / (1 + np.exp(-np.clip(odds, -500, 500))), len(seen)))
    return out


def test_models_of_earlier_parts(spark):
    rng = np.random.default_rng(3)
    frames = []
    for key, n in (("x", 90), ("y", 25)):
        label = rng.integers(0, 2, n).astype(float)
        label[-1] = np.nan
        frames.append(pd.DataFrame({"key": key, "tf_sec": 60, "rn": range(n), "part": np.arange(n) // 10, "label": label,
                                    "a": rng.normal(0, 1, n) + np.nan_to_num(label), "b": rng.integers(0, 2, n) * 1.0, "flat": 3.0}))
    rows = pd.concat(frames, ignore_index=True)
    table = spark.createDataFrame(
        [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in rows.astype(object).itertuples(index=False, name=None)],
        "key string, tf_sec int, rn int, part int, label double, a double, b double, flat double",
    )
    for per_block in (2, 4096):
        models = Y.earlier_models(table, ["a", "b", "flat"], "part", parts_per_block=per_block)
        assert models.count() == 9 + 3
    got = Y.earlier_probability(table, ["a", "b", "flat"], "part").orderBy("key", "rn").collect()
    want = plain(rows, "part")
    assert np.allclose([r["prob"] for r in got], [p for p, _ in want])
    assert [r["n_train"] for r in got] == [n for _, n in want]
    few = Y.earlier_probability(table, ["a", "b", "flat"], "part", min_rows=40, default=0.7)
    assert {r["prob"] for r in few.filter("NOT trained").collect()} == {0.7} and few.filter("trained").count() > 0


def test_empty_table(spark):
    table = spark.createDataFrame([], "key string, tf_sec int, part int, label int, a double")
    assert Y.earlier_probability(table, ["a"], "part").count() == 0
