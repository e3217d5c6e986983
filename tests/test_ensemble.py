"""Trees, boosting, regressions and calibration of many series against plain loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import forest as T
from barloom.operators import regression as R
from barloom.operators import training as J

NAMES = [f"x{i}" for i in range(6)]
ON = ["key", "tf_sec", "bar_start"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    frames = []
    for key, n in (("a", 150), ("b", 90), ("c", 7)):
        x = rng.normal(0, 1, (n, 6))
        x[:, 3], x[:, 4] = 1.0, rng.integers(0, 2, n)
        x[rng.random((n, 6)) < 0.02] = np.nan
        label = (np.nan_to_num(x[:, 0]) + 0.5 * x[:, 4] + rng.normal(0, 0.7, n) > 0.2).astype(int)
        frame = pd.DataFrame(x, columns=NAMES)
        frames.append(frame.assign(key=key, tf_sec=60, bar_start=pd.to_datetime(1704067200 + 60 * np.arange(n), unit="s"), rn=np.arange(n), label=label, extra=1))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def folded(spark, table):
    df = spark.createDataFrame(table)
    for c in NAMES:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return J.expanding_folds(df).cache()


def draw(x: int) -> float:
    for factor in T.FACTORS:
        v = x % T.PRIME * factor % T.PRIME
        x = v * v % T.PRIME + 7
    return x / (T.PRIME + 7)


def series_models(table):
    """Training and test rows of each series and fold: (key, k, rn, label, x) arrays."""
    for key, part in table.groupby("key"):
        x, y, n = np.nan_to_num(part[NAMES].to_numpy(float)), part["label"].to_numpy(), len(part)
        size = max(n // 6, 1)
        fold = np.maximum(0, 5 - (n - np.arange(n) - 1) // size)
        for k in range(1, 6):
            train, test = np.flatnonzero(fold < k), np.flatnonzero(fold == k)
            if len(train) and len(test):
                yield key, k, x, y, train, test


def binned(x, train, bins):
    low, high = x[train].min(axis=0), x[train].max(axis=0)
    with np.errstate(all="ignore"):
        b = np.floor((x - low) / (high - low) * bins)
    return np.where(high > low, np.clip(np.nan_to_num(b), 0, bins - 1), 0).astype(int)


def impurity(a, b):
    return (a * a + b * b) / (a + b) if a + b > 0 else 0.0


def plain_tree(bins, train, times, a, b, growth, tree, score, salt=0):
    """Node of every row."""
    node = np.ones(len(bins), int)
    for level in range(growth.depth):
        for at in np.unique(node[train]):
            rows = [r for r in train if node[r] == at and times[r] > 0]
            if at < 1 << level or not rows:
                continue
            number = (tree + salt) * T.STRIDE * 128 + int(at) * 128 + growth.seed * 977
            best = None
            for f in range(bins.shape[1]):
                if growth.mtry < 1 and draw(number + f) >= growth.mtry:
                    continue
                present = sorted({bins[r, f] for r in rows})
                cuts = present[:-1]
                if growth.random_cut and cuts:
                    drawn = present[0] + int(draw(number + f + 64 * T.STRIDE * T.STRIDE) * (present[-1] - present[0]))
                    cuts = [max(c for c in present if c <= drawn)]
                for c in cuts:
                    left = [r for r in rows if bins[r, f] <= c]
                    right = [r for r in rows if bins[r, f] > c]
                    if min(len(left), len(right)) < growth.min_leaf:
                        continue
                    gain = round(score(a[left].sum(), b[left].sum()) + score(a[right].sum(), b[right].sum()) - score(a[rows].sum(), b[rows].sum()), 9)
                    if gain > 1e-7 and (best is None or (gain, -f, -c) > best):
                        best = (gain, -f, -c)
            if best:
                f, c = -best[1], -best[2]
                mine = node == at
                node[mine] = at * 2 + (bins[mine, f] > c)
    return node


GROWTHS = {
    "forest": T.Growth(3, 8, 4, 2, 0.6, bootstrap=True),
    "extra": T.Growth(2, 8, 3, 2, 0.7, random_cut=True, seed=43),
    "tree": T.Growth(3, 8, 1, 5),
}


@pytest.mark.parametrize("name", list(GROWTHS))
def test_forest_equals_plain_trees(folded, table, name):
    growth = GROWTHS[name]
    want = {}
    for key, k, x, y, train, test in series_models(table):
        bins, total, said = binned(x, train, growth.bins), np.zeros(len(x)), 0
        n1 = int(y[train].sum())
        weight = np.array([len(train) / (2 * c) if (c := (n1 if v else len(train) - n1)) else 1.0 for v in y])
        for tree in range(growth.trees):
            times = np.ones(len(x), int)
            if growth.bootstrap:
                times = np.array([sum(draw((tree + 1) * 1000003 + r + growth.seed) >= c for c in T.BOOTSTRAP) for r in range(len(x))])
            a, b = times * weight * (y == 1), times * weight * (y == 0)
            node = plain_tree(bins, train, times, a, b, growth, tree, impurity)
            said += times[train].any()
            for r in test if times[train].any() else ():
                rows = [q for q in train if node[q] == node[r] and times[q] > 0]
                total[r] += a[rows].sum() / (a[rows].sum() + b[rows].sum())
        want |= {(key, k, r): total[r] / said if said else 0.5 for r in test}
    models = T.fold_models(folded, NAMES, growth.bins)
    got = {(r.key, r.k, r.rn): r.prob for r in T.forest_probability(models, growth, len(NAMES)).collect()}
    assert set(got) == set(want)
    assert all(abs(got[c] - want[c]) < 1e-8 for c in want)
    assert len(set(got.values())) > 5


def test_boosting_equals_plain_rounds(folded, table):
    boost = T.Boost(rounds=2, depth=2, bins=8, rate=0.5, min_leaf=3)
    growth = T.Growth(boost.depth, boost.bins, 1, boost.min_leaf, seed=boost.seed)
    want = {}
    for key, k, x, y, train, test in series_models(table):
        bins = binned(x, train, boost.bins)
        margin = np.full(len(x), np.log((y[train].sum() + 0.5) / ((1 - y[train]).sum() + 0.5)))
        for r in range(boost.rounds):
            p = 1 / (1 + np.exp(-margin))
            times = np.array([int(draw(q + 1000003 * (r + 1) + boost.seed) < boost.share) for q in range(len(x))])
            a, b = y - p, p * (1 - p)
            node = plain_tree(bins, train, times, a, b, growth, 0, lambda g, c: g * g / (c + boost.penalty), r)
            step = np.zeros(len(x))
            for at in np.unique(node):
                rows = [q for q in train if node[q] == at and times[q]]
                step[node == at] = a[rows].sum() / (b[rows].sum() + boost.penalty)
            margin = margin + boost.rate * step
        want |= {(key, k, r): 1 / (1 + np.exp(-margin[r])) for r in test}
    got = {(r.key, r.k, r.rn): r.prob for r in T.boosted_probability(T.fold_models(folded, NAMES, 8), boost, len(NAMES)).collect()}
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-8 for c in want)


def test_gradient_steps_equal_a_plain_loop(folded, table):
    want = {}
    for key, k, x, y, train, test in series_models(table):
        sd = x[train].std(axis=0)
        z = np.c_[np.ones(len(x)), (x - x[train].mean(axis=0)) / np.where(sd > 1e-9, sd, 1)]
        w = np.zeros(7)
        for _ in range(4):
            p = 1 / (1 + np.exp(-z[train] @ w))
            w -= 0.3 * (((p - y[train])[:, None] * z[train]).mean(axis=0) + 0.01 * w)
        want |= {(key, k, r): 1 / (1 + np.exp(-z[r] @ w)) for r in test}
    got = {(r.key, r.k, r.rn): r.prob for r in R.gradient_probability(R.fold_values(folded, NAMES), 6, steps=4, rate=0.3).collect()}
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-6 for c in want)


def test_stack_knows_settled_rows_only(spark):
    rng = np.random.default_rng(2)
    n = 160
    start = 1704067200 + 60 * np.arange(n)
    x = np.round(rng.random((n, 2)), 6)
    label = [None if u < 0.1 else int(v + rng.normal(0, 0.3) > 0.5) for u, v in zip(rng.random(n), x[:, 0], strict=True)]
    rows = pd.DataFrame({"key": "a", "tf_sec": 60, "bar_start": pd.to_datetime(start, unit="s"), "x": x.tolist(), "label": pd.array(label, "Int64"), "settled_at": pd.to_datetime(start + 120, unit="s")})
    df = spark.createDataFrame(rows.astype({"label": object}).where(rows.notna(), None), "key string, tf_sec int, bar_start timestamp, x array<double>, label bigint, settled_at timestamp")
    got = {int(r.at): r for r in R.stacked_walk_forward(df, 2, 10, 20, 60, 6).withColumn("at", F.unix_timestamp("bar_start")).collect()}
    for i in range(n):
        known = [j for j in range(n) if label[j] is not None and start[j] + 120 <= start[i] + 60]
        cohort = len(known) // 10
        seen = known[max(0, cohort * 10 - 60) : cohort * 10]
        r = got[start[i]]
        assert (r.n_known, r.cohort) == (len(known), cohort)
        if cohort < 2:
            assert r.stacked == pytest.approx(x[i].mean())
            continue
        xs, y = x[seen], np.array([label[j] for j in seen])
        mean, sd = xs.mean(axis=0), xs.std(axis=0)
        z, w = np.c_[np.ones(len(xs)), (xs - mean) / sd], np.zeros(3)
        for _ in range(6):
            p = 1 / (1 + np.exp(-z @ w))
            pen = np.array([0, 1, 1.0])
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * w)
        assert r.n_train == len(seen)
        assert r.stacked == pytest.approx(1 / (1 + np.exp(-np.r_[1, (x[i] - mean) / sd] @ w)), abs=1e-7)


def pava(points):
    """Pools of (prob, label) pairs by the textbook loop."""
    pools = []
    for p in sorted({p for p, _ in points}):
        mine = [y for q, y in points if q == p]
        pools.append([p, p, len(mine), sum(mine)])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return [tuple(p) for p in pools]


def test_isotonic_pools_and_values(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 600), ("b", 40), ("c", 1)):
        p = np.round(np.where(rng.random(n) < 0.5, rng.random(n), 0.5 + rng.random(n) * 1e-6), 9)
        rows += [(key, 60, float(v), int(rng.random() < v)) for v in p]
    df = spark.createDataFrame(rows, "key string, tf_sec int, prob double, label int")
    blocks = R.isotonic_blocks(df)
    got = {}
    for r in blocks.orderBy("lo").collect():
        got.setdefault(r.key, []).append((r.lo, r.hi, r.n, r.s))
    assert got == {key: pava([(p, y) for k, _, p, y in rows if k == key]) for key in "abc"}
    ask = [("a", 60, v) for v in (0.0, 0.25, 0.5, 0.5000003, 0.77, 1.0)] + [("c", 60, 0.4), ("none", 60, 0.3)]
    for r in R.calibrated(spark.createDataFrame(ask, "key string, tf_sec int, prob double"), blocks).collect():
        if r.key == "none":
            assert r.calibrated == 0.3
            continue
        pools = got[r.key]
        xs, ys = [v for lo, hi, _, _ in pools for v in (lo, hi)], [s / n for _, _, n, s in pools for _ in (0, 1)]
        assert r.calibrated == pytest.approx(np.interp(r.prob, xs, ys))
    assert R.isotonic_blocks(df.limit(0)).count() == 0
