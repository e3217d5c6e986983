"""The members of the ensemble, each fitted per series: trees, boosting, regression, class models."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bayes as Y
from barloom.operators import forest as T
from barloom.operators import regression as R
from barloom.operators import training as J
from barloom.operators.indicators import FEATURES
from barloom.plans import model_queries as M
from barloom.plans import signal_queries as S
from barloom.plans.registry import epoch, query, rounded
from barloom.plans.sqlparts import BARS, INDICATORS, rd, with_
from barloom.session import cut_lineage

# Small enough for the recursion-free SQL next to them; `T.FOREST`, `T.EXTRA` and `T.Boost()` are the full sizes.
FOREST = T.Growth(depth=3, bins=16, trees=5, bootstrap=True, mtry=0.115)
EXTRA = T.Growth(depth=3, bins=16, trees=5, random_cut=True, mtry=0.115, seed=43)
TREE = T.Growth(depth=3, bins=16, trees=1)
BOOST = T.Boost(rounds=3, depth=2, bins=16, rate=0.3)
N = len(FEATURES)


def draw_sql(x: str) -> str:
    for factor in T.FACTORS:
        v = f"((({x}) % {T.PRIME}) * {factor} % {T.PRIME})"
        x = f"({v} * {v} % {T.PRIME} + 7)"
    return f"({x} / {T.PRIME + 7}.0::DOUBLE)"


FOLDED = (
    with_(BARS, INDICATORS, M._LABELLED)
    + f""", cn AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lab WHERE label IS NOT NULL),
parts AS (SELECT *, CAST(greatest(0, 5 - (n - rn - 1) // greatest(n // 6, 1)) AS INTEGER) AS fold FROM cn),
pm AS (SELECT key, k, rn, label, fold < k AS train, xs FROM parts, range(1, 6) r(k) WHERE fold <= k),
px AS (SELECT key, k, rn, train, unnest(xs) AS x, unnest(range({N})) AS i FROM pm),
rc AS (SELECT key, k, i, min(x) AS a, max(x) - min(x) AS w FROM px WHERE train GROUP BY ALL),
bn AS (SELECT key, k, rn, i, CAST(CASE WHEN w > 0 THEN least(greatest(floor((x - a) / w * 16), 0), 15) ELSE 0 END AS INTEGER) AS bin FROM px JOIN rc USING (key, k, i)),
cw AS (SELECT key, k, count(*) AS n, count(*) FILTER (label = 1) AS n1 FROM pm WHERE train GROUP BY ALL)"""
)


def _grow_sql(name: str, first: str, growth: T.Growth, score, salt: int = 0) -> str:
    """Levels of one growth over {first} (key, k, rn, label, train, t, node, times, a, b); the last is {name}."""
    out, at = "", first
    number = f"((t + {salt}) * {T.STRIDE * 128} + node * 128 + {growth.seed * 977})"
    for level in range(growth.depth):
        wanted = f" AND {draw_sql(number + ' + i')} < {growth.mtry}::DOUBLE" if growth.mtry < 1 else ""
        cut = ""
        if growth.random_cut:
            drawn = f"low + floor({draw_sql(number + f' + f + {64 * T.STRIDE * T.STRIDE}')} * (high - low))"
            cut = f" AND bin <= {drawn} AND nxt > {drawn}"
        p, following = f"{name}{level}", name if level == growth.depth - 1 else f"{name}a{level + 1}"
        gain = f"round({score('al', 'bl')} + {score('(aa - al)', '(ba - bl)')} - {score('aa', 'ba')}, 9)"
        out += f""",
{p}h AS (SELECT key, k, t, node, i AS f, bin, count(*) AS n, sum(a) AS a, sum(b) AS b FROM {at} JOIN bn USING (key, k, rn) WHERE train AND times > 0 AND node >= {1 << level}{wanted} GROUP BY ALL),
{p}c AS (SELECT *, sum(n) OVER l AS nl, sum(a) OVER l AS al, sum(b) OVER l AS bl, sum(n) OVER w AS na, sum(a) OVER w AS aa, sum(b) OVER w AS ba, min(bin) OVER w AS low, max(bin) OVER w AS high, lead(bin) OVER o AS nxt
  FROM {p}h WINDOW o AS (PARTITION BY key, k, t, node, f ORDER BY bin), l AS (PARTITION BY key, k, t, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY key, k, t, node, f)),
{p}s AS (SELECT key, k, t, node, arg_max(f, row(gain, -f, -bin)) AS f, arg_max(bin, row(gain, -f, -bin)) AS bin
  FROM (SELECT *, {gain} AS gain FROM {p}c WHERE nl >= {growth.min_leaf} AND na - nl >= {growth.min_leaf}{cut}) q WHERE gain > 1e-7::DOUBLE GROUP BY ALL),
{following} AS (SELECT x.* REPLACE (CASE WHEN s.f IS NULL THEN x.node ELSE x.node * 2 + CASE WHEN v.bin > s.bin THEN 1 ELSE 0 END END AS node)
  FROM {at} x LEFT JOIN {p}s s USING (key, k, t, node) LEFT JOIN bn v ON v.key = x.key AND v.k = x.k AND v.rn = x.rn AND v.i = s.f)"""
        at = following
    return out


def _impurity(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN ({a} * {a} + {b} * {b}) / ({a} + {b}) ELSE 0 END"


def forest_sql(name: str, growth: T.Growth) -> str:
    """{name} (key, k, rn, label, prob) of the test rows."""
    u = draw_sql(f"(t + 1) * 1000003 + rn + {growth.seed}")
    times = "CASE " + " ".join(f"WHEN u < {c}::DOUBLE THEN {i}" for i, c in enumerate(T.BOOTSTRAP)) + f" ELSE {len(T.BOOTSTRAP)} END" if growth.bootstrap else "1"
    return (
        f""",
{name}u AS (SELECT key, k, rn, label, train, t, 1 AS node, {u} AS u, CASE WHEN CASE WHEN label = 1 THEN c.n1 ELSE c.n - c.n1 END > 0 THEN c.n / (2 * CASE WHEN label = 1 THEN c.n1 ELSE c.n - c.n1 END)::DOUBLE ELSE 1 END AS cw
  FROM pm JOIN cw c USING (key, k), range({growth.trees}) r(t)),
{name}a0 AS (SELECT key, k, rn, label, train, t, node, {times} AS times, CASE WHEN label = 1 THEN {times} * cw ELSE 0 END AS a, CASE WHEN label = 0 THEN {times} * cw ELSE 0 END AS b FROM {name}u)"""
        + _grow_sql(f"{name}g", f"{name}a0", growth, _impurity)
        + f""",
{name}l AS (SELECT key, k, t, node, sum(a) / (sum(a) + sum(b)) AS v FROM {name}g WHERE train AND times > 0 GROUP BY ALL),
{name} AS (SELECT key, k, rn, any_value(label) AS label, round(sum(v) / count(*), 9) AS prob FROM {name}g JOIN {name}l USING (key, k, t, node) WHERE NOT train GROUP BY ALL)"""
    )


def boost_sql(name: str, boost: T.Boost) -> str:
    out = f""",
{name}m0 AS (SELECT key, k, rn, label, train, ln((c.n1 + 0.5::DOUBLE) / (c.n - c.n1 + 0.5::DOUBLE)) AS margin FROM pm JOIN cw c USING (key, k))"""
    growth = T.Growth(boost.depth, boost.bins, 1, boost.min_leaf, 1.0, seed=boost.seed)
    for r in range(boost.rounds):
        p = f"{name}r{r}"
        drawn = f"CASE WHEN {draw_sql(f'rn + {1000003 * (r + 1) + boost.seed}')} < {boost.share}::DOUBLE THEN 1 ELSE 0 END"
        out += f""",
{p}a0 AS (SELECT *, label - p AS a, p * (1 - p) AS b FROM (SELECT *, 0 AS t, 1 AS node, {drawn} AS times, 1 / (1 + exp(-margin)) AS p FROM {name}m{r}) q)"""
        out += _grow_sql(f"{p}g", f"{p}a0", growth, lambda a, b: f"{a} * {a} / ({b} + {boost.penalty}::DOUBLE)", r)
        out += f""",
{p}l AS (SELECT key, k, node, sum(a) / (sum(b) + {boost.penalty}::DOUBLE) AS v FROM {p}g WHERE train AND times > 0 GROUP BY ALL),
{name}m{r + 1} AS (SELECT key, k, rn, label, train, round(margin + {boost.rate}::DOUBLE * coalesce(v, 0), 12) AS margin FROM {p}g LEFT JOIN {p}l USING (key, k, node))"""
    return out + f""",
{name} AS (SELECT key, k, rn, label, round(1 / (1 + exp(-margin)), 9) AS prob FROM {name}m{boost.rounds} WHERE NOT train)"""


def _accuracy_sql(members: dict[str, str]) -> str:
    every = " UNION ALL ".join(f"SELECT '{m}' AS model, key, k, label, prob FROM {table}" for m, table in members.items())
    return f""",
every AS ({every}),
ac AS (SELECT model, key, CAST(k AS INTEGER) AS fold, count(*) AS n, avg(CASE WHEN (prob > 0.5::DOUBLE) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM every GROUP BY ALL)"""


TREES = FOLDED + forest_sql("fo", FOREST) + forest_sql("ex", EXTRA) + forest_sql("tr", TREE) + boost_sql("bo", BOOST)


STEPS = 5


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-least(greatest({x}, -500), 500)))"


def gradient_sql(name: str, steps: int, rate: str = "0.05", penalty: str = "0.01") -> str:
    """{name} (key, k, rn, label, prob) of the test rows, by steps down the mean loss from zero."""
    out = f""",
{name}s AS (SELECT key, k, i, round(avg(x), 12) AS mean, stddev_pop(x) AS sd FROM px WHERE train GROUP BY ALL),
{name}z AS (SELECT p.key, p.k, p.rn, p.train, p.i + 1 AS i, (p.x - s.mean) / round(CASE WHEN s.sd > 1e-9::DOUBLE THEN s.sd ELSE 1 END, 12) AS z FROM px p JOIN {name}s s USING (key, k, i)
  UNION ALL SELECT key, k, rn, train, 0, 1 FROM pm),
{name}w0 AS (SELECT DISTINCT key, k, i, 0::DOUBLE AS w FROM {name}z)"""
    for step in range(steps):
        out += f""",
{name}p{step} AS (SELECT key, k, rn, {_sigmoid('sum(w * z)')} - any_value(label) AS miss FROM {name}z z JOIN {name}w{step} USING (key, k, i) JOIN pm USING (key, k, rn) WHERE z.train GROUP BY ALL),
{name}w{step + 1} AS (SELECT key, k, i, round(any_value(w) - {rate}::DOUBLE * (avg(miss * z) + {penalty}::DOUBLE * any_value(w)), 9) AS w FROM {name}z z JOIN {name}p{step} USING (key, k, rn) JOIN {name}w{step} USING (key, k, i) GROUP BY ALL)"""
    return out + f""",
{name} AS (SELECT key, k, rn, any_value(label) AS label, round({_sigmoid('sum(w * z)')}, 9) AS prob FROM {name}z z JOIN {name}w{steps} USING (key, k, i) JOIN pm USING (key, k, rn) WHERE NOT z.train GROUP BY ALL)"""


BAYES = M._BAYES.replace("parts", "bparts").format(min_rows=1)
MEMBERS = {"forest": "fo", "extra": "ex", "tree": "tr", "boosted": "bo", "logistic": "lg", "bayes": "ba"}
ALL = (
    TREES
    + gradient_sql("lg", STEPS)
    + ", bparts AS (SELECT *, fold AS part FROM parts)"
    + BAYES
    + ", ba AS (SELECT key, part AS k, rn, label, prob FROM pr WHERE part > 0)"
    + _accuracy_sql(MEMBERS)
)


def _fold_rows(spark, sf):
    return J.expanding_folds(M._rows(spark, sf))


def _tree_members(folded):
    """Fold accuracies of the tree members, each model of every series in the same passes."""
    models = cut_lineage(T.fold_models(folded, FEATURES, 16))
    scored = {name: T.forest_probability(models, growth, N) for name, growth in (("forest", FOREST), ("extra", EXTRA), ("tree", TREE))}
    scored["boosted"] = T.boosted_probability(models, BOOST, N)
    return {name: T.accuracy(s) for name, s in scored.items()}


def _listed(members):
    out = None
    for name, table in members.items():
        part = table.select(F.lit(name).alias("model"), "key", "fold", "n", "accuracy")
        out = part if out is None else out.unionByName(part)
    return out


@query("series_forest_folds", TREES + _accuracy_sql({"forest": "fo", "extra": "ex", "tree": "tr", "boosted": "bo"}) + f" SELECT model, key, fold, n, {rd('accuracy')} FROM ac")
def series_forest_folds(spark, sf):
    """Accuracy of every series' own forest, extra trees, tree and boosted trees in five expanding folds."""
    return _listed(_tree_members(_fold_rows(spark, sf))).select("model", "key", "fold", "n", *rounded("accuracy"))


def _all_members(folded):
    members = _tree_members(folded)
    values = R.fold_values(folded, FEATURES)
    members["logistic"] = T.accuracy(R.gradient_probability(values, N, STEPS))
    members["bayes"] = Y.fold_accuracy(Y.earlier_probability(folded, FEATURES, "fold"))
    return members


@query(
    "series_forest_status",
    ALL
    + f""", rows_of AS (SELECT key, count(*) AS n_rows FROM parts GROUP BY key)
SELECT model, key, n_rows, n_rows >= 150 AS trained, round(CASE WHEN n_rows >= 150 THEN coalesce(a, 0) ELSE 0 END + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS accuracy
FROM (SELECT model, key, avg(accuracy) AS a FROM ac GROUP BY ALL) JOIN rows_of USING (key)""",
)
def series_forest_status(spark, sf):
    """Rows, readiness and mean fold accuracy of all six members of every series."""
    folded = _fold_rows(spark, sf)
    out = None
    for name, table in _all_members(folded).items():
        part = Y.series_status(folded, table).select(F.lit(name).alias("model"), "key", "n_rows", "trained", *rounded("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "series_calibration",
    FOLDED
    + forest_sql("fo", FOREST)
    + f""",
bl AS (SELECT key, prob AS p, count(*) AS n, sum(label) AS s, row_number() OVER (PARTITION BY key ORDER BY prob) AS i FROM fo WHERE k < 5 GROUP BY key, prob),
ab AS (SELECT x.key, x.i AS a, y.i AS b, sum(y.s) OVER q / (sum(y.n) OVER q)::DOUBLE AS m FROM bl x JOIN bl y ON y.key = x.key AND y.i >= x.i WINDOW q AS (PARTITION BY x.key, x.i ORDER BY y.i)),
mn AS (SELECT key, a, b AS i, min(m) OVER (PARTITION BY key, a ORDER BY b DESC) AS m FROM ab),
iso AS (SELECT mn.key, mn.i, bl.p, max(m) AS y FROM mn JOIN bl ON bl.key = mn.key AND bl.i = mn.i GROUP BY ALL),
ask AS (SELECT key, rn, label, prob FROM fo WHERE k = 5),
around AS (SELECT a.key, a.rn, a.label, a.prob, (SELECT max(p) FROM iso WHERE iso.key = a.key AND p <= a.prob) AS p0, (SELECT min(p) FROM iso WHERE iso.key = a.key AND p >= a.prob) AS p1 FROM ask a)
SELECT a.key, l.bar_epoch, a.label, {rd('prob')}, round(CASE WHEN p0 IS NULL THEN y1.y WHEN p1 IS NULL OR p0 = p1 THEN y0.y ELSE y0.y + (y1.y - y0.y) * (prob - p0) / (p1 - p0) END + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS calibrated
FROM around a JOIN parts l ON l.key = a.key AND l.rn = a.rn LEFT JOIN iso y0 ON y0.key = a.key AND y0.p = p0 LEFT JOIN iso y1 ON y1.key = a.key AND y1.p = p1""",
)
def series_calibration(spark, sf):
    """Forest probabilities of the newest fold, calibrated by the isotonic regression of each series on its earlier folds."""
    models = cut_lineage(T.fold_models(_fold_rows(spark, sf), FEATURES, 16))
    scored = cut_lineage(T.forest_probability(models, FOREST, N))
    seen, asked = scored.filter("k < 5"), scored.filter("k = 5")
    return R.calibrated(asked, R.isotonic_blocks(seen)).select("key", epoch(), "label", *rounded("prob", "calibrated"))


NEWTON, COHORT, LEAST, MOST = 4, 25, 50, 2000


def newton_sql(n: int, steps: int) -> str:
    """wt{steps} (key, c, w0 ...) from sz (key, c, label, z0 ...): Newton steps, each system solved by Gauss-Jordan elimination."""
    m = n + 1
    out = ",\nwt0 AS (SELECT DISTINCT key, c, " + ", ".join(f"0::DOUBLE AS w{i}" for i in range(m)) + " FROM sz)"
    for t in range(steps):
        p = _sigmoid(" + ".join(f"w{i} * z{i}" for i in range(m)))
        held = [f"sum((label - p) * z{i})" + (f" - w{i}" if i else "") + f" AS e0_{i}_{m}" for i in range(m)]
        held += [f"sum(p * (1 - p) * z{i} * z{j})" + ("" if i != j else " + 1" if i else " + 1e-9::DOUBLE") + f" AS e0_{i}_{j}" for i in range(m) for j in range(m)]
        w = ", ".join(f"w{i}" for i in range(m))
        out += f""",
e{t}_0 AS (SELECT key, c, {w}, {', '.join(held)} FROM (SELECT s.*, {w}, {p} AS p FROM sz s JOIN wt{t} USING (key, c)) q GROUP BY key, c, {w})"""
        for k in range(m):
            cells = []
            for i in range(m):
                for j in range(k, m + 1):
                    own = f"e{k}_{k}_{j} / e{k}_{k}_{k}"
                    cells.append((own if i == k else f"e{k}_{i}_{j} - e{k}_{i}_{k} * ({own})") + f" AS e{k + 1}_{i}_{j}")
            out += f""",
e{t}_{k + 1} AS (SELECT key, c, {w}, {', '.join(cells)} FROM e{t}_{k})"""
        out += f",\nwt{t + 1} AS (SELECT key, c, " + ", ".join(f"round(w{i} + e{m}_{i}_{m}, 9) AS w{i}" for i in range(m)) + f" FROM e{t}_{m})"
    return out


STACK = (
    FOLDED
    + forest_sql("fo", FOREST)
    + forest_sql("tr", TREE)
    + ", bparts AS (SELECT *, fold AS part FROM parts)"
    + BAYES
    + ", ba AS (SELECT key, part AS k, rn, label, round(prob, 9) AS prob FROM pr WHERE part > 0)"
    + S.SIGNALS
    + f""",
sx AS (SELECT l.key, l.bar_epoch, fo.prob AS x1, tr.prob AS x2, ba.prob AS x3, CASE o.outcome WHEN 'WIN' THEN 1 WHEN 'LOSS' THEN 0 END AS label, o.settled_epoch
  FROM fo JOIN tr USING (key, rn) JOIN ba USING (key, rn) JOIN parts l USING (key, rn) JOIN outc o ON o.key = l.key AND o.bar_epoch = l.bar_epoch),
sn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY settled_epoch, bar_epoch) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM sx WHERE label IS NOT NULL AND settled_epoch IS NOT NULL),
sf AS (SELECT *, count(*) OVER g AS n_train, min(label) OVER g AS lo, max(label) OVER g AS hi FROM sn, range(2, 1000) r(c) WHERE c * {COHORT} <= n AND i < c * {COHORT} AND i >= c * {COHORT} - {MOST} WINDOW g AS (PARTITION BY key, c)),
sc AS (SELECT key, c, any_value(n_train) AS n_train, """
    + ", ".join(f"round(avg(x{i}), 12) AS m{i}, round(CASE WHEN stddev_pop(x{i}) > 1e-9::DOUBLE THEN stddev_pop(x{i}) ELSE 1 END, 12) AS d{i}" for i in (1, 2, 3))
    + """ FROM sf WHERE lo < hi GROUP BY key, c),
sz AS (SELECT key, c, label, 1::DOUBLE AS z0, (x1 - m1) / d1 AS z1, (x2 - m2) / d2 AS z2, (x3 - m3) / d3 AS z3 FROM sf JOIN sc USING (key, c))"""
    + newton_sql(3, NEWTON)
    + f""",
kn AS (SELECT x.key, x.bar_epoch, x1, x2, x3, (SELECT count(*) FROM sn WHERE sn.key = x.key AND sn.settled_epoch <= x.bar_epoch + 3600) AS n_known FROM sx x)
SELECT k.key, k.bar_epoch, n_known, n_known // {COHORT} AS cohort, coalesce(sc.n_train, 0) AS n_train, round(CASE WHEN w0 IS NULL THEN (x1 + x2 + x3) / 3
    ELSE {_sigmoid('w0 + w1 * (x1 - m1) / d1 + w2 * (x2 - m2) / d2 + w3 * (x3 - m3) / d3')} END + 1e-11::DOUBLE, 6) AS stacked,
  round((x1 + x2 + x3) / 3 * 0.6::DOUBLE + CASE WHEN w0 IS NULL THEN (x1 + x2 + x3) / 3 ELSE {_sigmoid('w0 + w1 * (x1 - m1) / d1 + w2 * (x2 - m2) / d2 + w3 * (x3 - m3) / d3')} END * 0.4::DOUBLE + 1e-11::DOUBLE, 6) AS fused
FROM kn k LEFT JOIN sc ON sc.key = k.key AND sc.c = n_known // {COHORT} LEFT JOIN wt{NEWTON} w ON w.key = k.key AND w.c = n_known // {COHORT}"""
)


@query("series_stack", STACK)
def series_stack(spark, sf):
    """The stack over out-of-fold member probabilities, refitted per series after every 25 settled signals, from the 50th on."""
    folded = cut_lineage(_fold_rows(spark, sf))
    models = cut_lineage(T.fold_models(folded, FEATURES, 16))
    named = [T.forest_probability(models, growth, N).select("key", "tf_sec", "bar_start", F.col("prob").alias(f"x{i}")) for i, growth in ((1, FOREST), (2, TREE))]
    bayes = Y.earlier_probability(folded, FEATURES, "fold").filter("fold > 0").select("key", "tf_sec", "bar_start", F.round("prob", 9).alias("x3"))
    on = ["key", "tf_sec", "bar_start"]
    label = F.when(F.col("outcome") == "WIN", 1).when(F.col("outcome") == "LOSS", 0)
    signals = S.outcomes(spark, sf).select(*on, label.alias("label"), "settled_at")
    rows = cut_lineage(named[0].join(named[1], on).join(bayes, on).join(signals, on).select(*on, F.array("x1", "x2", "x3").alias("x"), "label", "settled_at"))
    done = R.stacked_walk_forward(rows, 3, COHORT, LEAST, MOST, NEWTON)
    fused = J.fuse_stack(F.col("mean_prob"), F.col("stacked")).alias("fused")
    return done.select("key", epoch(), "n_known", "cohort", "n_train", "stacked", fused).select("key", "bar_epoch", "n_known", "cohort", "n_train", *rounded("stacked", "fused"))
