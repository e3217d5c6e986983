"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from barloom.llm import decontaminate, extract, language, lines, maxent, mixing, passages, rules, shards, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(5)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)] for x, letters in {"en": "abcdefgh", "fr": "éaeijklm", "de": "üßnopqrst"}.items()}
    rows = [(i, prose(rng, rng.randint(30, 160), words[x]), x, f"s{i % 4}", 1) for i, x in ((i, rng.choice(["en", "fr", "de"])) for i in range(90))]
    shared = prose(rng, 60, words["en"])
    rows += [(100 + i, prose(rng, 40, words["en"]) + " " + shared + "\n" + prose(rng, 40, words["en"]), "en", "s1", 1) for i in range(6)]
    rows += [(110 + i, rows[0][1], "en", "s2", 1) for i in range(5)] + [rows[3]] * 3
    rows += [(120, rows[1][1] + " extra", "en", None, 1), (121, None, None, None, None), (122, "", "en", "s0", 0), (None, "Only FEW words!", None, "s0", 1)]
    rows += [(123, "line one here\nline one here\n\n \nLINE", "en", "s3", 1), (124, prose(rng, 6000, words["fr"]), "fr", "s3", 1), (125, "12 34 !!", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, raw):
    # Columns of other names, and of the names that operators use themselves, must do no harm.
    from pyspark.sql import functions as F

    df = spark.createDataFrame(raw, SCHEMA).withColumns({"ledger": F.lit(1), "text_key": F.lit("x"), "size": F.lit(2.5), "kept_id": F.lit(3), "mix_size": F.lit(4), "extra": F.array(F.lit(1))})
    return df.repartition(3)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def words(text):
    return (text or "").encode().lower().split()


def test_rules(spark, docs, raw):
    ledger, name = rules.ledger(docs)
    assert name == "ledger_" and set(docs.columns) < set(ledger.columns)
    got = Counter((r.doc_id, r.text, tuple(r[name])[:5], r[name].fail_bits) for r in ledger.collect())
    want = Counter()
    for i, text, *_ in raw:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        seen = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, text, (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(seen) - len(set(seen)), len(hit))] += 1
    assert Counter(k[:3] for k in got.elements()) == want
    assert all((k[3] & 1) == (k[2][0] < 50) for k in got)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    counts = {r.rule: r for r in rules.ablations(ledger.select(f"{name}.*")).collect()}
    assert counts["few_words"].n_failed == sum(n for k, n in got.items() if k[3] & 1)
    assert kept.count() + sum(n for k, n in got.items() if k[3]) == len(raw)
    assert rules.ledger(docs.limit(0))[0].count() == 0


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards(docs, raw, n):
    got = sorted(rows_of(shards.shard_documents(docs, n)), key=lambda r: (r[4], r[5]))
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in raw)
    for k in range(n):
        assert [r[5] for r in got if r[4] == k] == list(range(sum(r[4] == k for r in got)))
    order = [(r[0] is not None, r[0] or 0) for r in got]
    assert order == sorted(order)
    at, total = 0, sum(r[1] for r in got)
    for r in got:
        assert r[4] == min(n - 1, (2 * at + r[1]) * n // (2 * total))
        at += r[1]
    assert {r[3] for r in got} == {"bytes"} and {r[6] for r in got} == {None}
    assert shards.shard_documents(docs.limit(0), n).count() == 0


def test_site_lines(spark):
    page = lambda *x: "".join(f"<p>{y}</p>" for y in x)
    rows = [(i, f"http://A.example/{i}", page("same <b>menu</b>", f"own {i}", "half" if i % 2 else "x" * i)) for i in range(10)]
    rows += [(20, "http://b.example", page("alone")), (21, None, page("same menu")), (22, "no url", None), (23, "http://b.example", "<script>var a='<p>x</p>'</script><p>t</p>")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = defaultdict(list)
    for r in lines.site_lines(df, 0.4, 3).collect():
        got[r.page_id].append((r.text, r.n_lines, r.n_dropped))
    assert got[1] == [("own 1", 3, 2)] and got[2] == [("own 2\nxx", 3, 1)] and len(got[0]) == 2
    assert got[20] == [("alone", 1, 0)] and got[21] == [("same menu", 1, 0)] and got[22] == [("", 0, 0)] and got[23] == [("t", 1, 0)]
    assert lines.site_lines(df.limit(0)).count() == 0


def test_decontamination(spark, docs, raw):
    item = " ".join(raw[90][1].split()[45:65]).upper()
    items = [("a", item), ("b", "xx " + item + " yy"), (None, "only few"), ("c", None), ("d", "..."), ("a", item), ("e", " ".join(raw[4][1].split()[:40]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[k : k + 13])].add(i or "")
    want = Counter()
    for i, t, *_ in raw:
        w, hit, found = split(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if (x := tuple(w[k : k + n])) in windows and len(x) == n:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want[i, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)] += 1
    assert Counter(rows_of(decontaminate.report(docs, bench))) == want
    assert sum(n for k, n in want.items() if k[5]) >= 6
    kept = decontaminate.keep(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[5])
    assert {r.n_hit for r in decontaminate.report(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    order = sorted(values)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if near(a, b):
                parent[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_simhash(docs, raw):
    fp = [brute_fingerprint(r[1]) for r in raw]
    root = groups(set(fp), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, *_), f in zip(raw, fp, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = Counter((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(raw, fp, strict=True))
    assert Counter(rows_of(simhash.component_ids(docs))) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.component_ids(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("m", "heavy"), [(2, 64), (3, 64), (3, 2), (2, 1)])
def test_links_lose_nothing(spark, m, heavy):
    rng = np.random.default_rng(m)
    near = [int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in rng.integers(0, 2**63, 4, dtype=np.uint64) for _ in range(40)]
    fps = {int(np.uint64(x).astype(np.int64)) for x in [*near, *rng.integers(0, 2**63, 100, dtype=np.uint64).tolist()]}
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), m, heavy)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = groups(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {v: got.get(v, v) for v in fps} == {v: min(x for x in fps if want[x] == want[v]) for v in fps}


def test_components_of_a_long_chain(spark):
    got = simhash.components(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(7, 7), (100, 101)], "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_mixture(docs, raw):
    rows = rows_of(mixing.mix_documents(docs))
    assert Counter(r[:2] for r in rows) == Counter((r[0], len(words(r[1]))) for r in raw)
    assert Counter(rows) == Counter(rows_of(mixing.mix_documents(docs.repartition(5))))
    assert all(t in (0, n, 2 * n) for _, n, _, _, t in rows)
    sizes = Counter()
    for r in raw:
        sizes[r[3]] += len(words(r[1]))
    target = mixing.targets(dict(sizes))
    assert math.isclose(sum(target.values()), 1.5 * sum(sizes.values())) and all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    for s in sizes:
        # All sources have different sizes here. Only whole documents are taken: off by half of the largest at most.
        mine = [r for r in rows if r[2] == sizes[s]]
        assert {r[3] for r in mine} == {target[s]} and abs(sum(r[4] for r in mine) - target[s]) <= max(r[1] for r in mine) / 2
    sample = mixing.sample(docs)
    assert sample.columns == docs.columns
    assert sum(len(words(r.text)) for r in sample.collect()) == sum(r[4] for r in rows)
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


def test_flow_of_overlapping_sources():
    flow = mixing.min_cost_flow({"A": 100, "B": 50, "AB": 60}, {"A": ("a",), "B": ("b",), "AB": ("a", "b")}, {"a": 120, "b": 120})
    into = Counter()
    for (p, s), n in flow.items():
        into[s] += n
    # 210 tokens serve 240: only 30 are repeated.
    assert into == {"a": 120, "b": 120} and sum(max(0, sum(n for (q, _), n in flow.items() if q == p) - t) for p, t in (("A", 100), ("B", 50), ("AB", 60))) == 30


def test_language(docs, raw):
    got = rows_of(language.language_of_documents(docs))
    truth = {r[0]: r for r in raw}
    assert Counter(r[0] for r in got) == Counter(r[0] for r in raw)
    for i, held, lang, score in got:
        assert held == (zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0) and 0 <= score <= 1
        if not any(c.isalpha() for c in truth[i][1] or ""):
            assert lang == "und" and score == 0
    held = [(truth[i][2], lang) for i, h, lang, _ in got if h and i is not None and i < 90]
    assert held and sum(a == b for a, b in held) / len(held) >= 0.95
    assert {r[2] for r in rows_of(language.language_of_documents(docs.withColumn("lang", docs["lang"].substr(0, 0)).filter("lang is null")))} <= {"und"}
    assert language.language_of_documents(docs.limit(0)).count() == 0


def test_cross_parsing_counts_longest_matches():
    sample = "abcabd abba cab abc dcba abab cd"
    parser = language.Parser({"x": sample})
    symbols = parser.symbols(sample).tolist()
    text = "abcd abba zz dab. cab! 99 ab"
    seq, at, want = parser.symbols(text).tolist(), 0, 0
    has = lambda part: any(symbols[k : k + len(part)] == part for k in range(len(symbols)))
    while at < len(seq):
        n = 1
        while at + n < len(seq) and has(seq[at : at + n + 1]):
            n += 1
        at, want = at + n, want + 1
    assert abs(parser.phrases([np.array(seq, np.uint8)])[0, 0] - want) <= 1


def test_language_model(docs, raw, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 150)
    tokens = lambda t: [*words(t), b""]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    counts = Counter(w for r in raw if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    got = rows_of(maxent.score_documents(docs))
    assert Counter(r[0] for r in got) == Counter(r[0] for r in raw)
    truth = {r[0]: r[1] for r in raw}
    for i, h, n_tokens, n_known, train, base, score in got:
        w = tokens(truth[i])
        want = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (h, n_tokens, n_known, train) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(base, want, rel_tol=1e-9) and score < 0
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])
    assert maxent.score_documents(docs.limit(0)).count() == 0


def test_words_of_decontamination_are_cut_once(spark):
    texts = ["Only ASCII Words, 12-x\x7f[\\]^_`{|}~@Z", "É MIXED İstanbul ǅ ß €Uro 𝒜B", "", None, " \t\n", "ABC" * 50 + "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    got = dict(docs.select("doc_id", decontaminate.words_of(docs["text"])).collect())
    assert got == {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or "")) for i, t in enumerate(texts)}
    items = spark.createDataFrame([("i", "only ascii words")], "item_id string, text string")
    made = decontaminate.report(docs, items)
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in made.collect()} == {i: (len(got[i]), 3 if i == 0 else 0) for i in got}


def test_language_model_learns_from_every_training_text(spark):
    # 600 documents of 9,000 have a word of their own; what stands after it can only be learnt from that document.
    rows = [(i, f"own{i} after" if i % 15 == 0 else None) for i in range(9_000)]
    model, _ = maxent.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))
    own = np.array([model.symbol[model.frequent[f"own{i}".encode()]] for i in range(0, 9_000, 15)])
    assert len(set(own.tolist())) == 600 and own.max() < maxent.HEAD
    history = np.stack([own, np.full(600, maxent.START), np.full(600, maxent.START)], axis=1)
    # The second feature: the word and the start before it.
    at = maxent.rows_for(maxent.features(history), maxent.CLASS_ROWS)[:, 1]
    assert model.weights["class"][at].any(axis=1).all()


def test_gradients_of_a_row_are_added_up():
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.integers(0, 40, (500, 4)), rng.integers(0, 1 << 16, (500, 4)), np.full((300, 4), 65_535)])
    gradient = rng.normal(size=(1_300, 5)).astype(np.float32)
    want = np.zeros((1 << 16, 5))
    np.add.at(want, at.ravel(), np.repeat(gradient, 4, axis=0))
    rows, total = maxent.added_up(at, gradient)
    assert rows.tolist() == np.unique(at).tolist()
    assert np.allclose(total, want[rows], atol=1e-3)


def test_language_model_is_a_distribution():
    words_ = [bytes([97 + k]) for k in range(20)] + [b""]
    n = np.arange(40, 19, -1)
    model = maxent.Model(int(n.sum()) + 30, 24, {w: k for k, w in enumerate(words_)}, n, np.arange(21), np.arange(21), np.array([30.0, *[0] * 7]), np.array([3.0, *[0] * 7]))
    rng = np.random.default_rng(0)
    for w in model.weights.values():
        w += rng.normal(0, 0.5, w.shape)
    history = np.array([[3, 1, 7]])
    logp = [maxent.forward(model, history, np.array([k]))["total"][0] for k in [*range(21), *range(maxent.HEAD, maxent.HEAD + 8)]]
    assert math.isclose(np.exp(logp).sum(), 1, rel_tol=1e-5)


def test_passages(docs, raw):
    got = rows_of(passages.repeated_passages(docs))
    found = {r[0] for r in got} | {r[4] for r in got}
    grams = defaultdict(set)
    for k, r in enumerate(raw):
        w = words(r[1])
        for i in range(len(w) - 49):
            grams[tuple(w[i : i + 50])].add(k)
    assert found == {raw[k][0] for s in grams.values() if len(s) > 1 for k in s}
    texts = {r[0]: (r[1] or "").encode() for r in raw}
    for i, start, size, n, j, there, its, similarity in got:
        a, b = texts[i][start : start + size].lower().split(), texts[j][there : there + its].lower().split()
        x, y = ({tuple(s[k : k + 5]) for k in range(len(s) - 4)} for s in (a, b))
        assert len(a) == n >= 50 and math.isclose(len(x & y) / len(x | y), similarity, rel_tol=1e-6) and similarity >= 0.8
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_self_closed_silent_elements_hide_nothing():
    for icon in ('<svg class="i"/>', '<script src="a.js"/>', '<iframe src="b"/>', "<svg><style/><svg/></svg>"):
        assert [b.text for b in extract.leaves(f"<body>{icon}<article><p>one two</p></article>{icon}<p>three</p></body>")] == ["one two", "three"]


def test_pages_that_name_their_main_part_by_class_are_learnt_from(spark):
    rows = [(1, "<div class='postContent'><p>a b</p></div>"), (2, '<div id="entry"><p>c</p></div>'), (3, "<div class=main_x><p>d</p></div>"), (4, '<div class="context"><p>e</p></div>'), (5, "<p>main</p>"), (6, "<main>f</main>")]
    assert {r[1] for r in rows if r[0] in (1, 2, 3, 6)} == set(extract.labelled_pages(spark.createDataFrame(rows, "page_id bigint, html string")))


def test_passage_is_found_behind_wording_that_many_texts_share(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    stock = fill(46)
    # All texts have the stock wording, only two each have what follows too.
    rows = [(i, " ".join([fill(70), stock, fill(70)])) for i in range(60)]
    rows += [(100 + 2 * k + j, " ".join([fill(70), passage, fill(70)])) for k in range(12) for passage in [stock + " " + fill(8)] for j in range(2)]
    got = rows_of(passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    assert {tuple(sorted((r[0], r[4]))) for r in got if r[3] >= 54} == {(100 + 2 * k, 101 + 2 * k) for k in range(12)}
    assert {r[0] for r in got} == {i for i, _ in rows if i >= 100}


def test_passage_repeated_in_a_text_has_a_row_for_each_place(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    rows = []
    for k in range(6):
        shared = fill(60)
        # Once the text with the repeat has the lesser key, once the other one.
        rows += [(2 * k, " ".join([fill(80), shared, fill(900), shared, fill(80)]), shared), (2 * k + 1, " ".join([fill(50), shared, fill(50)]), shared)]
    got = rows_of(passages.repeated_passages(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(2)))
    for i, text, shared in rows:
        want = {m.start() for m in re.finditer(shared, text)}
        assert {r[1] for r in got if r[0] == i} == want and len(want) == 1 + (i % 2 == 0)


def test_windows_of_equal_contents_are_not_told_apart_again(spark, monkeypatch):
    rng = random.Random(5)
    fill = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    shared = fill(2_000)
    df = spark.createDataFrame([(i, " ".join([fill(60), shared, fill(60)])) for i in range(24)], "doc_id bigint, text string").repartition(3)
    sent, closer = [], passages.closer_windows
    monkeypatch.setattr(passages, "closer_windows", lambda common: sent.append(common.selectExpr("sum(size(at))").first()[0]) or closer(common))
    assert {r[0] for r in rows_of(passages.repeated_passages(df)) if r[3] >= 2_000} == set(range(24))
    known = passages.met_by_value(passages.windows(df.selectExpr("xxhash64(text) AS key", "text"))).count()
    assert known > 24 * 200 and (sent[0] or 0) < known / 4


def test_no_shared_passage_is_missed_among_texts_of_common_pieces(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    pool = [fill(rng.randrange(15, 48)) for _ in range(12)]
    rows = [(i, " ".join(x for _ in range(4) for x in (fill(rng.randrange(1, 60)), *rng.choices(pool, k=rng.randrange(1, 3))))) for i in range(90)]
    got = rows_of(passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)))
    grams = defaultdict(set)
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    want = {i for s in grams.values() if len(s) > 1 for i in s}
    assert 10 < len(want) < 90 and want <= {r[0] for r in got}


def test_texts_of_a_batch_are_hashed_together(monkeypatch):
    class Rows:
        def mapInArrow(self, run, schema):
            return lambda batch: [r for out in run(iter([batch])) for r in out.to_pylist()]

    rng = random.Random(8)
    fill = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    pool = [fill(60) for _ in range(3)]
    texts = [" ".join([fill(rng.randrange(1, 40)), pool[k % 3], fill(3), pool[(k + 1) % 3], fill(20)]) for k in range(40)]
    sides = list(zip(texts, [*texts[1:], ""], strict=True))
    spans = [passages.similar_spans(a.encode(), b.encode()) for a, b in sides]
    calls, hashes = [], passages.shingle_hashes
    monkeypatch.setattr(passages, "shingle_hashes", lambda words: calls.append(len(words)) or hashes(words))

    regions = [{"key": k, "rk": k + 1, "l": 7 * k, "rl": 5 * k, "a": a.encode(), "b": b.encode()} for k, (a, b) in enumerate(sides)]
    got = [tuple(r.values()) for r in passages.verified(Rows())(pa.RecordBatch.from_pylist(regions))]
    want = [(k, k + 1, 7 * k + s[0], 7 * k + s[1], s[4], 5 * k + s[2], 5 * k + s[3], s[5]) for k, x in enumerate(spans) for s in x]
    assert got == want and {r[0] for r in got} == set(range(39)) and len(calls) == 2

    found = passages.windows(Rows())(pa.RecordBatch.from_pylist([{"key": k, "text": x} for k, x in enumerate(texts)]))
    common = [{"key": k, "text": x.encode(), "at": [{c: r[c] for c in "vclr"} for r in found if r["key"] == k]} for k, x in enumerate(texts)]
    calls.clear()
    closer = lambda rows: sorted(tuple(r[c] for c in ("whole", "v", "key", "c", "l", "r")) for r in passages.closer_windows(Rows())(pa.RecordBatch.from_pylist(rows)))
    together = closer(common)
    assert len(calls) == 1
    assert together == sorted(r for x in common for r in closer([x])) and {r[2] for r in together if r[0]} == set(range(40))


def test_words_of_texts_are_counted(spark):
    rows = [(1, "a  b\tc"), (2, ""), (None, " x\n"), (3, "é\u00a0y z" * 99_999)]
    got = passages.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(text) AS key", "text"))
    assert {(r[0], r[2]) for r in got.collect()} == {(i, len(words(text))) for i, text in rows}


def test_compact_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes, least = rng.integers(1, 40, 5), int(rng.integers(2, 12))
        ends = np.cumsum(sizes)
        h = rng.integers(1, 30, ends[-1]).astype(np.uint64)
        want = set()

        def node(a, b, h=h, least=least, want=want):
            if b - a >= least:
                c = a + int(np.argmin(h[a:b]))
                want.add((c, a, b - 1))
                node(a, c)
                node(c + 1, b)

        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            node(int(a), int(b))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(h, ends, least)), strict=True)) == want


def test_near_passage_is_found_and_edges_are_exact():
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    other = [*w[:60], "changed", *w[61:]]
    a, b = " ".join(["x1", "x2", *w]).encode(), " ".join([*other, "y"]).encode()
    ((start, stop, _, _, n, similarity),) = passages.similar_spans(a, b)
    assert a[start:stop].decode().split() == w and n == 120 and similarity >= 0.9
    assert passages.similar_spans(a, b"nothing in common " * 40) == []


PAGE = "<html><head><title>t</title><script>var x='</p>'</script></head><body><nav><ul><li><a href=a>home</a></li></ul></nav><div class=ad>Buy {n} now</div><article><h1>Head {n}</h1><p>First para {n} of the text&amp;more.<br>same block<p><b>Second</b> para,   with\nspace.</p></article><footer>&copy; me {n}</footer></body></html>"


def test_extraction(spark):
    rows = [(i, f"u{i}", PAGE.replace("{n}", str(i))) for i in range(40)] + [(50, None, None), (51, "x", ""), (None, "y", "<p>bro<ken"), (1, "u1", PAGE.replace("{n}", "1"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", extract.F.lit("clash"))
    got = extract.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in range(40):
        assert text[i] == f"Head {i}\nFirst para {i} of the text&more. same block\nSecond para, with space."
    assert text[50] == text[51] == ""
    assert extract.main_text(df.limit(0)).count() == 0


def test_viterbi_is_the_best_labelling():
    rng, field = np.random.default_rng(3), extract.Field()
    field.weights[:40], field.pairs, field.start = rng.normal(0, 1, (40, 2)), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    rows = [rng.integers(0, 40, 3).tolist() for _ in range(7)]
    s = field.scores(rows)
    value = lambda y: field.start[y[0]] + sum(s[k, y[k]] for k in range(7)) + sum(field.pairs[y[k], y[k + 1]] for k in range(6))
    best = max(([c >> k & 1 for k in range(7)] for c in range(128)), key=value)
    assert field.decode(rows).tolist() == best
