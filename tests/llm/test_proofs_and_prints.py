"""Merkle manifest, fingerprints and tokenizer alignment against brute force, on nulls, empty and long texts, ties and repeats."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import alignment, fingerprints, merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(rng.randint(1, 120)), "en", f"s{i % 3}", i) for i in range(0, 400, 3)]
    rows += [(500 + i, prose(30) + "\n" + prose(5) + "\n", "fr", "größe" if i % 2 else "s0", 7) for i in range(30)]
    rows += [rows[5]] * 4 + [(600 + 50 * i, rows[8][1], "en", "s1", 1) for i in range(4)]
    rows += [(700, None, None, None, None), (701, "", "", "", 0), (702, "One", "en", "lone", 3), (703, prose(5000), "de", "s2", 9), (704, " \n ", "x", "s1", 2)]
    rows += [(None, "no id\nhere", "en", "s1", None), (None, "no id", None, None, 1), (-5, "a b", "en", "s1", 1), (-5, "a c", "en", "s1", 1)]
    rows += [(705, "▁ mark", "en", "s1", 1), (706, "日本語 text 👨‍👩‍👧 <|endoftext|> <s>", "ja", "s1", 1), (707, "  double  spaces\t\ttabs\n\n", "en", "s1", 1), (708, "x" * 3000, "en", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, raw):
    # Columns of the names that the operators use themselves must do no harm.
    extra = {c: F.lit(1) for c in ("path", "root", "leaf", "place", "cell", "pairs", "row", "held", "n_near")}
    return spark.createDataFrame(raw, SCHEMA).withColumns(extra).repartition(3)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    i, _, lang, source, n = row
    return h("".join(map(field, (i, source, lang, n, text))))


def tree(nodes):
    """Top of a tree and each leaf's steps (left, right)."""
    paths, own, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], nodes
    while len(level) > 1:
        runs = [(level[k : k + 3], own[k : k + 3]) for k in range(0, len(level), 3)]
        for run, members in runs:
            for j, leaves in enumerate(members):
                for x in leaves:
                    paths[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
        level, own = [h("".join(run)) for run, _ in runs], [sum(m, []) for _, m in runs]
    return level[0], paths


def proofs(raw):
    groups = defaultdict(list)
    for row in raw:
        groups[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        made[s] = tree([x[2] for x in groups[s]])
    root, tops = tree([made[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops, strict=True):
        for (_, _, own, row), path in zip(groups[s], made[s][1], strict=True):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for a, b in path + top:
                node = h(a + node + b)
            out[row[0], own, made[s][0], root, h("".join(a + b for a, b in path + top)), node, node == root] += 1
    return out


@pytest.mark.parametrize("digits", [1, 2, 5])
def test_merkle(docs, raw, digits, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 3**digits)
    got = Counter(map(tuple, merkle.verify_documents(docs).collect()))
    assert got == proofs(raw)
    assert 0 < sum(n for k, n in got.items() if not k[-1]) < len(raw)


def test_merkle_edges(spark, docs, raw):
    assert merkle.verify_documents(docs.limit(0)).count() == 0
    one = [(4, "a\nb", "en", "s", 3)]
    assert Counter(map(tuple, merkle.verify_documents(spark.createDataFrame(one, SCHEMA)).collect())) == proofs(one)
    kept = merkle.manifest(docs.withColumn("leaf", F.sha2(F.coalesce("text", F.lit("")), 256)), "leaf", "source", ["doc_id"])
    assert kept.columns == [*docs.columns, "path_", "subroot", "root_"] and kept.count() == len(raw)


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    terms = words if len(words) < 2 else [f"{a} {b}" for a, b in zip(words, words[1:])]
    hashes = [int(hashlib.md5(t.encode()).hexdigest(), 16) for t in terms]
    return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_fingerprints(docs, raw):
    rows = sorted(((i, t or "") for i, t, *_ in raw), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    prints = [print_of(t) for _, t in rows]
    want = Counter()
    for k, (i, text) in enumerate(rows):
        after = (k + 1) % len(rows)
        cut = len(text) // 2
        edit = text[: len(text) - cut] + rows[after][1][:cut]
        own, new = prints[k], print_of(edit)
        near = sum((own ^ x).bit_count() <= 3 for x in prints) - 1 if i is not None and i % 50 == 0 else -1
        like = lambda x, own=own: 1 - (own ^ x).bit_count() / 128
        want[i, len(text), h(edit), f"{own:032x}", f"{new:032x}", like(new), like(prints[after]), near] += 1
    assert Counter(map(tuple, fingerprints.likeness_of_documents(docs).collect())) == want
    assert any(k[-1] >= 3 for k in want)
    assert fingerprints.likeness_of_documents(docs.limit(0)).count() == 0
    one = fingerprints.likeness_of_documents(docs.filter("doc_id = 702")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize(("radius", "blocks"), [(0, 2), (3, 4), (5, 8), (6, 8)])
def test_block_tables_lose_nothing(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(20)]
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(128, n, replace=False))
    values = sorted({flip(b, n) for b in base for n in range(8)} | {0, (1 << 128) - 1})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    index = spark.createDataFrame([(signed(v >> 64), signed(v & (1 << 64) - 1)) for v in values], "high bigint, low bigint")
    asked = values[::3]
    ask = spark.createDataFrame([(signed(v >> 64), signed(v & (1 << 64) - 1)) for v in asked], "high bigint, low bigint")
    joined = lambda a, b: ((a % (1 << 64)) << 64) | (b % (1 << 64))
    got = [(joined(r[0], r[1]), joined(r[2], r[3])) for r in fingerprints.near(ask, index, radius, blocks).collect()]
    assert sorted(got) == sorted((q, v) for q in asked for v in values if (q ^ v).bit_count() <= radius)


def test_results_agree_with_sql(spark, samples):
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{samples}/documents.parquet'")
        for name in ("op6_rules", "op11_merkle", "op12_fingerprints"):
            got = queries.QUERIES[name](spark, samples)
            want = con.execute(queries.ORACLES[name])
            names = [c[0] for c in want.description]
            assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())


@pytest.fixture(scope="module")
def files():
    if not os.path.isdir(alignment.FOLDER):
        pytest.skip("vocabulary files are not here")
    return [open(f"{alignment.FOLDER}/{name}", "rb").read() for name in (alignment.FILE_A, alignment.FILE_B)]


def slow_alignment(raw, files):
    """Groups by walking both token lists, counts from sets."""
    import sentencepiece
    import tokenizers

    own = tokenizers.Tokenizer.from_str(files[0].decode())
    own.encode_special_tokens = True
    other = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    letters = alignment.byte_letters()
    made, counts = [], Counter()
    for i, text, *_ in raw:
        a, b = (own.encode(" " + text, add_special_tokens=False).ids, other.encode(text)) if text else ([], [])
        bytes_a = [bytes(letters[c] for c in own.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(other.id_to_piece(x)[3:5], 16)]) if other.is_byte(x) else other.id_to_piece(x).replace("▁", " ").encode() for x in b]
        groups, p, q, left, right, at_a, at_b = [], 0, 0, [], [], 0, 0
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            while p < len(a) or q < len(b):
                if at_a <= at_b:
                    left, at_a, p = [*left, a[p]], at_a + len(bytes_a[p]), p + 1
                else:
                    right, at_b, q = [*right, b[q]], at_b + len(bytes_b[q]), q + 1
                if at_a == at_b and right:
                    groups, left, right = [*groups, (left, right)], [], []
        linked = Counter((x, y) for g, k in groups for x in g for y in k)
        counts.update(linked.keys())
        made.append((i, a if groups else [], b if groups else [], groups, linked))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    listed = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, k)) for g, k in groups)
    return Counter(
        (i, len(a), len(b), len(g), sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()), h(listed(g)) if g else "")
        for i, a, b, g, c in made
    )


@pytest.mark.parametrize("most", [1 << 18, 50, 0])
def test_alignment(docs, raw, files, most, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 1000)
    want = slow_alignment(raw, files)
    got = alignment.align(docs, *files, most=most)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n for k, n in want.items() if k[1] == 0) == 3  # null, empty, a mark that decodes as a space
    assert alignment.align(docs.limit(0), *files).count() == 0


def test_large_groups_are_linked_alike(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 60, dtype=np.uint32), rng.integers(0, 9, 60, dtype=np.uint32)
    ends = [1, 5, 30, 31, 60], [2, 3, 40, 45, 60]
    want = alignment.links(a, b, *ends)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 8)
    got = alignment.links(a, b, *ends)
    assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True)) and want[1].sum() == 2 + 4 * 1 + 25 * 37 + 5 + 29 * 15


def test_quick_and_general_encoders_agree(files):
    """The ranks alone give the general encoder's ids: around code points of all planes, and on random text."""
    import json

    spec = json.loads(files[0])
    assert spec["pre_tokenizer"]["type"] == "ByteLevel"
    quick, _, exact = alignment.byte_level(files[0])
    spec["model"]["merges"] = spec["model"]["merges"][1:] + spec["model"]["merges"][:1]  # no longer in order: the general one
    general, _, guess = alignment.byte_level(json.dumps(spec).encode())
    assert exact and not guess and general([" a"]) == quick([" a"])
    import tokenizers

    whole = tokenizers.Tokenizer.from_str(files[0].decode())
    whole.encode_special_tokens = True
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}  {chr(c)}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    rng = random.Random(1)
    letters = "aAbeotinrs  \n\t.,'s<|endoftext|>0129éü中文😀"
    texts += ["".join(rng.choice(letters) for _ in range(200)) for _ in range(500)]
    assert quick(texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
