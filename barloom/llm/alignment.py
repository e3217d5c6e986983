"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids are linked in the corpus."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import pieces, raw_texts
from barloom.session import cut_lineage

#: Folder of the vocabulary files on the driver; tasks get the files' bytes, a few MB whatever the corpus.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Fixed value: the pattern that cuts a text before the merges of a byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Most frequent id pairs whose counts every task holds; all others meet their counts in a join.
FREQUENT = 1 << 18

#: Pairs of a task that are counted together, and links of one group above which its ids are counted before they are paired.
HELD_PAIRS, LARGE_GROUP = 4_000_000, 1_000_000

_DECIMAL = [str(i) for i in range(1 << 16)]

Encode = Callable[[list[str]], list[list[int]]]


# Tokenizers


def byte_letters() -> dict[str, int]:
    """Letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_level(raw: bytes) -> tuple[Encode, list[bytes], bool]:
    """Encoder of whole texts, bytes of each id, and whether they always join to the text, from a byte-level vocabulary's JSON.

    Special tokens are plain text. Where the merges are ranked as their results' ids are, and texts are cut by the usual pattern,
    the same ids come from the ranks alone, which is four times as fast and only ever cuts the text's own bytes; else from the
    general encoder.
    """
    spec, letters = json.loads(raw), byte_letters()
    vocabulary = spec["model"]["vocab"]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in entry): i for entry, i in vocabulary.items() if entry not in special}
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for x, i in ranks.items():
        table[i] = x
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    cut = spec["pre_tokenizer"]
    if merged == sorted(merged) and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not spec["normalizer"]:
        quick = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [quick.encode_ordinary(t) for t in texts], table, True
    general = tokenizers.Tokenizer.from_str(raw.decode())
    general.encode_special_tokens = True
    return lambda texts: [e.ids for e in general.encode_batch(texts, add_special_tokens=False)], table, False


@lru_cache(maxsize=4)
def piece_level(raw: bytes) -> tuple[Encode, list[bytes]]:
    """Encoder of whole texts and bytes of each id of a model of pieces with byte fallback."""
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), table


# Groups


def groups(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of the groups in both id lists: the places where a token of each ends at the same byte."""
    at_a = dict(zip(size_a[a].cumsum().tolist(), range(1, len(a) + 1), strict=True))
    at_b = dict(zip(size_b[b].cumsum().tolist(), range(1, len(b) + 1), strict=True))
    common = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, common)), list(map(at_b.__getitem__, common))


def listing(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> str:
    """The groups as text: `a1,a2|b1;a3|b2,b3`."""

    def side(ids: list[int], ends: list[int]) -> list[str]:
        names = list(map(_DECIMAL.__getitem__, ids))
        return [names[p] if q == p + 1 else ",".join(names[p:q]) for p, q in zip([0, *ends], ends, strict=False)]

    return ";".join(map("|".join, zip(side(a, ends_a), side(b, ends_b), strict=True)))


def links(x: np.ndarray, y: np.ndarray, ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (A id * 65536 + B id) that the groups link, in order, and how often each is linked."""
    end_a, end_b = np.array(ends_a, np.int64), np.array(ends_b, np.int64)
    start_a, start_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
    n_a, n_b = end_a - start_a, end_b - start_b
    small = n_a * n_b <= LARGE_GROUP
    found, times = [], []
    for g in np.flatnonzero(~small):
        (va, ca), (vb, cb) = (np.unique(v[s:e], return_counts=True) for v, s, e in ((x, start_a[g], end_a[g]), (y, start_b[g], end_b[g])))
        found.append((va[:, None] << np.uint32(16) | vb).ravel())
        times.append(np.outer(ca, cb).ravel())
    single = (n_a == 1) & (n_b == 1)
    found_one = x[start_a[single]] << np.uint32(16) | y[start_b[single]]
    small &= ~single
    start_a, start_b, n_b, many = start_a[small], start_b[small], n_b[small], (n_a * n_b)[small]
    group = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    pair = x[start_a[group] + place // n_b[group]] << np.uint32(16) | y[start_b[group] + place % n_b[group]]
    value, count = np.unique(np.concatenate([found_one, pair]), return_counts=True)
    if not found:
        return value, count
    value, at = np.unique(np.concatenate([value, *found]), return_inverse=True)
    total = np.zeros(len(value), np.int64)
    np.add.at(total, at, np.concatenate([count, *times]))
    return value, total


_ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, raw_a: bytes, raw_b: bytes) -> DataFrame:
    """Tokens, groups and links of every document (doc_id, text), its distinct id pairs and their times as packed numbers.

    Each text is encoded once. `row` tells rows apart, also those that repeat.
    """
    files = docs.sparkSession.sparkContext.broadcast((raw_a, raw_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, bytes_a, exact_a = byte_level(files.value[0])
        encode_b, bytes_b = piece_level(files.value[1])
        if max(len(bytes_a), len(bytes_b)) > 1 << 16:
            raise ValueError("an id must fit in 16 bits")
        size_a, size_b = (np.array([len(x) for x in table], np.int64) for table in (bytes_a, bytes_b))
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text", 1_000_000):
            raw = raw_texts(batch.column("text"))
            texts = [x.decode() for x in raw]
            out = []
            for text, a, b in zip(raw, encode_a([" " + t for t in texts]), encode_b(texts), strict=True):
                whole = b" " + text
                if not text or b"".join(map(bytes_b.__getitem__, b)) != whole or not (exact_a or b"".join(map(bytes_a.__getitem__, a)) == whole):
                    out.append((0, 0, 0, 0, "", b"", b""))
                    continue
                x, y = np.array(a, np.uint32), np.array(b, np.uint32)
                ends = groups(x, y, size_a, size_b)
                pair, times = links(x, y, *ends)
                digest = sha256(listing(a, b, *ends).encode()).hexdigest()
                out.append((len(a), len(b), len(ends[0]), int(times.sum()), digest, pair.tobytes(), times.astype("<u4").tobytes()))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(raw))), batch.column("doc_id"), *columns], [f.split()[0] for f in _ALIGNED.split(", ")])
            row += len(raw)

    return docs.mapInArrow(run, _ALIGNED)


# Counts over the corpus


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of the same A id has a higher n) of all pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for raw in batch.column("pairs").to_pylist():
                held.append(np.frombuffer(raw, np.uint32))
                size += len(held[-1])
                if size > HELD_PAIRS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = rows.select("pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", 16)))  # no A id has more pairs than B has ids
    return counts.withColumn("best", F.col("n") == highest)


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, n and best, in order, of the pairs of the highest counts: all of a step of counts, at most `most` in all."""
    step = F.floor(8 * F.log2("n")).alias("step")
    sizes = sorted(((r["step"], r["size"]) for r in counts.groupBy(step).agg(F.count(F.lit(1)).alias("size")).collect()), reverse=True)  # under 512 rows
    total, last = 0, None
    for at, size in sizes:
        if (total := total + size) > most:
            break
        last = at
    rows = counts.filter(F.floor(8 * F.log2("n")) >= last) if last is not None else counts.limit(0)
    table = rows.orderBy("pair").toArrow()
    pair, n = (table.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    return pair.astype(np.uint32), n, np.array(table.column("best").to_pylist(), bool)


def align(docs: DataFrame, raw_a: bytes, raw_b: bytes, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    A null or empty text, and one whose token bytes of either side are not a space and the text, has no tokens: zeros and an
    empty digest; it counts nowhere. Repeated rows are counted and returned each. Ties of a highest count are all best. A very
    long text is encoded as one, in memory of its task that grows with it (some 200 bytes a token). An empty table gives no
    rows. Only doc_id and text are read.

    Counts of frequent pairs are looked up in the task; a document's other pairs meet theirs in a join, so the result is exact
    whatever the bound.
    """
    rows = cut_lineage(aligned(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), raw_a, raw_b))
    counts = cut_lineage(pair_counts(rows))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pairs(counts, most))

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of a batch, their times and rows, which of them are frequent, and their places in that table."""
        raw = batch.column("pairs").to_pylist()
        pair = np.frombuffer(b"".join(raw), np.uint32)
        times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
        known = shared.value[0]
        place = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        return pair, times, row, (known[place] == pair if len(known) else np.zeros(len(pair), bool)), place

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "pairs"):
            _, times, row, hit, place = flat(batch)
            total, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row[hit], times[hit] * shared.value[1][place[hit]])
            np.add.at(best, row[hit], times[hit] * shared.value[2][place[hit]])
            kept = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(best), pa.array(total)], [*kept.schema.names, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "pairs"):
            pair, times, row, hit, _ = flat(batch)
            if not hit.all():
                own = batch.column("row").to_numpy()[row[~hit]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(pair[~hit].astype(np.int64)), pa.array(times[~hit])], ["row", "pair", "times"])

    schema = _ALIGNED.removesuffix(", pairs binary, times binary") + ", n_best bigint, count_sum bigint"
    own = rows.mapInArrow(sums, schema)
    rare = rows.select("row", "pairs", "times").mapInArrow(others, "row bigint, pair bigint, times bigint").join(counts, "pair")
    added = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    none = F.lit(0)
    return own.join(added, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", none)).alias("count_sum"), "groups_sha256",
    )


def align_documents(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """`align` with the two vocabulary files of a folder of the driver."""
    raw = []
    for name in (FILE_A, FILE_B):
        with open(f"{folder}/{name}", "rb") as file:
            raw.append(file.read())
    return align(docs, *raw)
