"""Language-model scores: a hashed maximum-entropy model over n-gram and skip features with a class-factored softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bucket_of, pieces, raw_texts
from barloom.session import cut_lineage, shuffles_deleted

#: Words of a class and classes of words that are predicted one by one; classes of all other words.
SLOTS, HEAD_CLASSES, TAIL_CLASSES = 32, 31, 8
CLASSES = HEAD_CLASSES + TAIL_CLASSES
HEAD = SLOTS * HEAD_CLASSES

#: Rows of the hashed weights for classes and for words of a class.
CLASS_ROWS, WORD_ROWS = 1 << 15, 1 << 16

#: Tokens whose counts every executor holds (the most frequent); all others meet their counts in a join.
FREQUENT = 1 << 18

#: Rounds, which share all training documents; least workers of a round, documents of a worker from which on there are more
#: workers; step, and tokens in a step.
ROUNDS, WORKERS, WORKER_DOCS, STEP, STEP_TOKENS = 4, 8, 6_400, 0.15, 2_048

#: Entries of a task's counts before they are handed on, and tokens in a batch of the model.
HELD_TOKENS, BATCH = 400_000, 8_192

CHUNK = 2_048
END = b""
START = HEAD + TAIL_CLASSES
_LN10 = np.log(10.0)


def tail_class(token: bytes) -> int:
    """Class of a token that is not predicted by itself: by its last letter or its first letter beyond ASCII."""
    if token.isascii():
        return 0 if token[-1:].isalnum() else 1
    at = next(i for i, c in enumerate(token) if c > 127)
    return 2 + (token[at] * 256 + token[at + 1]) % (TAIL_CLASSES - 2)


def token_counts(texts: DataFrame) -> DataFrame:
    """token (binary), tail and n of all texts; words cut at ASCII white space, A-Z in lower case, then one end each.

    Tasks add up before they hand on, a bounded number of tokens at a time.
    """

    def out(counts: Counter) -> pa.RecordBatch:
        tokens = list(counts)
        tails = [tail_class(t) for t in tokens]
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(tails, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["token", "tail", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches, "text"):
            for text in raw_texts(batch.column("text")):
                counts.update(text.lower().split())
            counts[END] += batch.num_rows
            if len(counts) > HELD_TOKENS:
                yield out(counts)
                counts.clear()
        if counts:
            yield out(counts)

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "token binary, tail int, n bigint")
    return parts.groupBy("token", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What scoring needs of the training tokens, and the weights."""

    n: int
    v: int
    frequent: dict[bytes, int]  # token: its place in counts
    counts: np.ndarray
    head: np.ndarray  # place in the head vocabulary, or -1
    symbol: np.ndarray  # head place, or HEAD + tail class
    tail_n: np.ndarray
    tail_v: np.ndarray
    class_bias: np.ndarray = field(init=False)
    word_bias: np.ndarray = field(init=False)
    weights: dict[str, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        words = np.zeros(HEAD)
        listed = self.head >= 0
        words[self.head[listed]] = self.counts[listed]
        word_n = words.reshape(HEAD_CLASSES, SLOTS)
        with np.errstate(divide="ignore"):
            # A class or slot without words gets no probability; a tail class always has some left for new words.
            self.word_bias = np.log(word_n).astype(np.float32)
            self.class_bias = np.log(np.concatenate([word_n.sum(axis=1), self.tail_n + 0.5 * (self.tail_v + 1)])).astype(np.float32)
        self.weights = {"class": np.zeros((CLASS_ROWS, CLASSES), np.float32), "word": np.zeros((WORD_ROWS, SLOTS), np.float32)}

    def tail_norm(self) -> np.ndarray:
        return np.log10(self.tail_n + 0.5 * (self.tail_v + 1))


def features(history: np.ndarray) -> np.ndarray:
    """Hashes of the features of each history (columns: the last three symbols, latest first), before they are folded.

    The last symbol, the last two, and the second and third last by themselves (skips).
    """
    a, b, c = (history[:, k].astype(np.uint64) for k in range(3))
    base = np.uint64(START + 1)
    raw = np.stack([a, base + a * base + b, np.uint64(2_000_000) + b, np.uint64(3_000_000) + c], axis=1)
    raw = raw * np.uint64(0x9E3779B97F4A7C15)
    return raw ^ (raw >> np.uint64(29))


def rows_for(hashed: np.ndarray, rows: int, salt: np.ndarray | int = 0) -> np.ndarray:
    mixed = (hashed + np.asarray(salt, np.uint64)[..., None]) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(rows)).astype(np.int64)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def summed(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows of a table that each row of `at` names."""
    total = table.take(at[:, 0], axis=0)
    for k in range(1, at.shape[1]):
        total += table.take(at[:, k], axis=0)
    return total


def forward(model: Model, history: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Log probabilities of the classes, of the wanted head words within their class, and what a gradient needs."""
    hashed = features(history)
    class_of = np.where(wanted < HEAD, wanted // SLOTS, HEAD_CLASSES + wanted - HEAD)
    class_at = rows_for(hashed, CLASS_ROWS)
    logp = log_softmax(summed(model.weights["class"], class_at) + model.class_bias)
    heads = np.flatnonzero(wanted < HEAD)
    word_at = rows_for(hashed[heads], WORD_ROWS, class_of[heads] + 1)
    word_logp = log_softmax(summed(model.weights["word"], word_at) + model.word_bias[class_of[heads]]) if len(heads) else np.zeros((0, SLOTS))
    total = logp[np.arange(len(wanted)), class_of].astype(np.float64)
    total[heads] += word_logp[np.arange(len(heads)), wanted[heads] % SLOTS]
    return {"total": total, "class_of": class_of, "class_at": class_at, "class_logp": logp, "heads": heads, "word_at": word_at, "word_logp": word_logp}


def histories(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Histories and wanted symbols of all places of some texts; three starts stand before a text."""
    padded = np.concatenate([np.concatenate([np.full(3, START), s]) for s in symbols])
    at = np.flatnonzero(np.concatenate([np.concatenate([np.zeros(3, bool), np.ones(len(s), bool)]) for s in symbols]))
    return np.stack([padded[at - 1], padded[at - 2], padded[at - 3]], axis=1), padded[at]


def symbols_of(model: Model, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place among the frequent tokens (-1: not one) and symbol of each token."""
    place = np.fromiter(map(model.frequent.get, tokens, repeat(-1)), np.int64, len(tokens))
    symbol = model.symbol[place] if len(model.symbol) else np.zeros(len(tokens), np.int64)
    rare = np.flatnonzero(place < 0)
    symbol[rare] = [HEAD + tail_class(tokens[i]) for i in rare.tolist()]
    return place, symbol


# Training


def prepare(counts: DataFrame) -> Model:
    """Totals, the frequent tokens with their counts, and the head vocabulary, from the counted tokens.

    How many tokens have a count is summed first, by steps of a quarter of a power of two. That gives the least count with
    no more than FREQUENT tokens at or above it, so what the driver collects is bounded, whatever the vocabulary.
    """
    step = F.floor(4 * F.log2("n")).alias("step")
    found = counts.groupBy(step).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    left, least = FREQUENT, None
    for r in sorted(found, key=lambda r: -r["least"]):
        left -= r["tokens"]
        if left < 0:
            break
        least = r["least"]
    # Where even the most frequent step has too many tokens, none is held and all go to the join.
    rows = counts.filter(F.col("n") >= least).select("token", "tail", "n").collect() if least is not None else []
    rows = sorted(((bytes(r["token"]), r["tail"], r["n"]) for r in rows), key=lambda r: (-r[2], r[0]))
    head = np.full(len(rows), -1)
    head[: min(HEAD, len(rows))] = np.arange(min(HEAD, len(rows)))
    tail = np.array([r[1] for r in rows], np.int64)
    n = np.array([r[2] for r in rows], np.int64)
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in tails:
        tail_n[r["tail"]], tail_v[r["tail"]] = r["n"], r["v"]
    inside = tail[head >= 0]
    tail_n -= np.bincount(inside, n[head >= 0], TAIL_CLASSES)
    tail_v -= np.bincount(inside, minlength=TAIL_CLASSES)
    return Model(
        sum(r["n"] for r in found), sum(r["tokens"] for r in found), {r[0]: i for i, r in enumerate(rows)}, n, head,
        np.where(head >= 0, head, HEAD + tail), tail_n, tail_v,
    )


#: Places of a row that are added one by one in `added_up`; all further ones go in one sweep.
FEW = 6


def added_up(at: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that `at` names, each once, and of each the sum of the gradients that name it.

    at: for each gradient the rows it goes to, below 2^16. Most rows are named a few times: their gradients are added rank by
    rank for all rows at once. What is left of the others lies together once sorted and is added in one sweep.
    """
    flat = at.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    listed, order = flat[order], order // at.shape[1]
    first = np.flatnonzero(np.concatenate([[True], listed[1:] != listed[:-1]]))
    times = np.diff(first, append=len(flat))
    total = gradient.take(order[first], axis=0)
    for k in range(1, FEW):
        some = np.flatnonzero(times > k)
        total[some] = total.take(some, axis=0) + gradient.take(order[first[some] + k], axis=0)
    many = np.flatnonzero(times > FEW)
    if len(many):
        left = times[many] - FEW
        starts = np.cumsum(left) - left
        rest = np.arange(left.sum()) + np.repeat(first[many] + FEW - starts, left)
        total[many] += np.add.reduceat(gradient.take(order[rest], axis=0), starts, axis=0)
    return listed[first].astype(np.int64), total


def descend(model: Model, texts: Iterator[bytes]) -> dict[str, np.ndarray]:
    """The changes of the weights after one pass of gradient steps over some texts."""
    start = {k: w.copy() for k, w in model.weights.items()}
    power = {k: np.full(len(w), 1e-2, np.float32) for k, w in model.weights.items()}

    def move(table: str, at: np.ndarray, gradient: np.ndarray) -> None:
        rows, total = added_up(at, gradient)
        now = power[table][rows] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        power[table][rows] = now
        total *= (STEP / np.sqrt(now))[:, None]
        model.weights[table][rows] = model.weights[table].take(rows, axis=0) - total

    def batch(texts: list[bytes]) -> None:
        history, wanted = histories([symbols_of(model, [*t.lower().split(), END])[1] for t in texts])
        for k in range(0, len(wanted), STEP_TOKENS):
            got = forward(model, history[k : k + STEP_TOKENS], wanted[k : k + STEP_TOKENS])
            p = np.exp(got["class_logp"])
            p[np.arange(len(p)), got["class_of"]] -= 1
            move("class", got["class_at"], p)
            heads = got["heads"]
            if len(heads):
                q = np.exp(got["word_logp"])
                q[np.arange(len(q)), wanted[k : k + STEP_TOKENS][heads] % SLOTS] -= 1
                move("word", got["word_at"], q)

    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size > 200_000:
            batch(held)
            held, size = [], 0
    if held:
        batch(held)
    return {k: model.weights[k] - start[k] for k in start}


def train(model: Model, docs: DataFrame, n_docs: int) -> Model:
    """Rounds of gradient steps on all workers at once; each row of weights moves by the mean of those who changed it.

    Every text of docs is read in one of the rounds, by a hash of its id and words; a null text is an empty one.

    Workers send their changes in chunks of rows, which Spark adds up by chunk; the driver gets one weight table's worth.
    """
    spark = docs.sparkSession
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            texts = (t for batch in pieces(batches, "text") for t in raw_texts(batch.column("text")))
            own = shared.value
            kept = own.weights
            own.weights = {name: w.copy() for name, w in kept.items()}
            change = descend(own, texts)
            own.weights = kept
            for name, d in change.items():
                for at in range(0, len(d), CHUNK):
                    if d[at : at + CHUNK].any():
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), pa.array([d[at : at + CHUNK].tobytes()])], ["name", "at", "change"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            width = CLASSES if pdf["name"].iloc[0] == "class" else SLOTS
            total, times = np.zeros((CHUNK, width), np.float32), np.zeros(CHUNK)
            for raw in pdf["change"]:
                d = np.frombuffer(raw, np.float32).reshape(CHUNK, width)
                total += d
                times += d.any(axis=1)
            total /= np.maximum(times, 1)[:, None]
            return pd.DataFrame({"name": [pdf["name"].iloc[0]], "at": [pdf["at"].iloc[0]], "change": [total.astype(np.float32).tobytes()]})

        part = docs.filter(turn == k).select("text").repartition(max(WORKERS, int(n_docs / ROUNDS / WORKER_DOCS)))
        schema = "name string, at bigint, change binary"
        with shuffles_deleted(spark):
            changes = part.mapInArrow(work, schema).groupBy("name", "at").applyInPandas(add, schema).collect()
        for r in changes:
            w = model.weights[r["name"]]
            w[r["at"] : r["at"] + CHUNK] += np.frombuffer(r["change"], np.float32).reshape(CHUNK, w.shape[1])
        shared.unpersist()
    return model


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Model and written token counts; both the counts and the weights are learnt from all texts of docs."""
    with shuffles_deleted(docs.sparkSession):
        counts = cut_lineage(token_counts(docs))
    model = prepare(counts)
    n_docs = int(model.counts[model.frequent[END]]) if END in model.frequent else docs.count()
    return train(model, docs, n_docs), counts


# Scoring

_DOC = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"]
_OUT = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, token binary, times bigint"


def score_batch(model: Model, texts: list[bytes]) -> tuple[list[tuple], list[Counter]]:
    """Of each text: tokens, known tokens, and both sums without the counts of rare tokens; and its rare tokens."""
    rows, rare, symbols, places = [], [], [], []
    for text in texts:
        tokens = [*text.lower().split(), END]
        place, symbol = symbols_of(model, tokens)
        places.append(place)
        symbols.append(symbol)
        rare.append(Counter(tokens[i] for i in np.flatnonzero(place < 0).tolist()))
    history, wanted = histories(symbols)
    total = np.concatenate([forward(model, history[k : k + BATCH], wanted[k : k + BATCH])["total"] for k in range(0, len(wanted), BATCH)]) / _LN10
    place = np.concatenate(places)
    listed = place >= 0
    own = np.zeros(len(place))
    own[listed] = np.log10(model.counts[place[listed]] + 0.5)
    tail = wanted >= HEAD
    total[tail] += own[tail] - model.tail_norm()[wanted[tail] - HEAD]
    ends = np.cumsum([len(p) for p in places])
    starts = ends - [len(p) for p in places]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        rows.append((b - a, int(listed[a:b].sum()), float(own[a:b].sum()), float(total[a:b].sum())))
    return rows, rare


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row (doc_id, held_out, text).

    Frequent tokens are scored from the model on the spot. A rare token's part of both scores is the logarithm of its
    count, which comes from a join with the counts, and is added up per row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        none = lambda kind, n: pa.nulls(n, kind)
        for batch in pieces(batches, "text", 1_000_000):
            rows, rare = score_batch(shared.value, raw_texts(batch.column("text")))
            n = len(rows)
            ids = np.arange(row, row + n)
            row += n
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("doc_id"), batch.column("held_out"), *columns, none(pa.binary(), n), none(pa.int64(), n)], [*_DOC, "token", "times"])
            many = [len(c) for c in rare]
            m = sum(many)
            if m:
                tokens = pa.array([t for c in rare for t in c], pa.binary())
                times = pa.array([x for c in rare for x in c.values()], pa.int64())
                empty = [none(k, m) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, many)), *empty, tokens, times], [*_DOC, "token", "times"])

    both = cut_lineage(docs.select("doc_id", "held_out", "text").mapInArrow(run, _OUT))
    rare = both.filter(F.col("token").isNotNull()).select("row", "token", "times")
    found = rare.join(counts.select("token", "n"), "token", "left")
    added = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
    )
    whole = both.filter(F.col("token").isNull()).select(*_DOC).join(added, "row", "left")
    rest = F.coalesce("rare", F.lit(0.0))
    norm = float(np.log10(model.n + 0.5 * (model.v + 1)))
    return whole.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents; the fifth that is held out is not learnt from.

    A null or empty text is a single end token. Repeated rows are counted and scored each. Without training rows all tokens
    are unknown: the base score is 0 and the model is uniform over the tail classes. An empty table gives no rows. Reads
    doc_id and text only.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (bucket_of(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    model, counts = fit(rows.filter(~F.col("held_out")))
    return score(rows, model, counts)
