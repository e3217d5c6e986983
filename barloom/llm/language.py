"""Language of a text by cross-parsing: into how few pieces of a language's labelled text can it be cut?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bucket_of, pieces

#: Bounds of the labelled sample: symbols of all languages together, documents of a language, languages.
SAMPLE_SYMBOLS, SAMPLE_DOCS, MAX_LANGUAGES = 96_000, 64, 200

#: Letters with a symbol of their own, and symbols parsed in one go.
MAX_LETTERS, SEGMENT = 60, 256

SPACE, OTHER, PAD = 0, 1, 2

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def letters(c: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    out = _LETTER[np.minimum(c, 0xFFFF)]
    for x in np.unique(c[c > 0xFFFF]):
        out[c == x] = chr(x).isalpha()
    return out


class SuffixAutomaton:
    """Recognises exactly the pieces of a sequence; state 0 is the start."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for x in sequence:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][x]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


class Parser:
    """Greedy cross-parsing against several languages at once, over many texts at once.

    Each language's automaton becomes total: where no piece goes on, a phrase ends and the next one begins with the symbol
    at hand. So a parse is a walk in a table, one step for each symbol of all segments in a batch.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seen = np.concatenate([np.zeros(0, np.uint32), *(codes(samples[x]) for x in self.languages)])
        used, counts = np.unique(seen[letters(seen)], return_counts=True)
        alphabet = sorted(used[np.argsort(-counts, kind="stable")][:MAX_LETTERS].tolist())
        self.symbol = np.where(_LETTER, OTHER, SPACE).astype(np.uint8)
        for i, c in enumerate(alphabet):
            if c <= 0xFFFF:
                self.symbol[c] = i + 3
        self.width = len(alphabet) + 3
        tables, self.roots, self.bits, at = [], [], [], 0
        for x in self.languages:
            sequence = self.symbols(samples[x])
            automaton = SuffixAutomaton(sequence.tolist())
            go = np.full((len(automaton.next), self.width), -1, np.int64)
            for state, arcs in enumerate(automaton.next):
                for s, to in arcs.items():
                    if s != OTHER:
                        go[state, s] = to
            restart = np.where(go[0] >= 0, go[0], 0)
            # Twice the next state, plus 1 if a phrase ended on the way there.
            table = np.where(go >= 0, 2 * (go + at), 2 * (restart + at) + 1)
            table[:, PAD] = 2 * (np.arange(len(go)) + at)
            tables.append(table.astype(np.int32))
            self.roots.append(at)
            self.bits.append(np.log2(max(len(sequence), 2)))
            at += len(go)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def symbols(self, text: str) -> np.ndarray:
        """Letters as symbols, and one space for whatever lies between words."""
        c = codes(text)
        s = self.symbol[np.minimum(c, 0xFFFF)]
        if len(c) and c.max() > 0xFFFF:
            s = np.where(c > 0xFFFF, np.where(letters(c), OTHER, SPACE), s).astype(np.uint8)
        again = np.zeros(len(s), bool)
        again[1:] = (s[1:] == SPACE) & (s[:-1] == SPACE)
        return s[~again]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) in each language (column). A text is parsed in segments, each from its own start."""
        lengths = np.array([len(t) for t in texts], np.int64)
        segments = -(-lengths // SEGMENT)
        flat = np.full((int(segments.sum()), SEGMENT), PAD, np.uint8)
        at = 0
        for t, n in zip(texts, segments.tolist(), strict=True):
            flat[at : at + n].reshape(-1)[: len(t)] = t
            at += n
        steps = np.ascontiguousarray(flat.T).astype(np.int32)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], flat.shape[0], axis=1)
        broken = np.ones(state.shape, np.int32)
        for s in steps:
            state = self.table[state * np.int32(self.width) + s]
            broken += state & 1
            state >>= 1
        owner = np.repeat(np.arange(len(texts)), segments)
        return np.stack([np.bincount(owner, b, len(texts)) for b in broken], axis=1) if len(self.roots) else np.zeros((len(texts), 0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language with the fewest phrases, weighted by the size of its sample, and how far the next one is (0 to 1)."""
        symbols = [self.symbols(t or "") for t in texts]
        known = np.array([bool((s != SPACE).any()) for s in symbols], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = self.phrases(symbols) * np.array(self.bits)
        best = cost.argmin(axis=1)
        order = np.sort(cost, axis=1)
        far = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9) if len(self.languages) > 1 else np.ones(len(texts))
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, far, 0.0)


def labelled_sample(docs: DataFrame, label: str = "lang", text: str = "text") -> dict[str, str]:
    """A bounded text of each language, from documents with a label.

    Documents are dealt by a hash of their text to SAMPLE_DOCS places of their language; each place keeps the one of the
    least hash, which needs partial sums only. The languages share SAMPLE_SYMBOLS, so the automata have at most twice as
    many states, whatever the number of languages; more than MAX_LANGUAGES are an error. Equal texts count once.
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    picks = rows.groupBy("l", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("place")).agg(F.min("h").alias("h")).select("l", "h")
    chosen = picks.limit(MAX_LANGUAGES * SAMPLE_DOCS + 1).collect()
    names = sorted({r["l"] for r in chosen})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = SAMPLE_SYMBOLS // max(len(names), 1)
    # Bounded by the parameters: no more than 64 documents of a language.
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r["l"], r["h"]) for r in chosen], "l string, h bigint"))
    texts: dict[tuple[str, int], str] = {}
    for r in rows.join(wanted, ["l", "h"]).groupBy("l", "h").agg(F.min(F.substring("t", 1, max(share // 16, 64))).alias("t")).collect():
        texts[r["l"], r["h"]] = r["t"]
    out = dict.fromkeys(names, "")
    for (name, _), t in sorted(texts.items()):
        if len(out[name]) < share:
            out[name] = (out[name] + " " + t)[:share]
    return out


def predict(docs: DataFrame, parser: Parser, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score, from the whole text of each row alone.

    lang_pred is `und` and score 0 for a null text, one without a letter, or if no language was learnt. Ties go to the
    first language by name. Long texts are parsed in segments, so a batch's memory is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", 2_000_000):
            names, score = shared.value.predict(batch.column("__text").to_pylist())
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (bucket_of(F.col("doc_id")) == 0).alias("held_out"), "lang", F.col("text").cast("string").alias("text"))
    parser = Parser(labelled_sample(rows.filter(~F.col("held_out"))))
    return predict(rows.drop("lang"), parser, ["doc_id", "held_out"])
