"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations read the bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import free_name, pieces, raw_texts

#: Rule and its bit. A rule keeps its bit for good, so that stored ledgers stay readable.
RULES = {
    "few_words": 0,
    "repeated_windows": 1,
    "symbols": 2,
    "shouting": 3,
    "repeated_lines": 4,
    "word_length": 5,
    "no_letters": 6,
}
#: Versions of the policy: the rules a document must not fail.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting", "repeated_lines", "word_length", "no_letters"),
}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_letter_words",
)
LEDGER = T.StructType([T.StructField(name, T.LongType()) for name in (*MEASURES, "fail_bits")])

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    n = len(ids)
    if n == len(words):
        return 0
    _, pair = np.unique(seq[:-1] * n + seq[1:], return_inverse=True)
    _, window, counts = np.unique(pair[:-1] * n + seq[2:], return_inverse=True, return_counts=True)
    hit = counts[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of a text. Words are cut at ASCII white space only, which is what bytes.split does."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    return (
        len(words),
        int(np.count_nonzero((raw & 0xC0) != 0x80)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        sum(1 for w in words if w.translate(None, _NOT_LETTERS)),
    )


def fail_bits(m: np.ndarray) -> np.ndarray:
    """One bit for each rule that fails; m has a column for each of MEASURES."""
    n, chars, symbols, dup, repeat, lines, upper, letters = m.T
    failed = {
        "few_words": n < 50,
        "repeated_windows": 100 * repeat > 50 * n,
        "symbols": 10 * symbols > n,
        "shouting": 10 * upper > 3 * n,
        "repeated_lines": 10 * dup > 3 * lines,
        "word_length": (chars < 3 * n) | (chars > 12 * n),
        "no_letters": 10 * letters < 7 * n,
    }
    return sum((failed[rule].astype(np.int64) << bit) for rule, bit in RULES.items())


def ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The rows of docs with a struct of measurements and failure bits, and that struct's name.

    Every rule is evaluated once for every row and whole text. A null or empty text has no words and so fails
    `few_words`; repeated rows are measured like any other; columns of docs keep their names, and the struct is called
    `ledger` with as many underscores as it takes to be new. An empty table gives an empty ledger.
    """
    (name,) = free_name(docs, "ledger")
    out = T.StructType([*docs.schema.fields, T.StructField(name, LEDGER)])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            rows = np.array([measure(x) for x in raw_texts(batch.column(text))], np.int64).reshape(-1, len(MEASURES))
            columns = [*rows.T, fail_bits(rows)]
            made = pa.StructArray.from_arrays([pa.array(c) for c in columns], [*MEASURES, "fail_bits"])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(evaluate, out), name


def mask(policy: str) -> int:
    return sum(1 << RULES[rule] for rule in POLICIES[policy])


def passes(bits: Column | str, policy: str = "v1") -> Column:
    """True if no rule of the policy failed."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0


def keep(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """Rows of docs whose text passes the policy, with the columns of docs."""
    rows, name = ledger(docs, text)
    return rows.filter(passes(F.col(f"`{name}`.fail_bits"), policy)).select(*(F.col(f"`{c}`") for c in docs.columns))


def ablations(bits: DataFrame, policy: str = "v1", column: str = "fail_bits") -> DataFrame:
    """What each rule of a policy does: rows it fails, rows only it fails, and rows kept without it.

    Rows are counted by their failure bits first, which leaves one row for each combination of rules (128 at most), and
    everything else is arithmetic on those bits. Null bits count as no failure.
    """
    chosen = F.lit(mask(policy)).cast("bigint")
    combos = bits.groupBy(F.coalesce(F.col(column), F.lit(0)).bitwiseAND(chosen).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("bigint").alias("bit")) for r in POLICIES[policy])))
    each = combos.withColumn("r", rules).select("bits", "n", "r.*")
    own = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(own).alias("n_failed"), count(own & rest).alias("n_failed_alone"), count(rest).alias("n_kept_without")
    )
