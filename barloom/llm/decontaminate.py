"""Passages of benchmark items in documents: a set join on rare shingles, then an exact check of whole windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import free_name, lower_ascii, text_key
from barloom.session import cut_lineage

WINDOW, SHINGLE = 13, 5

#: A side is broadcast only if it was counted and has no more rows than this; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000

#: Letters a-z, digits and all beyond ASCII. Java finds single characters of a class in a table, but tries its ranges in turn.
_WORD = r"[0123456789abcdefghijklmnopqrstuvwxyz\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case: letters a-z, digits and all beyond ASCII; none for null."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and words of each window: every run of `window` words, or all words of a shorter item that has any."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at")
    return rows.filter(F.size("w") > 0).select("item_id", "w", starts).select("item_id", F.slice("w", F.col("at"), window).alias("window")).distinct()


def sized(df: DataFrame) -> DataFrame:
    """The written table, marked for broadcast if its counted rows allow it."""
    table = cut_lineage(df)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def read_words(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of each document with text_key and w, its words; written once, as cutting texts into words is the dearest step."""
    return cut_lineage(docs.select(*columns, text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("w")))


def word_counts(read: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of the vocabulary (column word) occurs in all documents (column w); 0 for none."""
    found = read.select(F.explode("w").alias("word")).join(sized(vocabulary), "word")
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Each window with the one shingle that has to be found for it: the rarest, and where it starts in the window.

    Shingles are ordered by the count of their rarest word, then by that of all words, then by place. Containment needs
    all shingles of the window, so the necessary prefix is a single one. A window with fewer words than a shingle is its
    own shingle.
    """
    spots = windows.select("window").distinct().select("window", F.posexplode("window").alias("at", "word"))
    rated = spots.join(counts, "word").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("s"))
    size = F.least(F.size("window"), F.lit(shingle))
    candidate = lambda o: F.struct(
        F.array_min(F.transform(F.slice("s", o + 1, size), lambda x: x["n"])).alias("rarest"),
        F.aggregate(F.slice("s", o + 1, size), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("all"),
        o.alias("offset"),
    )
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.size("window") - size), candidate))
    chosen = rated.select("window", size.alias("length"), best["offset"].alias("offset"))
    return chosen.withColumn("h", F.xxhash64(F.slice("window", F.col("offset") + 1, F.col("length"))))


def occurrences(read: DataFrame, windows: DataFrame) -> DataFrame:
    """Of documents as `read_words` gives them, per text with an occurring window: text_key, n_words, n_hit, items (sorted ids). Equal texts count once.

    1. The rarity of the benchmark's words comes from all documents. 2. Every shingle of every document meets the
    shingles chosen for the windows. 3. The window's place follows from the shingle's; it must lie within the document.
    4. All words of the window are compared, so a hash never decides. 5. The covered places are united per text, which
    holds no more windows than the text has words.
    """
    windows = cut_lineage(windows)
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    chosen = windows.join(prefixes(windows, word_counts(read, vocabulary)), "window")
    chosen = cut_lineage(chosen.select("h", "length", "offset", "window", "item_id"))
    # At most SHINGLE different lengths.
    lengths = sorted(r[0] for r in chosen.select("length").distinct().collect())
    rows = read.filter(F.col("text_key").isNotNull()).select("text_key", "w")
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    found = None
    for length in lengths or [SHINGLE]:
        last = F.size("w") - length
        signs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(length)))))
        # xxhash64 of an array chains over its elements just as xxhash64 of several columns does.
        at = rows.select("text_key", "w", F.posexplode(signs).alias("at", "h"))
        one = at.join(side.filter(F.col("length") == length), "h")
        start = F.col("at") - F.col("offset")
        fits = (start >= 0) & (start + F.size("window") <= F.size("w"))
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
        one = one.filter(fits).filter(same).select("text_key", F.size("w").alias("n"), F.struct(start.alias("a"), (start + F.size("window")).alias("b")).alias("span"), "item_id")
        found = one if found is None else found.unionByName(one)
    united = found.groupBy("text_key").agg(F.max("n").alias("n"), F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit"))
    step = lambda s, x: F.struct(
        F.greatest(s["end"], x["b"]).alias("end"),
        (s["hit"] + F.greatest(x["b"] - F.greatest(s["end"], x["a"]), F.lit(0))).alias("hit"),
    )
    hit = F.aggregate(F.array_sort("spans"), zero, step, lambda s: s["hit"])
    return united.select("text_key", F.col("n").cast("bigint").alias("n_words"), hit.alias("n_hit"), F.array_sort("items").alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with its words, hit words, items and verdict.

    A null text, or one without words, has no hits; so have all documents if there is no benchmark. Repeated documents
    are reported each. Items that repeat count once; a null item_id is the id '', a null item text has no window. Only
    doc_id and text of docs and item_id and text of items are read.
    """
    read = read_words(docs, "doc_id")
    hits = occurrences(read, windows_of(items))
    rows = read.select("doc_id", "text_key", F.size("w").cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(hits.drop("n_words"), "text_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of docs that are not contaminated, with the columns of docs; null texts stay."""
    (key,) = free_name(docs, "text_key")
    bad = occurrences(read_words(docs), windows_of(items)).filter(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("text_key").alias(key))
    return docs.withColumn(key, text_key(F.col("text"))).join(bad, key, "left_anti").drop(key)
