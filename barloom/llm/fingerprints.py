"""Document fingerprints: SimHash of weighted word pairs, and permuted block tables that find all within a Hamming radius."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import LOWER, UPPER
from barloom.session import cut_lineage

#: Bits of a fingerprint, as two numbers of 64; bits that may differ; blocks that the bits are cut into.
BITS, RADIUS, BLOCKS = 128, 3, 4

#: Neighbours in doc_id meet in cells of 2 ** 6 ids.
CELL_BITS = 6

#: Two counters of 32 bits in one number.
LANES = (1 << 32) + 1


def split_words(text: Column) -> Column:
    """Words cut at ASCII white space, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_pairs(words: Column) -> Column:
    """Each word with the next one; a single word by itself."""
    following = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) < 2, words).otherwise(pairs)


def half(md5: Column, first: int) -> Column:
    """16 of the 32 hex digits of a hash as a number of 64 bits."""
    return F.conv(F.substring(md5, first, 16), 16, -10).cast("bigint")


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, `high` and `low` (the fingerprint's 128 bits) of every row; keys must tell the rows apart.

    A term is a word pair, its weight the times it occurs. Each of the 128 bits of its md5 is a signed vote of that weight,
    and a bit of the fingerprint is set if its votes are for it: over half the weights. A text without words has no votes and
    the fingerprint 0. Votes are counters, two in a number, so a text of any length is a row of 64 numbers and its terms are
    never gathered. Bits 0 to 31 and 32 to 63 of a number share the counters.
    """
    words = texts.select(*keys, split_words(F.col(text)).alias("words")).select(*keys, word_pairs(F.col("words")).alias("terms"))
    terms = words.select(*keys, F.explode_outer("terms").alias("term"))
    hashed = terms.select(*keys, F.md5(F.col("term").cast("binary")).alias("md5"))
    halves = hashed.select(*keys, half(F.col("md5"), 1).alias("high"), half(F.col("md5"), 17).alias("low"))
    votes = [F.sum(F.shiftrightunsigned(c, b).bitwiseAND(F.lit(LANES))).alias(f"{c}{b}") for c in ("high", "low") for b in range(32)]
    counted = halves.groupBy(*keys).agg(F.count("high").alias("weight"), *votes)

    def bit(counter: Column, place: int, value: int) -> Column:
        count = F.shiftrightunsigned(counter, 32) if place == 1 else counter.bitwiseAND(F.lit((1 << 32) - 1))
        return F.when(2 * count > F.col("weight"), F.lit(value)).otherwise(F.lit(0)).cast("bigint")

    def word(c: str) -> Column:
        out = F.lit(0).cast("bigint")
        for b in range(32):
            top = 1 << (b + 32) if b < 31 else -(1 << 63)
            out = out.bitwiseOR(bit(F.col(f"{c}{b}"), 0, 1 << b)).bitwiseOR(bit(F.col(f"{c}{b}"), 1, top))
        return F.coalesce(out, F.lit(0))

    return counted.select(*keys, word("high").alias("high"), word("low").alias("low"))


def hex_digits(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def differing(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ; a and b are prefixes of their two columns."""
    return F.bit_count(F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high"))) + F.bit_count(F.col(f"{a}low").bitwiseXOR(F.col(f"{b}low")))


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - differing(a, b) / F.lit(float(BITS))


# Search


def block(prefix: str, k: int, blocks: int) -> Column:
    """Block k of the bits, the highest bits first; blocks are 64 bits or less, and none crosses the two numbers."""
    per = blocks // 2
    bits = 64 // per
    shifted = F.shiftrightunsigned(F.col(f"{prefix}{'high' if k < per else 'low'}"), 64 - bits * (k % per + 1))
    return shifted.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else shifted


def near(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (q_high, q_low, high, low) of a query and an index fingerprint that differ in at most `radius` bits.

    Both tables hold distinct fingerprints. If at most `radius` of the blocks differ, the other blocks agree, so there is a
    table for each choice of blocks - radius blocks: the bits are permuted so that these lead, and rows with equal leading
    bits meet. A pair is taken from the first table where it meets only, and checked on all bits. Blocks must be an even
    divisor of the bits, and more than radius. A pair is made for queries only, never among the rows of a table's bucket.
    """
    if blocks <= radius or blocks % 2 or BITS % blocks:
        raise ValueError("blocks must be even, divide the bits and be more than the radius")
    tables = list(combinations(range(blocks), blocks - radius))

    def permuted(rows: DataFrame, prefix: str) -> DataFrame:
        leads = [F.struct(F.lit(t).alias("t"), F.array(*(block(prefix, k, blocks) for k in lead)).alias("lead")) for t, lead in enumerate(tables)]
        return rows.select("*", F.explode(F.array(*leads)).alias("x")).select(f"{prefix}high", f"{prefix}low", "x.t", "x.lead")

    met = permuted(queries.select(F.col("high").alias("q_high"), F.col("low").alias("q_low")), "q_").join(permuted(index.select("high", "low"), ""), ["t", "lead"])
    agree = [reduce(lambda a, b: a & b, (block("q_", k, blocks) == block("", k, blocks) for k in lead)) for lead in tables]
    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        first = F.when(agree[t], F.lit(t)).otherwise(first)
    return met.filter((differing("q_", "") <= radius) & (first == F.col("t"))).select("q_high", "q_low", "high", "low")


# Edited documents


def next_cells(rows: DataFrame) -> DataFrame:
    """cell and `next_cell`, the next lower cell that has rows (after the last one, the first), of each cell of rows.

    Cells are dealt by ranges; the ranges' ends are few rows, so no task sees all cells.
    """
    down = F.col("cell").desc()
    dealt = cut_lineage(rows.select("cell").distinct().repartitionByRange(down).withColumn("part", F.spark_partition_id()))
    heads = dealt.groupBy("part").agg(F.max("cell").alias("head"))
    ends = Window.orderBy("part")
    follow = heads.select("part", F.coalesce(F.lead("head").over(ends), F.max("head").over(Window.partitionBy())).alias("follow"))
    inside = Window.partitionBy("part").orderBy(down)
    return dealt.join(follow, "part").select("cell", F.coalesce(F.lead("cell").over(inside), F.col("follow")).alias("next_cell"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many first ones of the following text, or all it has."""
    cut = F.shiftright(F.char_length(text), 1)
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def both_fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_chars, edited_sha256 (as bytes) and both fingerprints of rows (keys, cell, place, text, following)."""
    change = F.col("change")
    named = [*keys, "n_chars", "edited_sha256"]
    texts = rows.withColumn("change", edited(F.col("text"), F.col("following"))).select(*keys, F.char_length("text").cast("bigint").alias("n_chars"), F.unhex(F.sha2(change.cast("binary"), 256)).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), change.alias("text")))).alias("x"))
    made = fingerprints(texts.select(*named, "x.kind", "x.text"), [*named, "kind"], "text")
    of = lambda kind, c, name: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name)
    return made.groupBy(*named).agg(of(0, "high", "high"), of(0, "low", "low"), of(1, "high", "edited_high"), of(1, "low", "edited_low"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and both fingerprints of every document; cell and place, next_cell and next_place.

    A text moves once, to its cell of neighbouring ids, where its fingerprints are made without another shuffle; only the rows at the
    ends of cells are completed by a join of these. Rows with a null id share one cell, which Spark sorts and spills.
    """
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("bigint").alias("doc_id")
    cell = F.coalesce(F.shiftright(doc_id, CELL_BITS), F.lit(-(1 << 62)))
    rows = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), cell.alias("cell"))
    inside = Window.partitionBy("cell").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    placed = rows.select("*", F.lead("text").over(inside).alias("following"), F.lag("cell").over(inside).alias("earlier"), F.row_number().over(inside).alias("place"))
    keys = ["cell", "place", "doc_id", "next_cell", "next_place"]
    own = ["cell", "place", "doc_id", "text"]
    within = placed.filter(F.col("following").isNotNull()).select(*own, "following", F.col("cell").alias("next_cell"), (F.col("place") + 1).alias("next_place"))
    heads = placed.filter(F.col("earlier").isNull()).select(F.col("cell").alias("next_cell"), F.col("text").alias("following"))
    tails = placed.filter(F.col("following").isNull()).select(*own).join(next_cells(rows), "cell").join(heads, "next_cell").withColumn("next_place", F.lit(1))
    return both_fingerprints(within, keys).unionByName(both_fingerprints(tails, keys))


def counts_near(made: DataFrame, every: int, radius: int, blocks: int) -> DataFrame:
    """high, low and n_near of the fingerprints of rows whose doc_id `every` divides: rows near them, one itself not counted."""
    index = cut_lineage(made.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") % every == 0).alias("asked")))
    pairs = near(index.filter("asked"), index, radius, blocks)
    return pairs.join(index, ["high", "low"]).groupBy(F.col("q_high").alias("high"), F.col("q_low").alias("low")).agg((F.sum("n") - 1).alias("n_near"))


def likeness_of_documents(docs: DataFrame, every: int = 50, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprints of every document, of its edited text and their likeness, and of its likeness to the next document.

    The next document has the next lower doc_id (nulls last; among equal ids the next text by its bytes; repeated rows follow
    each other); after the last comes the first. `n_near` counts the other documents within the radius, for documents whose id
    `every` divides; it is -1 for all others. A null text counts as empty; an empty one has the fingerprint 0 and is near
    any other that has it. An empty table gives no rows. Only doc_id and text are read.
    """
    made = cut_lineage(document_fingerprints(docs))
    following = made.select(F.col("cell").alias("next_cell"), F.col("place").alias("next_place"), F.col("high").alias("next_high"), F.col("low").alias("next_low"))
    asked = F.col("doc_id") % every == 0
    counted = made.filter(asked).select("cell", "place", "high", "low").join(counts_near(made, every, radius, blocks), ["high", "low"]).select("cell", "place", "n_near")
    whole = made.join(following, ["next_cell", "next_place"]).join(counted, ["cell", "place"], "left")
    return whole.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        hex_digits(F.col("high"), F.col("low")).alias("fingerprint"), hex_digits(F.col("edited_high"), F.col("edited_low")).alias("edited_fingerprint"),
        likeness("", "edited_").alias("near_edited"), likeness("", "next_").alias("near_next"), F.coalesce("n_near", F.lit(-1)).cast("bigint").alias("n_near"),
    )
