"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import pieces

#: Bounded sample the field is fitted on: pages, characters of a page, passes, step.
SAMPLE_PAGES, SAMPLE_CHARS, PASSES, STEP = 300, 200_000, 6, 0.15
DIM = 1 << 16

# Element names of HTML.
BLOCKS = set("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style template noscript svg math iframe object canvas textarea".split())
#: An open element of the first kind ends where one of the others begins.
ENDED_BY = {
    "p": BLOCKS - {"body", "html", "head", "title", "caption", "legend", "option", "summary"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"}, "title": {"body"},
}

#: Words in names of elements, classes and ids that tell what a part of a page is; the same names that labelled pages use.
CONTENT_NAMES = "article main content post entry story body text page".split()
OTHER_NAMES = "nav menu header footer aside sidebar side ad ads advert sponsor banner promo notice cookie consent alert popup modal form search login signup subscribe newsletter comment comments reply replies disqus share social related recommend breadcrumb toolbar widget pager pagination tags legal copyright".split()
NEUTRAL_NAMES = "wrap wrapper container inner outer row col box block section group item layout site".split()


class Block:
    __slots__ = ("hints", "links", "path", "text")

    def __init__(self, path: tuple, hints: tuple, text: str, links: int):
        self.path, self.hints, self.text, self.links = path, hints, text, links


class Leaves(HTMLParser):
    """Leaf blocks of a page in order: text that no other block divides, with its ancestors and their names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.linked = self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            names = tuple(n for _, own in self.open for n in own)
            self.blocks.append(Block(tuple(t for t, _ in self.open), names, text, self.linked))
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent:
            self.silent += tag in SILENT
            return
        if tag in SILENT:
            self.silent = 1
            return
        if tag in BLOCKS:
            self.flush()
            while self.open and tag in ENDED_BY.get(self.open[-1][0], ()):
                self.open.pop()
            # Inline elements left open inside a block that ends go with it.
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in BLOCKS:
                    if tag in ENDED_BY.get(self.open[k][0], ()):
                        del self.open[k:]
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            named = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v)
            self.open.append((tag, tuple(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))[:12]))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # A self-closed silent element has nothing inside.
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.silent -= tag in SILENT
            return
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if any(t == "a" for t, _ in self.open):
                self.linked += len(data)


def leaves(html: str) -> list[Block]:
    parser = Leaves()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def label_of(block: Block) -> int:
    """1 for the main text, by the page's own markup: the innermost element whose name tells decides."""
    if "head" in block.path or "title" in block.path:
        return 0
    if set(block.path) & {"nav", "footer", "aside", "form", "header", "menu", "button", "select"} or set(block.hints) & set(OTHER_NAMES):
        return 0
    return int(bool({"article", "main"} & set(block.path) or set(block.hints) & set(CONTENT_NAMES)))


# Features


def bucket(name: str, depth: str = "") -> int:
    """Place of a feature in the weights, by a fixed polynomial hash."""
    h = 0
    for c in (depth + name).encode():
        h = (h * 257 + c + 1) % 2_147_483_647
    return h % DIM


def features(block: Block, memo: dict[tuple, list[int]]) -> list[int]:
    """Ancestor tags and names (once for each, and the nearest two), and the shape of the text."""
    key = (block.path, block.hints)
    if key not in memo:
        blocks = [t for t in block.path if t in BLOCKS and t not in ("html", "body")]
        memo[key] = sorted({bucket(t, "any ") for t in blocks} | {bucket(t, f"up{i} ") for i, t in enumerate(reversed(blocks[-2:]))} | {bucket(n, "name ") for n in block.hints})
    text = block.text
    words = text.count(" ") + 1
    shape = (
        f"words {min(words.bit_length(), 8)}",
        f"links {min(4 * block.links // max(len(text), 1), 4)}",
        f"end {text[-1] in '.!?:;'}",
        f"mark {text[0] in '©®™'}",
        "bias",
    )
    return memo[key] + [bucket(x, "text ") for x in shape]


class Field:
    """A chain of two labels with one weight for each feature and label, and four for neighbours."""

    def __init__(self):
        self.weights, self.pairs, self.start = np.zeros((DIM, 2)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows])

    def step(self, rows: list[list[int]], labels: np.ndarray, rate: float) -> None:
        """One step along the gradient of the labels' log probability, by forward and backward sums."""
        s, n = self.scores(rows), len(rows)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = self.start + s[0]
        for i in range(1, n):
            alpha[i] = s[i] + np.logaddexp(*(alpha[i - 1][:, None] + self.pairs))
        for i in range(n - 2, -1, -1):
            beta[i] = np.logaddexp(*(self.pairs + s[i + 1] + beta[i + 1]).T)
        whole = np.logaddexp(*alpha[-1])
        wrong = np.eye(2)[labels] - np.exp(alpha + beta - whole)
        pairs = np.zeros((2, 2))
        for i in range(1, n):
            pairs[labels[i - 1], labels[i]] += 1
            pairs -= np.exp(alpha[i - 1][:, None] + self.pairs + s[i] + beta[i] - whole)
        for r, w in zip(rows, wrong, strict=True):
            self.weights[r] += rate * w
        self.pairs += rate * pairs / n
        self.start += rate * wrong[0] / n

    def decode(self, rows: list[list[int]]) -> np.ndarray:
        """Most probable labels (Viterbi); ties go to the main text."""
        if not rows:
            return np.zeros(0, int)
        s = self.scores(rows).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = self.start[0] + s[0][0], self.start[1] + s[0][1]
        back = []
        for x, y in s[1:]:
            to0, to1 = p10 + b >= p00 + a, p11 + b >= p01 + a
            back.append((to0, to1))
            a, b = x + (p10 + b if to0 else p00 + a), y + (p11 + b if to1 else p01 + a)
        label = int(b >= a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return np.array(out[::-1])


# Labelled pages


def restyled(blocks: list[Block], labels: list[int], rng: random.Random) -> list[Block]:
    """The same page as another site would mark it up: telling elements become divs with telling class names, and back.

    Labels stay, so the field learns names and not only the elements that one site uses.
    """
    content, wrap = rng.choice(CONTENT_NAMES), rng.choice(NEUTRAL_NAMES)
    holder = rng.choice(["article", "main", "div", "div", "div"])
    held = (content,) if holder == "div" or rng.random() < 0.3 else ()
    other, out = {}, []
    for block, label in zip(blocks, labels, strict=True):
        if "head" in block.path or "title" in block.path:
            out.append(block)
            continue
        leaf = block.path[-1] if block.path and block.path[-1] in ("p", "li", "h1", "h2", "h3", "td", "pre", "blockquote") else "p"
        if label:
            path, hints = (holder, leaf), held
        else:
            kind = block.path[2] if len(block.path) > 2 else "body"
            if kind not in other:
                element = rng.choice(["nav", "header", "footer", "aside", "form", "div", "div", "div", "section", "ul"])
                bare = element in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
                # Now and then the part stands inside the main part.
                other[kind] = (element, () if bare else (rng.choice(OTHER_NAMES),), rng.random() < 0.35)
            element, own, inside = other[kind]
            path, hints = ((holder, element, leaf), held + own) if inside else ((element, leaf), own)
            if rng.random() < 0.5:
                path = (*path[:-1], *rng.choice([(), ("h1",), ("h2",), ("h3",), ("p",), ("li",)]))
        out.append(Block(("html", "body", "div", *path), (wrap, *hints), block.text, block.links))
    # A part of another kind: readers' comments after the article, in its own words.
    said = [b for b, y in zip(blocks, labels, strict=True) if y][:3]
    name = rng.choice(["comment", "comments", "reply", "replies"])
    around = (holder,) if rng.random() < 0.4 else ()
    path = ("html", "body", "div", *around, rng.choice(["div", "section", "section", "li"]), *rng.choice([("article",), ("div",), ()]), "p")
    extra = [Block(path, (wrap, *(held if around else ()), name), b.text, 0) for b in said]
    return out + extra


def fit(pages: list[str], seed: int = 1) -> Field:
    """A field from labelled pages: each as it is and restyled four times. The same pages give the same field."""
    rng, field, memo, data = random.Random(seed), Field(), {}, []
    for html in pages:
        blocks = leaves(html)
        labels = [label_of(b) for b in blocks]
        if not blocks or not any(labels):
            continue
        data.append((blocks, labels))
        for _ in range(4):
            new = restyled(blocks, labels, rng)
            data.append((new, labels + [0] * (len(new) - len(labels))))
    rows = [([features(b, memo) for b in blocks], np.array(labels)) for blocks, labels in data]
    for k in range(PASSES):
        rng.shuffle(rows)
        for r, y in rows:
            field.step(r, y, STEP / (1 + k))
    return field


def page_text(html: str, field: Field, memo: dict[tuple, list[int]]) -> str:
    blocks = leaves(html)
    return "\n".join(b.text for b, y in zip(blocks, field.decode([features(b, memo) for b in blocks]), strict=True) if y)


def names_main_part() -> str:
    """Pattern of markup that names the main part: its elements, or names in classes, ids and the like as `Leaves` splits them."""
    names = "|".join(CONTENT_NAMES)
    capital = "|".join(n.capitalize() for n in CONTENT_NAMES)
    word = rf"(?:(?<![A-Za-z])(?i:{names})|(?<=[a-z])(?:{capital}))(?![a-z])"
    return rf"""(?i:<(?:article|main)[\s>])|<[^>]*\s(?i:class|id|role|itemprop)\s*=\s*(?:"[^"]*{word}|'[^']*{word}|[^\s"'>]*{word})"""


def labelled_pages(pages: DataFrame) -> list[str]:
    """A bounded sample: pages whose markup names its main part, by the least hash in each of SAMPLE_PAGES places."""
    rows = pages.filter(F.col("html").rlike(names_main_part()) & (F.length("html") <= SAMPLE_CHARS)).select(F.xxhash64("html").alias("h"), "html")
    picks = rows.groupBy(F.pmod("h", F.lit(SAMPLE_PAGES)).alias("place")).agg(F.min("h").alias("h")).select("h")
    found = rows.join(F.broadcast(picks), "h").groupBy("h").agg(F.min("html").alias("html")).collect()
    return [r["html"] for r in sorted(found, key=lambda r: r["h"])]


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html."""
    shared = pages.sparkSession.sparkContext.broadcast(field)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = rows.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, list[int]] = {}
        for batch in pieces(batches, "html", 2_000_000):
            if len(memo) > 100_000:
                memo.clear()
            texts = [page_text(x or "", shared.value, memo) for x in batch.column("html").to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page, after fitting the field on a bounded sample of these pages.

    A null or empty html, or one without main text, gives an empty text. Broken markup is read as far as it goes. Repeated
    rows are extracted each. If no page names its main part, the untrained field takes every block. Reads page_id, url, html.
    """
    return extract(pages, fit(labelled_pages(pages)))
