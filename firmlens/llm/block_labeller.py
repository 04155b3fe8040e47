"""Main text of web pages: a bidirectional LSTM labels every block in the context of the whole page.

A page is read into its leaf blocks, each with the tags, classes and ids on its path. A block's input
is the mean of learned vectors of its hashed path tokens, the mean of those of its hashed words, and
a few numbers (length, share of link text, punctuation). A recurrent network reads the sequence of
blocks in both directions, so every block is judged with all others in view, and the blocks labelled
as content are joined.

The network is trained on pages made from a grammar of page layouts (containers, menus, adverts,
notices, forms, comments in many markups, closed tags or not) with words of a bounded sample of the
pages at hand, so that layout and context decide and not the words of one site.

Null and empty html, and pages without content, give an empty text. Repeated rows are read each on
its own. Pages and blocks are never cut.
"""
from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table

#: Pages whose words fill the training pages at most, words taken of each, training pages, and passes over them.
SAMPLE_PAGES, SAMPLE_WORDS, TRAIN_PAGES, PASSES = 100, 400, 400, 70
PATH_SLOTS, WORD_SLOTS, NUMBERS, WIDTH, HIDDEN = 1024, 512, 5, 20, 14
#: Blocks that the network reads together at most (a longer page is read by itself).
READ_BLOCKS = 60_000

BLOCK_TAGS = frozenset("""address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead
title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template".split())


class Blocks(HTMLParser):
    """Leaf blocks in page order: (path tokens, text, characters of link text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[tuple[tuple[str, ...], str, int]] = []
        self.text: list[str] = []
        self.links = self.silent = self.in_link = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(t for _, tokens in self.stack for t in tokens)
            last = next((f"in:{tag}" for tag, _ in reversed(self.stack) if tag in BLOCK_TAGS), "in:")
            self.found.append(((*path, last), text, self.links))
        self.text, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            closes = {"p"} if tag != "p" else {"p"}
            closes |= {"li"} if tag == "li" else {"td", "th"} if tag in ("td", "th", "tr") else {"dt", "dd"} if tag in ("dt", "dd") else set()
            at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] in closes), None)
            if at is not None and all(t not in BLOCK_TAGS for t, _ in self.stack[at + 1:]):
                self._leave(at)
        if tag in VOID_TAGS:
            return
        words = [w for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for w in re.split(r"[^a-z0-9]+", v.lower()) if w]
        self.stack.append((tag, (tag, *(f"c:{w}" for w in words))))
        self.silent += tag in SILENT_TAGS
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is not None:
            self._leave(at)

    def _leave(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.silent -= tag in SILENT_TAGS
            self.in_link -= tag == "a"
        del self.stack[at:]

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            self.links += len(data.strip()) if self.in_link else 0


def blocks_of(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    if not html:
        return []
    reader = Blocks()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.found


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % slots


def _numbers(text: str, links: int) -> list[float]:
    return [1.0, min(len(text), 2000) ** 0.5 / 20, links / max(len(text), 1), min(sum(map(text.count, ".!?")), 20) / 10, float(text[-1] in ".!?:")]


class Labeller:
    """Vectors of path tokens and words, two LSTM readers, and the output weights."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    @staticmethod
    def fresh(seed: int = 0) -> "Labeller":
        g = np.random.default_rng(seed)
        inside, out = WIDTH + NUMBERS, 2 * HIDDEN
        w = {"path": g.normal(0, 0.5, (PATH_SLOTS, WIDTH)), "word": g.normal(0, 0.1, (WORD_SLOTS, WIDTH)), "out": g.normal(0, 0.2, out), "bias": np.zeros(1)}
        for side in "fb":
            w[f"{side}x"], w[f"{side}h"] = g.normal(0, 0.25, (inside, 4 * HIDDEN)), g.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"{side}b"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # open forget gates
        return Labeller(w)

    def inputs(self, blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
        out = np.zeros((len(blocks), WIDTH + NUMBERS))
        for k, (path, text, links) in enumerate(blocks):
            vector = self.paths.get(path)
            if vector is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                vector = self.paths[path] = self.w["path"][[_slot(t, PATH_SLOTS) for t in path]].mean(axis=0)
            if len(self.words) > 500_000:
                self.words.clear()
            slots = [self.words.get(w) if w in self.words else self.words.setdefault(w, _slot(w, WORD_SLOTS)) for w in text.split()]
            counts = np.bincount(slots, minlength=WORD_SLOTS)
            out[k, :WIDTH] = np.tanh(vector + counts @ self.w["word"] / len(slots))
            out[k, WIDTH:] = _numbers(text, links)
        return out

    def read(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over the padded pages x[page, block]; padding stands after the blocks for ``f``, before for ``b``."""
        wh, pre = self.w[f"{side}h"], x @ self.w[f"{side}x"] + self.w[f"{side}b"]
        h, c = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        out = np.zeros((*x.shape[:2], HIDDEN))
        for t in range(x.shape[1]):
            z = pre[:, t] + h @ wh
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN:(k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            if keep is not None:
                keep.append((i, f, o, g, c, h))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log-odds of content for x[page, block]; blocks from ``sizes`` on are padding."""
        places = np.arange(x.shape[1])
        turned = np.where(places < sizes[:, None], sizes[:, None] - 1 - places, places)  # each page back to front
        rows = np.arange(len(x))[:, None]
        ahead = self.read(x, "f", None if keep is None else keep.setdefault("f", []))
        back = self.read(x[rows, turned], "b", None if keep is None else keep.setdefault("b", []))
        both = np.concatenate([ahead, back[rows, turned]], axis=2)
        if keep is not None:
            keep |= {"both": both, "turned": turned, "rows": rows}
        return both @ self.w["out"] + self.w["bias"]

    def content(self, pages: list[list[tuple[tuple[str, ...], str, int]]]) -> list[np.ndarray]:
        """Which blocks of each page are content."""
        found: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            longest, n = 0, 0
            for k in order:
                longest = max(longest, len(pages[k]))
                if n and longest * (n + 1) > READ_BLOCKS:
                    break
                n += 1
            part, order = order[:n], order[n:]
            sizes = np.array([len(pages[k]) for k in part])
            x = np.zeros((n, sizes.max(), WIDTH + NUMBERS))
            for row, k in enumerate(part):
                x[row, :sizes[row]] = self.inputs(pages[k])
            score = self.scores(x, sizes)
            for row, k in enumerate(part):
                found[k] = score[row, :sizes[row]] > 0
        return found


def _back(reader: Labeller, side: str, x: np.ndarray, steps: list, dh_all: np.ndarray, grad: dict) -> np.ndarray:
    """Back through time: gradients of one reader, returns that of its input."""
    wh = reader.w[f"{side}h"]
    dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
    dh, dc = np.zeros_like(dh_all[:, 0]), np.zeros_like(dh_all[:, 0])
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, c0, h0 = steps[t]
        tc = np.tanh(f * c0 + i * g)
        dh = dh + dh_all[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        grad[f"{side}h"] += h0.T @ dz
        dz_all[:, t] = dz
        dh, dc = dz @ wh.T, dc * f
    grad[f"{side}x"] = np.einsum("pti,ptj->ij", x, dz_all, optimize=True)
    grad[f"{side}b"] = dz_all.sum(axis=(0, 1))
    return dz_all @ reader.w[f"{side}x"].T


def fit(pages: list[tuple[list, list[bool]]], passes: int = PASSES) -> Labeller:
    """Train on pages of blocks with their labels, by Adam on all pages at once.

    In each pass most blocks are shown without their words and some path tokens are hidden, so that
    the network leans on layout and context.
    """
    reader, chance = Labeller.fresh(), np.random.default_rng(1)
    sizes = np.array([len(b) for b, _ in pages])
    inside = np.arange(sizes.max()) < sizes[:, None]
    flat = [b for blocks, _ in pages for b in blocks]
    numbers = np.array([_numbers(t, k) for _, t, k in flat])
    known = {path: k for k, path in enumerate(dict.fromkeys(path for path, _, _ in flat))}
    path_at = np.array([known[path] for path, _, _ in flat])
    path_of, word_of = np.zeros((len(known), PATH_SLOTS), np.float32), np.zeros((len(flat), WORD_SLOTS), np.float32)
    for path, row in known.items():
        for t in path:
            path_of[row, _slot(t, PATH_SLOTS)] += 1 / len(path)
    for row, (_, text, _) in enumerate(flat):
        slots = [_slot(w, WORD_SLOTS) for w in text.split()]
        word_of[row] = np.bincount(slots, minlength=WORD_SLOTS) / len(slots)
    gold = np.zeros(inside.shape)
    gold[inside] = [y for _, labels in pages for y in labels]
    first, second = ({k: np.zeros_like(v) for k, v in reader.w.items()} for _ in range(2))
    for step in range(1, passes + 1):
        paths = path_of * (chance.random(path_of.shape, np.float32) > 0.1)
        worded = np.flatnonzero(chance.random(len(flat)) > 0.8)
        vector = (paths @ reader.w["path"])[path_at]
        vector[worded] += word_of[worded] @ reader.w["word"]
        vector = np.tanh(vector)
        x = np.zeros((*inside.shape, WIDTH + NUMBERS))
        x[inside] = np.concatenate([vector, numbers], axis=1)
        kept: dict = {}
        score = reader.scores(x, sizes, kept)
        miss = np.where(inside, 1 / (1 + np.exp(-score)) - gold, 0) / inside.sum()
        grad = {k: np.zeros_like(v) for k, v in reader.w.items()}
        grad["out"], grad["bias"] = np.einsum("ptk,pt->k", kept["both"], miss), miss.sum(keepdims=True).reshape(1)
        d_both = miss[..., None] * reader.w["out"]
        rows, turned = kept["rows"], kept["turned"]
        dx = _back(reader, "f", x, kept["f"], d_both[..., :HIDDEN], grad)
        d_turned = _back(reader, "b", x[rows, turned], kept["b"], d_both[..., HIDDEN:][rows, turned], grad)
        dx = dx + d_turned[rows, turned]
        d_vector = dx[inside][:, :WIDTH] * (1 - vector ** 2)
        by_path = np.zeros((len(known), WIDTH))
        np.add.at(by_path, path_at, d_vector)
        grad["path"], grad["word"] = paths.T @ by_path, word_of[worded].T @ d_vector[worded]
        for k, d in grad.items():
            d = d + (1e-3 if k == "word" else 1e-5) * reader.w[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            reader.w[k] = reader.w[k] - 0.04 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return reader


#: Layouts of training pages: openings of content containers and of the parts around them.
CONTENT = ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'section class="story"',
           'div class="article-body"', 'div itemprop="articleBody"', 'div role="main"', 'main id="main"', 'article class="post"', "div", "section"]
MENUS = ["nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="navbar"', 'div class="breadcrumb"', 'nav role="navigation"', 'menu']
HEADERS = ["header", 'div class="header"', 'div id="masthead"', 'div class="topbar"', 'header role="banner"']
FOOTERS = ["footer", 'div class="footer"', 'div id="footer"', 'footer role="contentinfo"', 'div class="copyright"']
ASIDES = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'aside class="links"', 'section class="recommended"']
ADVERTS = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="sponsored"', 'div class="promo"', 'div class="banner"', 'aside class="ad"',
           'div id="ad1"', 'div class="advertisement"']
NOTICES = ['div class="cookie"', 'div class="cookie-banner"', 'div id="consent"', 'div class="notice"', 'div class="alert"', 'div role="dialog"',
           'div class="popup"', 'div class="modal"', 'div class="gdpr"', "dialog"]
FORMS = ["form", 'form class="search"', 'form id="login"', 'div class="newsletter"', 'form class="subscribe"', 'div class="signup"', 'form role="search"']
COMMENTS = ['div class="comments"', 'section id="comments"', 'div class="comment"', 'ol class="comment-list"', 'section class="comments"', 'div id="disqus"',
            'div class="replies"', 'div class="discussion"']


class PageMaker:
    """Pages from the grammar, with the texts of their content blocks."""

    def __init__(self, words: list[str], seed: int):
        self.words, self.pick = words or ["text"], random.Random(seed)

    def sentence(self, low: int, high: int) -> str:
        words = [self.pick.choice(self.words) for _ in range(self.pick.randint(low, high))]
        return " ".join(words) + self.pick.choice([".", ".", "", "!"])

    def within(self, opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def links(self) -> str:
        items = [f'<a href="/x">{self.sentence(1, 3)}</a>' for _ in range(self.pick.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.pick.random() < 0.7 else " ".join(items)

    def around(self, kind: list[str]) -> str:
        opening = self.pick.choice(kind)
        if kind is MENUS or kind is ASIDES and self.pick.random() < 0.6:
            return self.within(opening, self.links())
        if kind is FORMS:
            return self.within(opening, f"<label>{self.sentence(1, 4)}</label><input name=q><button>{self.sentence(1, 2)}</button>")
        if kind is COMMENTS:
            return self.within(opening, "".join(self.within(self.pick.choice(["div", "p", "li", 'div class="comment"']), self.sentence(4, 40)) for _ in range(self.pick.randint(1, 5))))
        if kind is HEADERS:
            return self.within(opening, self.within(self.pick.choice(["div", "p", "h2", "span"]), self.sentence(1, 6)) + (self.links() if self.pick.random() < 0.5 else ""))
        return self.within(opening, self.within(self.pick.choice(["p", "div", "span"]), self.sentence(2, 30)) if self.pick.random() < 0.5 else self.sentence(2, 30))

    def maybe(self, share: float, kind: list[str]) -> str:
        return self.around(kind) if self.pick.random() < share else ""

    def page(self) -> tuple[str, set[str]]:
        head, texts = self.sentence(2, 10), []
        parts = [f"<h1>{head}</h1>"] if self.pick.random() < 0.9 else []
        texts += [head] if parts else []
        for k in range(self.pick.randint(1, 14)):
            text = self.sentence(1, 4) if self.pick.random() < 0.2 else self.sentence(2, 90)
            texts.append(text)
            form = self.pick.random()
            opening = self.pick.choice(["p"] * 12 + ["h2", "h3", "blockquote", "pre", "li", "div", "td"])
            if opening == "td":
                parts.append(f"<table><tr><td>{text}</td></tr></table>")
            elif form < 0.15:
                parts.append(f"<{opening}><b>{text}<br>")
            elif form < 0.3:
                parts.append(f"<{opening}>{text}")
            else:
                parts.append(self.within(opening, text))
            if self.pick.random() < 0.06:
                parts.append(self.around(self.pick.choice([ADVERTS, FORMS, ASIDES, NOTICES])))
        inner = "".join(parts) + self.maybe(0.12, COMMENTS)
        body = (self.maybe(0.3, NOTICES) + self.maybe(0.5, HEADERS) + self.maybe(0.7, MENUS) + self.maybe(0.4, ADVERTS) + self.maybe(0.2, FORMS)
                + self.within(self.pick.choice(CONTENT), inner) + self.maybe(0.3, COMMENTS) + self.maybe(0.3, ASIDES) + self.maybe(0.3, ADVERTS)
                + self.maybe(0.2, FORMS) + self.maybe(0.7, FOOTERS) + self.maybe(0.1, NOTICES))
        top = self.pick.choice([head, self.sentence(2, 8)])
        return f"<!DOCTYPE html><html><head><title>{top}</title><style>p{{}}</style></head><body>{body}</body></html>", {" ".join(t.split()) for t in texts}


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, words_each: int = SAMPLE_WORDS, made: int = TRAIN_PAGES, seed: int = 7) -> Labeller:
    """Fit the network on ``made`` pages of the grammar; their words are ``words_each`` at most of each of ``sample`` pages at most."""
    picked = pages.filter("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.join(F.broadcast(picked), "page_id", "left_semi").select(F.array_distinct(F.slice(F.split(F.regexp_replace("html", "<[^>]*>", " "), r"\s+"), 1, words_each)).alias("w")).collect()
    words = sorted({w for r in rows for w in r["w"] or [] if w and "<" not in w and "&" not in w and ">" not in w})
    maker, training = PageMaker(words, seed), []
    for _ in range(made):
        html, texts = maker.page()
        blocks = blocks_of(html)
        training.append((blocks, [text in texts and "title" not in path for path, text, _ in blocks]))
    return fit(training)


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text) of every page."""
    weights = labeller.w

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Labeller(weights)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [blocks_of(h) for h in part.column("html").to_pylist()]
                texts = ["\n".join(b[1] for b, keep in zip(blocks, content) if keep) for blocks, content in zip(found, reader.content(found))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(of, "page_id bigint, url string, text string")


@query("op7_recurrent_block_labeller")
def op7_recurrent_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("bigint"))
