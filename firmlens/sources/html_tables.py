"""From page HTML to narrow tables: the one step that needs a tag reader.

Everything after these tables is native column work. The reader is the standard
library's tokenizer plus the few selector forms the lists below use.
"""
from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from firmlens.operators.sizes import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where pages keep descriptions, contacts and their frame.
ABOUT = [".about", ".company-info", ".company-description", '[class*="about"]', '[class*="company"]', "#about",
         "#company-info", "#description"]
CONTACT = [".contact", ".contact-info", ".contact-us", '[class*="contact"]', '[class*="address"]', "#contact",
           "#contact-info", "#contact-us", "footer", ".footer", "#footer"]
FRAME = ["header", ".header", "#header", "footer", ".footer", "#footer", ".main", "#main", "main"]
# Parts of a search result page.
RESULT_BOXES = [".MjjYud", ".tF2Cxc", "#search .g", ".g", ".rc"]
RESULT_TITLES = [".LC20lb", "h3.LC20lb", ".MBeuO", "h3", "a h3", '[role="heading"]']
RESULT_LINKS = [".yuRUbf a[href]", "a[href]", ".r a[href]", "[data-ved] a[href]"]
RESULT_TEXTS = [".VwiC3b", ".yXK7lf", ".p4wth", ".hJNv6b", ".s3v9rd", ".X5LH0c", ".st", "[data-sncf]"]
RESULT_STATS = ["#result-stats", ".LHJvCe"]
AD_MARKS = ["shopping-carousel", "mnr-c", "kp-header", "g-blk", "ads-fr", "tads", "bottomads"]

EMPTY_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT_TAGS = {"script", "style", "template"}


class Tag:
    def __init__(self, name, attrs, parent):
        self.name, self.parent, self.items = name, parent, []
        self.attrs = {k: v or "" for k, v in attrs}

    def walk(self, skip=()):
        """Tags and strings below, in document order; no recursion, as unclosed tags nest deeply."""
        stack = [iter(self.items)]
        while stack:
            item = next(stack[-1], None)
            if item is None:
                stack.pop()
            else:
                yield item
                if isinstance(item, Tag) and item.name not in skip:
                    stack.append(iter(item.items))

    def tags(self):
        return [i for i in self.walk() if isinstance(i, Tag)]

    def strings(self):
        return [i for i in self.walk(SILENT_TAGS) if isinstance(i, str)]

    def text(self):
        return "".join(self.strings())

    def tight_text(self, gap=""):
        return gap.join(s.strip() for s in self.strings() if s.strip())

    def marks(self):
        """Names, attributes and text of the tag and all below, in lower case."""
        head = [f"{t.name} {' '.join(f'{k}={v}' for k, v in t.attrs.items())}" for t in [self, *self.tags()]]
        return " ".join(head + [i for i in self.walk() if isinstance(i, str)]).lower()


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Tag("document", [], None)

    def handle_starttag(self, tag, attrs):
        node = Tag(tag, attrs, self.here)
        self.here.items.append(node)
        if tag not in EMPTY_TAGS:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.items.append(Tag(tag, attrs, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.items.append(data)


def read_html(html: str) -> Tag:
    r = Reader()
    r.feed(html or "")
    r.close()
    return r.root


TESTS: dict = {}
STEP = re.compile(r'([a-z0-9]*)((?:[.#][\w-]+|\[[\w:-]+(?:\*?="[^"]*")?\])*)$')


def step_test(step: str):
    name, rest = STEP.match(step).groups()
    tests = []
    for mark in re.findall(r'[.#][\w-]+|\[[^\]]+\]', rest):
        if mark[0] == ".":
            tests.append(lambda t, v=mark[1:]: v in t.attrs.get("class", "").split())
        elif mark[0] == "#":
            tests.append(lambda t, v=mark[1:]: t.attrs.get("id") == v)
        else:
            key, op, value = re.match(r'\[([\w:-]+)(?:(\*?=)"([^"]*)")?\]', mark).groups()
            if op is None:
                tests.append(lambda t, k=key: k in t.attrs)
            elif op == "=":
                tests.append(lambda t, k=key, v=value: t.attrs.get(k) == v)
            else:
                tests.append(lambda t, k=key, v=value: v in t.attrs.get(k, ""))
    return lambda t: (not name or t.name == name) and all(f(t) for f in tests)


def selected(tags: list[Tag], selector: str) -> list[Tag]:
    """Those of ``tags`` matching one or two steps ("outer inner")."""
    if selector not in TESTS:
        TESTS[selector] = [step_test(s) for s in selector.split(" ")]
    steps = TESTS[selector]
    found = [t for t in tags if steps[-1](t)]
    if len(steps) == 1:
        return found

    def inside(tag):
        up = tag.parent
        while up is not None and not steps[0](up):
            up = up.parent
        return up is not None
    return [t for t in found if inside(t)]


def first_of(tags: list[Tag], selectors: list[str], accept):
    """First selector whose first tag gives an acceptable value."""
    for s in selectors:
        hits = selected(tags, s)
        if hits:
            value = accept(hits[0])
            if value is not None:
                return hits[0], value
    return None, None


def needed(selector: str) -> str | None:
    """What a tag must have to match: its name, or an attribute (with ``@``); None if anything may match."""
    name, marks = STEP.match(selector.split(" ")[-1]).groups()
    if name or not marks or marks.endswith('=""]'):
        return name or None
    return {".": "@class", "#": "@id"}.get(marks[0]) or "@" + re.match(r"\[([\w:-]+)", marks).group(1)


NEEDED: dict = {}


def page_parts(html: str, about: list[str], contact: list[str]) -> tuple:
    root = read_html(html)
    tags = root.tags()
    having: dict = {None: tags}
    for t in tags:
        for key in (t.name, *(f"@{k}" for k in t.attrs)):
            having.setdefault(key, []).append(t)
    texts: dict = {}

    def of(selectors):
        for s in selectors:
            if s not in NEEDED:
                NEEDED[s] = needed(s)
            yield from selected(having.get(NEEDED[s], ()), s)

    def text_of(tag):
        if id(tag) not in texts:
            texts[id(tag)] = tag.text()
        return texts[id(tag)]
    metas = [t for t in tags if t.name == "meta"]

    def meta(key, value):
        return next((t.attrs.get("content", "").strip() for t in metas if t.attrs.get(key) == value), None)
    title = next((t.tight_text() for t in tags if t.name == "title"), None)
    sections = [text_of(t) for t in of(contact)]
    contact_text = "".join(s + "\n" for s in sections)
    text = root.text()
    return (title, [t.tight_text() for t in tags if t.name == "h1"], meta("property", "og:title"), meta("name", "description"),
            meta("property", "og:description"), meta("name", "keywords"),
            [t.tight_text() for t in of(about)],
            contact_text if contact_text.strip() else text, sections + [text_of(t) for t in of(FRAME)],
            [t.attrs["href"].strip() for t in tags if t.name == "a" and "href" in t.attrs],
            ["".join(i for i in t.items if isinstance(i, str)) for t in tags
             if t.name == "script" and t.attrs.get("type") == "application/ld+json"], text)


PARTS_DDL = ("title string, h1s array<string>, og_title string, meta_description string, og_description string, "
             "meta_keywords string, about array<string>, contact_text string, sections array<string>, "
             "links array<string>, jsonld array<string>, text string")
PARTS = [c.strip().split(" ")[0] for c in PARTS_DDL.split(",")]
PART_TYPES = [pa.list_(pa.string()) if "array" in c else pa.string() for c in PARTS_DDL.split(",")]


def page_table(pages: DataFrame, keys: list[str], more_about: list[str] = (), more_contact: list[str] = ()) -> DataFrame:
    """Title, headings, metas, links, sections and text of each page (``html`` plus ``keys``)."""
    about, contact = ABOUT + list(more_about), CONTACT + list(more_contact)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                parts = zip(*(page_parts(h, about, contact) for h in some.column("html").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in keys), *(pa.array(c, t) for c, t in zip(parts, PART_TYPES))], names=[*keys, *PARTS])
    types = dict(pages.dtypes)
    return spread(pages.select(*keys, "html")).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + PARTS_DDL)


def result_boxes(html: str) -> list[tuple]:
    tags = read_html(html).tags()
    boxes = next((found for found in (selected(tags, s) for s in RESULT_BOXES) if found), [])
    rows = []
    for pos, box in enumerate(boxes):
        marks, inner = box.marks(), box.tags()
        tag, title = first_of(inner, RESULT_TITLES, lambda t: t.tight_text() if len(t.tight_text()) > 2 else None)
        link, up = None, tag.parent if tag else None
        while up is not None and up.name != "a":
            up = up.parent
        if up is not None and up.attrs.get("href", "").startswith("http"):
            link = up.attrs["href"]
        if link is None:
            _, link = first_of(inner, RESULT_LINKS, lambda t: t.attrs["href"] if t.attrs["href"].startswith("http") else None)
        _, about = first_of(inner, RESULT_TEXTS, lambda t: t.tight_text(" ") if len(t.tight_text(" ")) > 10 else None)
        rows.append((pos, any(m in marks for m in AD_MARKS), title, link, about))
    return rows


def result_table(serps: DataFrame, keys: list[str]) -> DataFrame:
    """One row per result box of each captured search page (``html`` plus ``keys``)."""
    def run(batches):
        for frame in batches:
            rows = [(*k, *r) for *k, html in frame[keys + ["html"]].itertuples(index=False) for r in result_boxes(html)]
            yield pd.DataFrame(rows, columns=keys + ["pos", "is_ad", "title", "url", "raw_description"])
    types = dict(serps.dtypes)
    return spread(serps.select(*keys, "html")).mapInPandas(
        run, ", ".join(f"{k} {types[k]}" for k in keys) + ", pos int, is_ad boolean, title string, url string, raw_description string")


def statistics_table(serps: DataFrame, keys: list[str]) -> DataFrame:
    """The result count line of each captured search page."""
    def run(batches):
        for frame in batches:
            lines = [first_of(read_html(h).tags(), RESULT_STATS, lambda t: t.tight_text())[1] for h in frame["html"]]
            yield frame[keys].assign(stats_text=lines, content_length=frame["html"].str.len())
    types = dict(serps.dtypes)
    return spread(serps.select(*keys, "html")).mapInPandas(
        run, ", ".join(f"{k} {types[k]}" for k in keys) + ", stats_text string, content_length long")
