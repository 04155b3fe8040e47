"""Repeated 200-byte strings by deep-shallow sorting of sparse suffixes.

A byte goes if a ``length``-byte string that covers it also starts anywhere else. Every such string
(a window) holds ``length - gram + 1`` grams; its anchor is the gram of smallest hash, the first of
equals. The anchor follows from the window's bytes alone, so equal windows have equal anchors at the
same place, and only the suffixes at anchors need sorting, one per 70 bytes or so. A segment is what
the windows of one anchor cover: the bytes before the anchor, the anchor, the bytes behind it.

Segments meet by their anchor's hash. Equal segments are counted first: all their windows repeat, and
one stays for the others to meet. In each task the suffixes at the anchors, and the reversed bytes
before them, are sorted deep-shallow: multikey quicksort down to a shallow depth, then a blind trie
for every group of suffixes that are equal to there. Neighbours' common prefixes cut the order into
classes of suffixes that agree for some bytes; a window repeats if and only if another segment
is in its class on both sides.

An anchor with more segments than ``GROUP`` is not gathered in one task: its windows are halved by
their place around the anchor. The windows of a half share more bytes, which become the new key, so
segments that differ there part, equal ones are counted again and leave but for one; halving ends at
single windows, which are equal or apart. No row is dropped undecided.

Null and empty texts have no bytes and lose none; nor do texts shorter than ``length``. Repeated rows
and equal texts are rows of their own: each repeats the other. Rows without doc_id are treated like
others. Texts are bytes and may be of any length; other columns are not read. An empty table gives
an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table
from firmlens.llm.scratch import stored

#: Bytes of a string that counts as repeated, and of the grams that anchor it.
LENGTH, GRAM = 200, 64
#: Segments of one key that are sorted together at most; larger groups are halved.
GROUP = 256
#: Bytes up to which suffixes are sorted by multikey quicksort, and bytes of segments sorted at a time.
SHALLOW, BLOCK_BYTES = 24, 1 << 19
#: Bytes hashed at a time: positions must fit 24 bits.
CHUNK = 1 << 20


# --- anchors ---------------------------------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) at every place, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, size = 0x9E3779B97F4A7C15, 1
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:] if len(h) > size else h[:0]
        factor, size = factor * factor % (1 << 64), 2 * size
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_anchors(hashes: np.ndarray, places: int) -> np.ndarray:
    """For every window of ``places`` grams the place of its smallest hash, the first of equals."""
    low = np.uint64((1 << 24) - 1)
    least = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < places:
        step = min(have, places - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    return (least & low).astype(np.int64)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of all texts: (text, first window, bytes before the anchor, windows - 1, key, segment hash, repeats).

    A run of the same segment at neighbouring places, as in one letter repeated, is one row with its number of repeats.
    """
    out = []
    for number, start, part in _chunks(texts, length):
        data = np.frombuffer(part, np.uint8)
        hashes = gram_hashes(data, gram)
        at = window_anchors(hashes, length - gram + 1)
        valid = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(start, [*start[1:], len(part)])])
        if not len(valid):
            continue
        text = np.searchsorted(start, valid, side="right") - 1
        place = at[valid]
        fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
        heads = np.flatnonzero(fresh)
        tails = np.concatenate((heads[1:], [len(valid)])) - 1
        first, last, where, text = valid[heads], valid[tails], place[heads], text[heads]
        digest = xxhash.xxh64_intdigest
        lead = where - first
        d = np.array([digest(part[a:b + length], s) for a, b, s in zip(first.tolist(), last.tolist(), lead.tolist())], np.uint64).view(np.int64)
        k = hashes[where].view(np.int64)
        run = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)))
        heads = np.flatnonzero(run)
        repeats = np.diff(np.concatenate((heads, [len(run)])))
        offsets = np.array([o for _, o in number], np.int64)
        numbers = np.array([n for n, _ in number], np.int64)
        out.append((numbers[text[heads]], first[heads] - np.array(start)[text[heads]] + offsets[text[heads]], lead[heads], (last - first)[heads],
                    k[heads], d[heads], repeats))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(c) for c in zip(*out))


def _chunks(texts: list[bytes], length: int):
    """Texts put together up to CHUNK bytes: ((text number, offset of the part in it), starts, bytes). Longer texts go in overlapping parts."""
    numbers, starts, parts, size = [], [], [], 0
    for n, text in enumerate(texts):
        if len(text) < length:
            continue
        for a in range(0, len(text) - length + 1, CHUNK):
            part = text[a:a + CHUNK + length - 1]
            if size and size + len(part) > CHUNK:
                yield numbers, starts, b"".join(parts)
                numbers, starts, parts, size = [], [], [], 0
            numbers.append((n, a))
            starts.append(size)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, starts, b"".join(parts)


# --- deep-shallow sorting --------------------------------------------------------------------------------------------

class Suffixes:
    """Byte strings with quick common prefixes: the leading zeros of the exclusive or."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.width = max(map(len, strings), default=0)
        self.numbers = [int.from_bytes(s.ljust(self.width, b"\0"), "big") for s in strings]

    def common(self, i: int, j: int) -> int:
        same = 8 * self.width - (self.numbers[i] ^ self.numbers[j]).bit_length() >> 3
        return min(same, len(self.strings[i]), len(self.strings[j]))

    def at(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1


class BlindTrie:
    """Orders strings by branching bytes alone; only one whole comparison per insertion."""

    def __init__(self, suffixes: Suffixes):
        self.suffixes = suffixes
        self.root = None  # an inner node is (depth, {byte: node}), a leaf the list of equal strings

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            depth, below = node
            path.append(node)
            node = below.get(self.suffixes.at(i, depth)) or next(iter(below.values()))
        other = node[0]
        same = self.suffixes.common(i, other)
        if same == len(self.suffixes.strings[i]) == len(self.suffixes.strings[other]):
            node.append(i)
            return
        k = 0
        while k < len(path) and path[k][0] < same:
            k += 1
        if k < len(path) and path[k][0] == same:
            path[k][1][self.suffixes.at(i, same)] = [i]
            return
        under = path[k] if k < len(path) else node
        fork = (same, {self.suffixes.at(other, same): under, self.suffixes.at(i, same): [i]})
        if k:
            path[k - 1][1][self.suffixes.at(other, path[k - 1][0])] = fork
        else:
            self.root = fork

    def ordered(self) -> Iterator[tuple[list[int], int]]:
        """Equal strings in order, with the prefix that they share with the strings before them."""
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, tuple):
                depth, below = node
                first, *others = sorted(below.items())
                stack += [(child, depth) for _, child in reversed(others)]
                stack.append((first[1], shared))
            else:
                yield node, shared


def multikey_quicksort(words: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in order, as groups of rows that agree in all words: three-way partition on one word after the other."""
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth == words.shape[1]:
            if len(rows):
                yield rows
            continue
        word = words[rows, depth]
        pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
        stack += [(rows[word > pivot], depth), (rows[word == pivot], depth + 1), (rows[word < pivot], depth)]


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the prefix that each shares with the one before it in that order."""
    suffixes = Suffixes(strings)
    head = b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings)
    words = np.frombuffer(head, ">u8").reshape(len(strings), shallow // 8).astype(np.uint64)
    order, shared = [], []
    for group in multikey_quicksort(words):
        fresh = len(order)
        if len(group) == 1:
            order.append(int(group[0]))
            shared.append(0)
        else:
            trie = BlindTrie(suffixes)
            for i in group.tolist():
                trie.insert(i)
            for equal, prefix in trie.ordered():
                order += equal
                shared += [prefix] + [len(strings[equal[0]])] * (len(equal) - 1)
        if fresh:
            shared[fresh] = suffixes.common(order[fresh - 1], order[fresh])
    return np.array(order, np.int64), np.array(shared, np.int64)


def repeated_windows(segments: list[bytes], lead: np.ndarray, span: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each segment and each number of bytes before the anchor, whether that window is in another segment too."""
    n, sides = len(segments), length - gram + 1
    right, right_shared = deep_shallow([s[a:] for s, a in zip(segments, lead.tolist())])
    left, left_shared = deep_shallow([s[:a][::-1] for s, a in zip(segments, lead.tolist())])
    before = np.arange(sides)[:, None]
    classes = np.empty((2, sides, n), np.int64)
    classes[0][:, right] = np.cumsum(right_shared < length - before, axis=1)
    classes[1][:, left] = np.cumsum(left_shared < before, axis=1)
    pair = classes[0] * (n + 1) + classes[1]
    inside = (before <= lead) & (before >= lead - span)
    pair = np.where(inside, pair, -1 - np.arange(n))  # windows that a segment does not have meet nothing
    order = np.argsort(pair, axis=1, kind="stable")
    ranked = np.take_along_axis(pair, order, axis=1)
    same = np.zeros((sides, n + 1), bool)
    same[:, 1:n] = ranked[:, 1:] == ranked[:, :-1]
    out = np.zeros((sides, n), bool)
    np.put_along_axis(out, order, same[:, :-1] | same[:, 1:], axis=1)
    return out.T


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true cells."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


# --- jobs ------------------------------------------------------------------------------------------------------------

def _scanned(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """Digest, size and segments of every document."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            number, *columns = anchors(texts, length, gram)
            order = np.argsort(number, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(texts))))).astype(np.int32)
            kinds = (pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int64()),
                 *[pa.ListArray.from_arrays(ends, pa.array(c[order], kind)) for c, kind in zip(columns, kinds)]],
                ["doc_id", "digest", "n_bytes", "first", "lead", "span", "k", "d", "repeats"])

    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(
        scan, "doc_id bigint, digest binary, n_bytes bigint, first array<bigint>, lead array<smallint>, span array<smallint>, "
              "k array<bigint>, d array<bigint>, repeats array<bigint>")
    return rows.withColumn("id", F.monotonically_increasing_id())


def _with_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (digest and others) with the text of that digest, as bytes; equal texts are reduced to one before they are dealt out."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = documents.select(F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text")).dropDuplicates(["digest"])
    return wanted.join(texts, "digest")


def _cut(documents: DataFrame, facts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of the chosen segments (k, d, m, id, first, lead, span), each once."""
    by_doc = chosen.groupBy("id").agg(*[F.collect_list(c).alias(c) for c in ("k", "d", "m", "first", "lead", "span")])  # as many as a text has
    wanted = by_doc.join(facts.select("id", "digest"), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for text, *lists_ in zip(*(batch.column(c).to_pylist() for c in ("text", "k", "d", "m", "first", "lead", "span"))):
                for k, d, m, first, lead, span in zip(*lists_):
                    rows.append((k, d, m, lead, span))
                    parts.append(text[first:first + span + length])
            if rows:
                k, d, m, lead, span = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(lead, pa.int32()),
                                                  pa.array(span, pa.int32()), pa.array(parts, pa.binary())], ["k", "d", "m", "lead", "span", "part"])

    found = _with_texts(documents, wanted).select("text", "k", "d", "m", "first", "lead", "span")
    return found.mapInArrow(cut, "k bigint, d bigint, m bigint, lead int, span int, part binary")


def _sorted_marks(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, d, low, high): places of windows that another segment of the same key holds too.

    Rows of a key, ``GROUP`` at most besides repeated rows, come to one task; it sorts a few thousand segments at a time.
    """
    def judged(held: list[tuple]) -> pa.RecordBatch:
        once = list({(r[0], r[1], r[2]): r for r in held}.values())
        lead, span = np.array([r[3] for r in once]), np.array([r[4] for r in once])
        row, low, high = runs(repeated_windows([r[5] for r in once], lead, span, length, gram))
        return pa.RecordBatch.from_arrays([pa.array([once[i][1] for i in row.tolist()], pa.int64()), pa.array([once[i][2] for i in row.tolist()], pa.int64()),
                                           pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["k", "d", "low", "high"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "k", "d", "lead", "span", "part"))):
                if size >= BLOCK_BYTES and held[-1][0] != row[0]:
                    yield judged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield judged(held)

    together = segments.select("key", "k", "d", "lead", "span", "part").repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(judge, "k bigint, d bigint, low int, high int")


def _halves(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """Each segment's windows in two, by their place around the anchor: (k, d, low, high, key, same, lead, span, part).

    ``key`` stands for the bytes that all windows of the half share, ``same`` for the whole half.
    """
    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, d, low, high, lead, span, part in zip(*(batch.column(c).to_pylist() for c in ("k", "d", "low", "high", "lead", "span", "part"))):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    most, least = min(lead, b), max(lead - span, a)
                    if a <= b and least <= most:
                        shared = part[lead - a:lead + length - b]
                        own = part[lead - most:lead - least + length]
                        out.append((k, d, a, b, xxhash.xxh128_digest(shared, a << 8 | b), xxhash.xxh64_intdigest(own, most) - (1 << 63), most, most - least, own))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                names = ["k", "d", "low", "high", "key", "same", "lead", "span", "part"]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    return segments.select("k", "d", "low", "high", "lead", "span", "part").mapInArrow(
        halve, "k bigint, d bigint, low int, high int, key binary, same bigint, lead int, span int, part binary")


def _marks(segments: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """(k, d, low, high) for distinct segments (k, d, m, lead, span, part), m being the segments of the key."""
    key = F.col("k").cast("string").cast("binary")
    marks = _sorted_marks(segments.filter(F.col("m") <= group).withColumn("key", key), length, gram)
    crowded = stored(segments.filter(F.col("m") > group).dropDuplicates(["k", "d"])
                     .select("k", "d", F.lit(0).alias("low"), F.lit(length - gram).alias("high"), "lead", "span", "part"), "crowded", "zstd")
    while not crowded.isEmpty():
        halves = stored(_halves(crowded, length, gram), "halves", "zstd")
        kinds = stored(halves.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "d")).alias("one")), "kinds")
        sizes = stored(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "sizes")
        twice = halves.drop("part").join(kinds.filter("n > 1").select("key", "same"), ["key", "same"])
        marks = marks.unionByName(twice.select("k", "d", (F.col("lead") - F.col("span")).alias("low"), F.col("lead").alias("high")))
        ones = kinds.join(sizes, "key").select("key", "m", F.col("one.k").alias("k"), F.col("one.d").alias("d"))
        left = stored(halves.join(ones, ["key", "k", "d"]), "left", "zstd")
        marks = marks.unionByName(_sorted_marks(left.filter(F.col("m") <= group), length, gram))
        crowded = left.filter(F.col("m") > group)
    return marks


def _covered(ranges: DataFrame, length: int) -> DataFrame:
    """(id, n_removed, n_spans, spans) from the first and last places of repeated windows of each document."""
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, spans, removed = [0], [], []
            for places in batch.column("places").to_pylist():
                merged: list[list[int]] = []
                for first, last in sorted((p["first"], p["last"]) for p in places):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last + length)
                    else:
                        merged.append([first, last + length])
                spans += merged
                ends.append(len(spans))
                removed.append(sum(b - a for a, b in merged))
            pairs = pa.StructArray.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in (0, 1)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(removed, pa.int64()), pa.array(np.diff(ends), pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["id", "n_removed", "n_spans", "spans"])

    per_doc = ranges.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("places"))  # as many as a text has segments
    return per_doc.mapInArrow(cover, "id bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>")


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, doc_id, digest, n_bytes, n_removed, n_spans, spans) per row: maximal runs of repeated bytes, ends exclusive.

    ``id`` tells rows apart, ``digest`` is the SHA-256 of the text. ``gram`` is a power of two below ``length``.
    """
    facts = stored(_scanned(documents, length, gram), "scanned", "zstd")
    columns = ("first", "lead", "span", "k", "d", "repeats")
    found = facts.select("id", F.inline(F.arrays_zip(*columns)))
    often = stored(found.groupBy("k").agg(F.sum("repeats").alias("n")).filter("n > 1").select("k"), "often")
    live = stored(found.join(often, "k", "left_semi"), "live", "zstd")
    kinds = stored(live.groupBy("k", "d").agg(F.sum("repeats").alias("n"), F.min(F.struct("id", "first", "lead", "span")).alias("one")), "kinds")
    sizes = stored(kinds.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "sizes")
    chosen = kinds.join(sizes, "k").select("k", "d", "m", "one.*")
    parts = stored(_cut(documents, facts, chosen, length), "parts", "zstd")
    marks = stored(_marks(parts, length, gram, group), "marks")
    places = marks.groupBy("k", "d").agg(F.collect_list(F.struct("low", "high")).alias("places"))  # at most one per window of a segment
    known = stored(kinds.select("k", "d", (F.col("n") > 1).alias("whole")).join(places, ["k", "d"], "left").filter("whole or places is not null"), "known")
    windows = F.col("repeats") * (F.col("span") + 1)
    at = F.col("first") + F.col("lead")
    ranges = F.when(F.col("whole"), F.array(F.struct(F.col("first").alias("first"), (F.col("first") + windows - 1).alias("last")))).otherwise(
        F.transform("places", lambda p: F.struct((at - p["high"]).alias("first"), (at - p["low"]).alias("last"))))
    covered = _covered(live.join(known, ["k", "d"]).select("id", F.inline(ranges)), length)
    return facts.select("id", "doc_id", "digest", "n_bytes").join(stored(covered, "covered", "zstd"), "id", "left").select(
        "id", "doc_id", "digest", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "spans")


def kept_bytes(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, kept): what stays of the texts of the rows of ``spans`` that lose some bytes but not all."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                starts, ends = [0, *(s["end"] for s in cut)], [*(s["start"] for s in cut), len(text)]
                out.append(b"".join(text[a:b] for a, b in zip(starts, ends)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "kept"])

    some = spans.filter("n_removed > 0 and n_removed < n_bytes")  # equal texts lose all or nothing, so each text is here once
    return _with_texts(documents, some).select("id", "text", "spans").mapInArrow(keep, "id bigint, kept binary")


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256) per row."""
    spans = stored(repeated_spans(documents, length, gram, group), "spans", "zstd")
    kept = stored(kept_bytes(documents, spans).select("id", F.sha2("kept", 256).alias("kept_sha256")), "kept")
    digest: Column = F.when(F.col("n_removed") == 0, F.lower(F.hex("digest"))).when(
        F.col("n_removed") == F.col("n_bytes"), hashlib.sha256(b"").hexdigest()).otherwise(F.col("kept_sha256"))
    return spans.join(kept, "id", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "spans", digest.alias("kept_sha256"))


@query("op13_deep_shallow_spans")
def op13_deep_shallow_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("spans")
