"""Byte-level BPE: slices found by a scan of transition functions, merged pairs remembered, ids decoded.

Texts are arrays of code points, and each code point has a class (letter, number, apostrophe, white
space before a visible character, ...). A small automaton over these classes tells where a slice
begins. Each class is a function from state to state; the functions and all their compositions are
few, so composing is one table look-up, and since composing is associative, blocks of a text are
scanned side by side and then joined by their totals. No regular expression is involved.

Every slice is merged by rank, lowest and leftmost first, and remembered. ``slices`` keeps the token
at which each slice begins, so that any range of slices can be decoded by itself. Null and empty
texts have no tokens. Texts are never cut.
"""
from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table

#: Bytes of texts (or of their tokens) that are in work at once, slices that a Python worker remembers, and characters up to which it does.
CHUNK_BYTES, REMEMBERED, REMEMBERED_CHARS = 1 << 19, 200_000, 256
#: Bytes up to which a slice is merged by plain search for the lowest rank.
SHORT = 64

# classes of a code point in its place
(LETTER, SUFFIX1, SUFFIX2, NUMBER, OTHER, APOSTROPHE, SPACE_BEFORE, WHITE_BEFORE, WHITE, END) = range(10)
# states: what the characters so far have begun
(FRESH, LETTERS, NUMBERS, OTHERS, PREFIX, WHITES, QUOTE, SUFFIX) = range(8)
#: Letters that end a contraction after an apostrophe, and first letters of longer ones with their second.
ONE_LETTER, TWO_LETTERS = "stmd", {"r": "e", "v": "e", "l": "l"}
#: Code points that count as white space.
WHITE_POINTS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, cls: int) -> tuple[int, bool]:
    """Next state, and whether a slice begins at this character."""
    if cls == END:
        return FRESH, True
    if cls == SPACE_BEFORE:
        return PREFIX, True
    if cls == WHITE_BEFORE:
        return FRESH, True
    if cls == WHITE:
        return WHITES, state != WHITES
    if state == SUFFIX:
        return FRESH, False
    if state == QUOTE and cls in (SUFFIX1, SUFFIX2):
        return (FRESH if cls == SUFFIX1 else SUFFIX), False
    if cls in (LETTER, SUFFIX1, SUFFIX2):
        return LETTERS, state not in (LETTERS, PREFIX)
    if cls == NUMBER:
        return NUMBERS, state not in (NUMBERS, PREFIX)
    if state in (OTHERS, PREFIX, QUOTE):
        return OTHERS, False
    return (QUOTE if cls == APOSTROPHE else OTHERS), True


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's function, the composition table, the functions, and where slices begin."""
    own = [tuple(_step(s, c)[0] for s in range(8)) for c in range(10)]
    known = {f: k for k, f in enumerate(dict.fromkeys([tuple(range(8)), *own]))}
    todo = list(known)
    for f in todo:
        for g in own:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8)
    begins = np.array([[_step(s, c)[1] for c in range(10)] for s in range(8)])
    return np.array([known[f] for f in own], np.uint8), compose, np.array(every, np.uint8), begins


FUNCTION_OF, COMPOSE, FUNCTIONS, BEGINS = _functions()
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for point in range(0x110000):
            major = unicodedata.category(chr(point))[0]
            if major in "LN":
                kinds[point] = LETTER if major == "L" else NUMBER
        kinds[WHITE_POINTS] = WHITE
        kinds[ord("'")] = APOSTROPHE
        kinds[[ord(c) for c in ONE_LETTER]] = SUFFIX1
        _CLASSES.append(kinds)
    return _CLASSES[0]


def classify(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each code point; ``ends`` are the places of the marks that close texts."""
    found = _classes()[points]
    found[ends] = END
    following = np.append(found[1:], END)
    visible = (following != WHITE) & (following != END)
    white = found == WHITE
    found[white & visible] = WHITE_BEFORE
    found[white & visible & (points == 0x20)] = SPACE_BEFORE
    next_point = np.append(points[1:], 0)
    for first, second in TWO_LETTERS.items():
        found[(points == ord(first)) & (next_point == ord(second)) & (following != END)] = SUFFIX2
    return found


def states_before(classes: np.ndarray) -> np.ndarray:
    """State before each character, by an associative scan over blocks."""
    n = len(classes)
    width = max(1, int(n ** 0.5))
    blocks = -(-n // width)
    functions = np.zeros(blocks * width, np.uint8)  # function 0 changes nothing
    functions[:n] = FUNCTION_OF[classes]
    across = functions.reshape(blocks, width).T.copy()
    flat, k = COMPOSE.ravel(), np.uint32(len(COMPOSE))
    for t in range(1, width):
        across[t] = flat[across[t - 1] * k + across[t]]
    entry, state = np.zeros(blocks, np.uint8), FRESH
    for b, total in enumerate(across[-1].tolist()):
        entry[b] = state
        state = FUNCTIONS[total, state]
    before = np.empty((width, blocks), np.uint8)
    before[0] = entry
    before[1:] = FUNCTIONS[across[:-1], entry]
    return before.T.ravel()[:n]


def slice_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts, each closed by a mark; places where slices or marks begin; places of the marks."""
    whole = "\n".join(texts) + "\n"
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    classes = classify(np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends)
    return whole, np.flatnonzero(BEGINS[states_before(classes), classes]), ends


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: adjacent parts are merged, the lowest rank first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    return _merged_short(parts, ranks) if len(parts) <= SHORT else _merged_long(parts, ranks)


def _merged_short(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    rank, none = ranks.get, len(ranks) + 256
    pairs = [rank(p + q, none) for p, q in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) != none:
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merged_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """With a queue of pairs, so that the time hardly more than follows the length."""
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue = [(ranks[p + q], i, p, q) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if parts[i] != left or j >= len(parts) or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, b""
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
            if (pair := parts[i] + parts[k]) in ranks:
                heapq.heappush(queue, (ranks[pair], i, parts[i], parts[k]))
        h = before[i]
        if h >= 0 and (pair := parts[h] + parts[i]) in ranks:
            heapq.heappush(queue, (ranks[pair], h, parts[h], parts[i]))
    return [ranks[p] for p in parts if p]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Slices(dict):
    """Ids of slices as bytes, merged when first asked for; when there are too many, those not asked for again are forgotten."""

    def __init__(self, path: str):
        super().__init__()
        self.ranks = read_ranks(path)
        self.tokens = [token for token, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.pop(piece, None)
        if found is None:
            ids = merged(piece.encode(), self.ranks)
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


_SLICES: dict[str, Slices] = {}


def slices_of(path: str) -> Slices:
    if path not in _SLICES:
        _SLICES[path] = Slices(path)
    return _SLICES[path]


def encoded(texts: list[str], memory: Slices) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids, how many each text has, the first token of all slices within their text, and how many slices each text has."""
    whole, starts, ends = slice_starts(texts)
    at_end = np.searchsorted(starts, ends)
    places = starts.tolist()
    values = [memory[whole[a:b]] for a, b in zip(places, places[1:])]
    for k in at_end[:-1].tolist():
        values[k] = b""  # the marks between texts
    ids = np.frombuffer(b"".join(values), "<i4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    upto = np.concatenate(([0], np.cumsum(sizes)))
    first = np.concatenate(([0], at_end[:-1] + 1))
    n_slices = at_end - first
    n_tokens = upto[at_end] - upto[first]
    real = np.ones(len(values), bool)
    real[at_end[:-1]] = False
    slices = upto[:-1][real] - np.repeat(upto[first], n_slices)
    return ids, n_tokens, slices, n_slices


def _chunks(column: pa.Array, width: int = 1) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a column of texts or lists, with ``CHUNK_BYTES`` at most or of one row; ``width`` bytes count for each unit of an offset."""
    if not len(column):
        return
    at = column.offsets.to_numpy() if pa.types.is_list(column.type) else np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())))
    most, start = CHUNK_BYTES // width, 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(at, int(at[start]) + most, "right")) - 1)
        yield start, min(end, len(column))
        start = end


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


def encode(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids, slices): token ids, and the token at which each slice begins."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = slices_of(path)
        for batch in batches:
            for a, b in _chunks(batch.column("text")):
                part = batch.slice(a, b - a)
                ids, n_tokens, slices, n_slices = encoded([t or "" for t in part.column("text").to_pylist()], memory)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _lists(ids, n_tokens), _lists(slices, n_slices)],
                                                 names=["doc_id", "ids", "slices"])

    return documents.select("doc_id", "text").mapInArrow(of, "doc_id bigint, ids array<int>, slices array<int>")


def decode(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds the bytes as ``decoded``, put together slice by slice: a slice's ids are the span between two offsets."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_table(path)
        for batch in batches:
            for a, b in _chunks(batch.column("ids"), 4):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(part.column("ids"), part.column("slices"), tokens)], names=["doc_id", "ids", "slices", "decoded"])

    return tokens.select("doc_id", "ids", "slices").mapInArrow(of, "doc_id bigint, ids array<int>, slices array<int>, decoded binary")


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, and where each begins and the last ends."""
    if path not in _TABLES:
        tokens = [token for token, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]
        _TABLES[path] = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, tokens)))))
    return _TABLES[path]


def decoded(column: pa.ListArray, cuts: pa.ListArray, tokens: tuple[np.ndarray, np.ndarray]) -> pa.BinaryArray:
    """The bytes of each list of ids, from the first of its slices to the first of the next list's."""
    table, place = tokens
    begin, at = column.offsets.to_numpy().astype(np.int64), cuts.offsets.to_numpy().astype(np.int64)
    ids = column.values[begin[0]:begin[-1]].to_numpy()
    starts = cuts.values[at[0]:at[-1]].to_numpy() + np.repeat(begin[:-1] - begin[0], np.diff(at))
    sizes = (place[1:] - place[:-1])[ids]
    upto = np.concatenate(([0], np.cumsum(sizes)))
    whole = table[np.repeat(place[ids] - upto[:-1], sizes) + np.arange(upto[-1])]
    bounds = np.append(upto[starts], upto[-1])[at - at[0]]
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.array(bounds, pa.int32()).buffers()[1], pa.py_buffer(whole)])


def decode_slices(ids: list[int], slices: list[int], first: int, last: int, tokens: list[bytes]) -> bytes:
    """The bytes of slices ``first`` to ``last`` (exclusive) of a text."""
    bounds = [*slices, len(ids)]
    return b"".join(tokens[i] for i in ids[bounds[first]:bounds[last]])


@query("op6_scanned_byte_bpe")
def op6_scanned_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
