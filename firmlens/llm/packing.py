"""Best-fit packing of token sequences, certified by dual feasible functions.

Documents become token ids; longer ones are cut into full pieces and a rest. Pieces are dealt to
partitions of bounded size, each packed by best-fit decreasing. Dual feasible functions give a lower
bound on the bins that a partition's lengths need. A partition that reaches its bound is certified;
the others have a gap. As long as the total is above the bound for all lengths, partitions with gaps
give up the documents of their unfilled bins (certified ones those of their emptiest bin); these are
dealt anew, packed again, and kept if they fill fewer bins; if not, another deal is tried. Lengths reach the driver as a histogram
of at most ``capacity`` rows.

Null and empty texts are documents of the end token alone. Repeated rows are packed each on its own.
Bins never leave the partition that filled them, so a lost task is simply run again.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table
from firmlens.llm.scratch import stored

CAPACITY, END_ID = 4096, 1
#: Rows that one packing task holds, and rounds of exchange at most.
PART_ROWS, ROUNDS = 200_000, 8
#: Words whose ids a Python worker remembers.
REMEMBERED = 900_000
#: Characters of texts whose unknown words are encoded together.
GROUP_CHARS = 1 << 18


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of words without ASCII white space.

    The tokenizer drops white space and no rule of it reaches across, so the ids of a text are those
    of its words in order.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark = "\x01"
        self.mark_ids = self._encode([self.mark])[0]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a run of letters
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.tails = {t.encode(): f.tobytes() for t, f in zip(".,!", self._encode([*".,!"]))} | {b"": b""}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _core(word: bytes) -> tuple[bytes, bytes]:
        """The word without a mark that follows an ASCII letter, which is split off anyway, and in lower case if it is ASCII."""
        tail = word[-1:] if word[-1:] in (b".", b",", b"!") and word[-2:-1].isalpha() else b""
        core = word[:-1] if tail else word
        return core.lower() if core.isascii() else core, tail

    def _learn(self, words: set[bytes]) -> None:
        """Encode the cores of unknown words, a thousand at a time, and put the words together from them."""
        cores = {w: self._core(w) for w in words}
        unknown = {c for c, _ in cores.values() if c not in self}
        letters = [c for c in unknown if c.decode().isalpha()]
        odd = [c for c in unknown if b"\x01" in c]
        marked = [c for c in unknown.difference(letters) if b"\x01" not in c]
        for k in range(0, len(letters), 1000):
            part = letters[k:k + 1000]
            ids = self._encode([b" ".join(part).decode()])[0]
            ends = np.flatnonzero(self.closes[ids]) + 1
            self._keep(part, ids, [0, *ends[:-1].tolist()], ends.tolist())
        for k in range(0, len(marked), 1000):
            part = marked[k:k + 1000]
            ids = self._encode([f" {self.mark} ".join(c.decode() for c in part)])[0]
            marks = np.flatnonzero(ids == self.mark_ids[0]).tolist() if len(self.mark_ids) == 1 else []
            self._keep(part, ids, [0, *(m + 1 for m in marks)], [*marks, len(ids)])
        self._keep_each(odd)
        self.update([(w, self[c] + self.tails[t]) for w, (c, t) in cores.items()])

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        """Each word's part of the ids, if there are as many parts as words."""
        if len(ends) != len(words):
            self._keep_each(words)
            return
        raw = ids.tobytes()
        self.update((w, raw[4 * a:4 * b]) for w, a, b in zip(words, starts, ends))

    def _keep_each(self, words: list[bytes]) -> None:
        self.update((w, f.tobytes()) for w, f in zip(words, self._encode([w.decode() for w in words])))

    def ids_of(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of every text; words are learned for a group of texts at a time."""
        group, size = [], 0
        for text in texts:
            group.append((text or "").encode().split())
            size += len(text) if text else 0
            if size >= GROUP_CHARS:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[list[bytes]]) -> list[bytes]:
        words = set(chain.from_iterable(group))
        unknown = {w for w in words if w not in self}
        if len(self) + 2 * len(unknown) > REMEMBERED:
            self.clear()
            unknown = words
        if unknown:
            self._learn(unknown)
        return [b"".join(map(self.__getitem__, w)) for w in group]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def token_pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit numbers."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_ids(path)
        for batch in batches:
            rows = []
            for at, ids in enumerate(memory.ids_of(batch.column("text").to_pylist())):
                ids += end
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    rows.append((at, k, start // 4, len(part) // 4, part))
            at, *columns = zip(*rows) if rows else ((),) * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]],
                                             ["doc_id", "piece", "start", "length", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pieces, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that the lengths need at least: the best of three families of dual feasible functions."""
    if not len(lengths):
        return 0
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 41):  # rounded multiples of 1/k
        up = (k + 1) * x
        value = np.where(up % capacity == 0, x * k, up // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    for e in range(1, capacity // 2 + 1):
        large = x > capacity - e  # these count as whole bins, those under e as nothing
        value = np.where(large, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((value * n).sum()) // capacity))
        q = capacity // e
        value = np.where(2 * x > capacity, q - (capacity - x) // e, np.where(x >= e, 1, 0))
        best = max(best, -(-int((value * n).sum()) // q))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item by best-fit decreasing, and the free space of every bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_free[room].pop()
            if not by_free[room]:
                mask ^= 1 << room
        else:
            room, chosen = capacity, len(free)
            free.append(capacity)
        bins[item], offsets[item] = chosen, capacity - room
        free[chosen] = room - size
        if room > size:
            by_free[room - size].append(chosen)
            mask |= 1 << room - size
    return bins, offsets, np.array(free, np.int64)


MARKS = ("sequence_id", "offset", "unfilled", "part_bins", "part_bound")


def packed_partitions(items: DataFrame, size: str, capacity: int, n_parts: int, turn: int) -> DataFrame:
    """Adds sequence_id, offset, the bins and the lower bound of the partition, and unfilled (to be given up if bins are to be saved).

    The first deal spreads the rows evenly; each later one is another deal of the stored rows.
    """
    names = [c for c in items.columns if c not in MARKS]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        held = pa.Table.from_batches(full)
        lengths = held.column(size).to_numpy().astype(np.int64)
        bins, offsets, free = best_fit(lengths, capacity)
        values, counts = np.unique(lengths, return_counts=True)
        bound = lower_bound(values, counts, capacity)
        give = free > 0
        if len(free) == bound:  # certified
            give &= np.arange(len(free)) == free.argmax()
        base = turn << 56 | TaskContext.get().partitionId() << 32
        n = len(lengths)
        for name, column in zip(MARKS, (bins + base, offsets, give[bins], np.full(n, len(free)), np.full(n, bound))):
            held = held.append_column(name, pa.array(column))
        yield from held.combine_chunks().to_batches()

    types = dict(items.dtypes)
    ddl = ", ".join([f"`{c}` {types[c]}" for c in names] + ["sequence_id bigint", "offset bigint", "unfilled boolean", "part_bins bigint", "part_bound bigint"])
    rows = items.select(*names)
    dealt = rows.repartition(n_parts, F.xxhash64(F.monotonically_increasing_id(), F.lit(turn))) if turn else rows.repartition(n_parts)
    return dealt.mapInArrow(pack, ddl)


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id, offset and the certificate: bins (part_bins) and lower bound (part_bound) of the partition that packed the row.

    Items have 1 to ``capacity`` units; other columns are carried along unread, but for those of the names added, which are replaced.
    Rounds end when the total reaches the bound of all lengths, when one partition holds all that can move, after ``rounds``, or after two
    deals in a row that saved nothing.
    """
    items = stored(items, "items")
    seen = items.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    bound = lower_bound(np.array([r[0] for r in seen]), np.array([r["n"] for r in seen]), capacity)

    def parts(n_rows: int) -> int:
        return max(1, -(-n_rows // part_rows))

    def bins(df: DataFrame) -> int:
        return df.filter("offset = 0").count()

    moving = stored(packed_partitions(items, size, capacity, parts(sum(r["n"] for r in seen)), 0), "packed")
    done, total, idle = None, bins(moving), 0
    for turn in range(1, rounds + 1):
        if total <= bound or idle == 2:
            break
        given = moving.filter("unfilled")
        n_parts = parts(given.count())
        again = stored(packed_partitions(given, size, capacity, n_parts, turn), "packed")
        saved = bins(given) - bins(again)
        if saved > 0:
            settled = moving.filter("not unfilled")
            done = settled if done is None else done.unionByName(settled)
            moving, total, idle = again, total - saved, 0
        elif n_parts == 1:
            break
        else:
            idle += 1
    return (moving if done is None else done.unionByName(moving)).drop("unfilled")


@query("op2_certified_best_fit")
def op2_certified_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return pack(token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
