"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Every document is read whole. Counts that need no model (words, symbols, repeated lines and word
windows) come first; then Viterbi decoding finds the best label sequence of its lines, and the
share of word characters in content lines decides whether the document stays.

Nulls and empty texts count as texts without words: base_failed is true. Repeated rows are judged
each on its own. Columns other than doc_id and text are not read; those kept pass through as they are. Without labelled documents there
is no model and the base rules alone decide.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.llm.registry import query, table

#: Bounds of the training sample: labelled documents of each class, and lines a training document may have.
TRAIN_DOCS, TRAIN_LINES = 500, 40
#: Documents whose content lines hold a smaller share of the word characters are rejected.
MIN_CONTENT = 0.5
#: Texts are measured together up to this many bytes.
CHUNK_BYTES = 4 << 20

_SPACE, _SYMBOL, _UPPER, _LOWER, _DIGIT, _BANG, _PIPE, _INNER = (1 << i for i in range(8))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, *range(9, 14)]] |= _SPACE
_CLASS[list(b"#*$%&|<>")] |= _SYMBOL
_CLASS[ord("A"):ord("Z") + 1] |= _UPPER
_CLASS[ord("a"):ord("z") + 1] |= _LOWER
_CLASS[ord("0"):ord("9") + 1] |= _DIGIT
_CLASS[ord("!")] |= _BANG
_CLASS[ord("|")] |= _PIPE
_CLASS[0x80:0xC0] |= _INNER  # not the first byte of a code point
N_FEATURES = 10


def _repeated_windows(ids: np.ndarray) -> np.ndarray:
    """Marks the words that lie in a three-word window found twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < 4:
        return covered
    if int(ids.max()) < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pairs = np.unique(ids[:-1] << 31 | ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] << 31 | ids[2:]
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        hit = again[at] == keys
        covered[:-2] |= hit
        covered[1:-1] |= hit
        covered[2:] |= hit
    return covered


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text (words, word_chars, symbols, dup_lines, repeat_words), lines per text, features and word characters per line."""
    raw = [(t or "").encode() for t in texts]
    whole = b"\n".join(raw) + b"\n"
    flags = _CLASS[np.frombuffer(whole, np.uint8)]
    ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    text_ends = np.cumsum(lines) - 1  # its last line
    text_starts = text_ends - lines + 1

    def per_line(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return upto[ends] - upto[starts]

    def has(bit: int) -> np.ndarray:
        return (flags & bit) != 0

    space = has(_SPACE)
    first = ~space
    first[1:] &= space[:-1]
    word_at = np.flatnonzero(first)
    words = whole.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    line_of = np.searchsorted(ends, word_at)
    n_words = np.bincount(line_of, minlength=len(ends))
    upto_words = np.concatenate(([0], np.cumsum(n_words)))
    covered = np.zeros(len(ids), bool)
    repeat_words = np.zeros(len(raw), np.int64)
    dup = np.zeros(len(ends), bool)
    for k in range(len(raw)):
        a, b = upto_words[text_starts[k]], upto_words[text_ends[k] + 1]
        covered[a:b] = _repeated_windows(ids[a:b])
        repeat_words[k] = covered[a:b].sum()
        if lines[k] > 1:
            seen: set[bytes] = set()
            for j, line in enumerate(raw[k].split(b"\n"), int(text_starts[k])):
                if line in seen:
                    dup[j] = n_words[j] > 0
                seen.add(line)

    chars = per_line(~space & ~has(_INNER))
    symbols, upper, lower, digits, bangs, pipes = (per_line(has(b)) for b in (_SYMBOL, _UPPER, _LOWER, _DIGIT, _BANG, _PIPE))
    repeated = np.bincount(line_of, weights=covered, minlength=len(ends))
    size, count = np.maximum(chars, 1), np.maximum(n_words, 1)
    features = np.stack([np.ones(len(ends)), np.log1p(n_words) / 4, symbols / size * 4, upper / np.maximum(upper + lower, 1) * 2, digits / size * 2,
                         bangs / size * 4, pipes / count * 2, repeated / count * 2, dup.astype(float), np.minimum(chars / count, 20) / 10], axis=1)
    features[n_words == 0] = 0

    def per_text(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(values)))
        return upto[text_ends + 1] - upto[text_starts]

    counts = np.stack([per_text(n_words), per_text(chars), per_text(symbols), per_text(dup.astype(np.int64)), repeat_words], axis=1)
    return counts, lines, features, chars


class Field:
    """Two labels (0 content, 1 boilerplate): line weights for label 1, transition and start scores."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.weights, self.move, self.start = weights, move, start

    def decode(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Viterbi: the best label of every line, all texts side by side, position by position."""
        score = features @ self.weights
        order = np.argsort(-lines, kind="stable")
        sorted_lines, at = lines[order], (np.cumsum(lines) - lines)[order]
        longest = int(sorted_lines[0]) if len(lines) else 0
        active = len(lines) - np.searchsorted(sorted_lines[::-1], np.arange(longest), side="right")
        back = np.zeros((len(score), 2), np.int8)
        best = np.zeros((len(lines), 2))
        for t in range(longest):
            n = active[t]
            here = at[:n] + t
            if t == 0:
                best[:n] = self.start
            else:
                through = best[:n, :, None] + self.move
                back[here] = through.argmax(axis=1)
                best[:n] = through.max(axis=1)
            best[:n, 1] += score[here]
        labels = np.zeros(len(score), np.int8)
        state = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            here = at[:n] + t
            labels[here] = state[:n]
            state[:n] = back[here, state[:n]]
        return labels


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis)
    return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))


def fit(features: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = 80, chain: bool = True) -> Field:
    """Maximum conditional likelihood by gradient ascent, forward-backward over padded texts.

    Without ``chain`` transitions and start stay zero: each line is labelled for itself.
    """
    n, longest = len(lines), int(lines.max())
    inside = np.arange(longest) < lines[:, None]
    gold = np.zeros((n, longest), int)
    gold[inside] = labels
    params = np.zeros(features.shape[1] + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    follows = inside[:, 1:]
    seen_moves = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & follows).sum() for j in (0, 1)] for i in (0, 1)])
    seen_start = np.bincount(gold[:, 0], minlength=2)
    seen_features = features.T @ labels
    for step in range(1, steps + 1):
        w, move, start = params[:-6], params[-6:-2].reshape(2, 2), params[-2:]
        unary = np.zeros((n, longest, 2))
        unary[..., 1][inside] = features @ w
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = start + unary[:, 0]
        for t in range(1, longest):
            step_on = _log_add(fwd[:, t - 1, :, None] + move, 1) + unary[:, t]
            fwd[:, t] = np.where(inside[:, t, None], step_on, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step_back = _log_add(move + (unary[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(inside[:, t + 1, None], step_back, 0)
        z = _log_add(fwd[:, -1], 1)
        single = np.exp(fwd + bwd - z[:, None, None])
        pair = np.exp(fwd[:, :-1, :, None] + move + (unary + bwd)[:, 1:, None, :] - z[:, None, None, None]) * follows[..., None, None]
        gradient = np.concatenate([seen_features - features.T @ single[..., 1][inside], (seen_moves - pair.sum(axis=(0, 1))).ravel(),
                                   seen_start - single[:, 0].sum(axis=0)]) / n - 1e-3 * params
        if not chain:
            gradient[-6:] = 0
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
        params += 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(params[:-6], params[-6:-2].reshape(2, 2), params[-2:])


def train(documents: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> Field | None:
    """Fit the field on at most ``per_class`` labelled documents of each quality, in hash order.

    Lines take the label of their document first, and weights for single lines are fitted. Bad
    documents also hold good lines, so the chain is fitted to the labels that these weights prefer there.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = None
    for q in (0, 1):
        part = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    small = F.broadcast(picked)  # at most 2 * per_class narrow rows
    short = F.length("text") - F.length(F.translate("text", "\n", "")) < max_lines

    def features_of(batches):
        for frame in batches:
            for quality, text in zip(frame["quality"], frame["text"]):
                _, _, features, _ = measure([text])
                yield pd.DataFrame({"quality": [quality], "features": [features.ravel().tolist()]})

    rows = (documents.select("doc_id", "text").filter(short).join(small, "doc_id").select("doc_id", "quality", "text")
            .mapInPandas(features_of, "quality int, features array<double>").collect())
    rows.sort(key=lambda r: (r["quality"], r["features"]))
    if len({r["quality"] for r in rows}) < 2:
        return None
    features = np.concatenate([np.array(r["features"]).reshape(-1, N_FEATURES) for r in rows])
    lines = np.array([len(r["features"]) // N_FEATURES for r in rows])
    bad = np.repeat([1 - r["quality"] for r in rows], lines)
    single = fit(features, lines, bad, chain=False)
    return fit(features, lines, bad & single.decode(features, lines))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES):
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > start and size + n > limit:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(documents: DataFrame, field: Field | None, min_content: float = MIN_CONTENT, keep: list[str] | None = None) -> DataFrame:
    """Base counts, content share and verdict of every document; ``keep`` names input columns to carry along unread."""
    keep = ["doc_id"] if keep is None else keep
    own = "text" if "text" in keep else "__text"  # a text that is kept travels once
    chosen = documents.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else [F.col("text").alias(own)]))
    parts = None if field is None else (field.weights, field.move, field.start)

    def verdicts(batches):
        model = None if parts is None else Field(*parts)
        for batch in batches:
            texts = batch.column(own).to_pylist()
            for a, b in chunks(texts):
                found = pa.RecordBatch.from_pandas(_judged(texts[a:b], model, min_content), preserve_index=False)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), *found.columns],
                                                 [*keep, *found.schema.names])

    schema = T.StructType([chosen.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in MEASURES] + [
        T.StructField("base_failed", T.BooleanType()), T.StructField("n_lines", T.LongType()), T.StructField("n_content_lines", T.LongType()),
        T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return chosen.mapInArrow(verdicts, schema)


def _judged(texts: list[str | None], model: Field | None, min_content: float) -> pd.DataFrame:
    counts, lines, features, chars = measure(texts)
    content = np.ones(len(features), bool) if model is None else model.decode(features, lines) == 0
    ends = np.cumsum(lines)

    def per_text(values):
        upto = np.concatenate(([0], np.cumsum(values)))
        return upto[ends] - upto[ends - lines]

    share = per_text(chars * content) / np.maximum(per_text(chars), 1)
    out = pd.DataFrame(dict(zip(MEASURES, counts.T)))
    out["base_failed"] = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    out["n_lines"], out["n_content_lines"], out["content_share"] = lines, per_text(content), share
    out["kept"] = ~out["base_failed"] & (share >= min_content)
    return out


@query("op4_line_field_quality")
def op4_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return judge(documents, train(documents, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rules keep; columns besides the text travel as one struct, and all stay as they are, whatever their names."""
    field = train(docs, table(spark, sf_dir, "labels"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text"))
    kept = judge(held, field, keep=["row", "text"]).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
