"""SimHash near-duplicates: Golay-code keys find fingerprints within two bits of each other.

A fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most two
bits, at least one segment is equal (pigeonhole), and the next segment differs in at most two bits.
The binary Golay code of 23 bits is perfect: every word decodes to one codeword within three bits.
The codewords to which a word and its one-bit neighbours decode number one or six, and two words
within two bits share one of them: that of the word half way. So a fingerprint gets, per segment
taken as equal, up to six keys of that segment and a codeword index of the next segment.

Fingerprints that share a key are joined and verified. A crowded key is not expanded into all
pairs: its members are sent to the 65 words within one bit, and those that meet at such a word are
linked to the smallest of them, which are exactly the pairs within two bits, chained.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like others.
Repeated rows each get a row. Rows without doc_id get the component of their fingerprint, if any.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmlens.llm.components import components
from firmlens.llm.registry import query, table
from firmlens.llm.scratch import stored

SEED, SHINGLE, RADIUS = 42, 3, 2
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with more members than this are linked through words half way instead of by pairs.
PAIRS_UP_TO = 48
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """64 majority bits over the hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    from_, to = starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(to), 1 << 16):
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(from_[k:k + (1 << 16)], to[k:k + (1 << 16)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(to), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    def of(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(of, "doc_id bigint, fp bigint")


def decoder() -> np.ndarray:
    """Codeword index (0..4095) of each of the 2^23 words.

    The upper 12 bits of a codeword are its index, the lower 11 the remainder that makes it a
    multiple of the generator. Subtracting the error of the word's remainder leaves the codeword.
    """
    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> bit & 1, GENERATOR << bit - 11, 0)
        return words

    ones = 1 << np.arange(23)
    two = (ones[:, None] | ones)[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | ones).ravel())
    errors = np.unique(np.concatenate(([0], ones, two, three)))
    by_remainder = np.zeros(2048, np.int64)
    by_remainder[remainder(errors)] = errors
    high = remainder(np.arange(4096) << 11)
    index = np.empty(1 << 23, np.int16)
    for first in range(0, 1 << 23, 1 << 18):  # a part at a time, so that a worker holds little besides the table
        words = np.arange(first, first + (1 << 18))
        index[words] = (words ^ by_remainder[high[words >> 11] ^ words & 2047]) >> 11
    return index


def keys_of(fps: np.ndarray, decode: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: for each segment taken as equal, the codeword indices of the next."""
    rows, keys = [], []
    words = fps.astype(np.uint64)
    for i, (low, bits) in enumerate(SEGMENTS):
        same = (words >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        next_low, next_bits = SEGMENTS[(i + 1) % len(SEGMENTS)]
        near = ((words >> np.uint64(next_low)) & np.uint64((1 << next_bits) - 1)).astype(np.int64)
        codes = np.sort(decode[near[:, None] ^ np.concatenate(([0], 1 << np.arange(next_bits)))], axis=1).astype(np.int64)
        fresh = np.ones(codes.shape, bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        at, slot = np.nonzero(fresh)
        rows.append(at)
        keys.append(i << 40 | same.astype(np.int64)[at] << 12 | codes[at, slot])
    return np.concatenate(rows), np.concatenate(keys)


def golay_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, fp) for every key of every distinct fingerprint."""
    def of(batches):
        decode = decoder()
        for frame in batches:
            rows, keys = keys_of(frame["fp"].to_numpy().view(np.uint64), decode)
            yield pd.DataFrame({"key": keys, "node": frame["node"].to_numpy()[rows], "fp": frame["fp"].to_numpy()[rows]})

    return nodes.select("node", "fp").mapInPandas(of, "key bigint, node bigint, fp bigint")


def links(nodes: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Edges (a, b) that connect the same nodes as all pairs of fingerprints within two bits do."""
    keys = stored(golay_keys(nodes), "keys")
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = stored(keys.join(sizes, "key"), "shared")
    few = shared.filter(F.col("n") <= pairs_up_to)
    left, right = few.select("key", F.col("node").alias("a"), F.col("fp").alias("fa")), few.select("key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    pairs = left.join(right, "key").filter("a > b").filter(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= RADIUS).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    half_way = (shared.filter(F.col("n") > pairs_up_to)
                .select("key", "node", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("middle")))
    # distinct fingerprints within one bit of a word: at most 65 rows a group
    least = F.min("node").over(Window.partitionBy("key", "middle"))
    chained = half_way.select(F.col("node").alias("a"), least.alias("b")).filter("a <> b")
    return pairs.unionByName(chained).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per document."""
    prints = stored(fingerprints(documents), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(links(nodes.filter("node is not null")))
    classes = stored(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@query("op3_golay_near_duplicates")
def op3_golay_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id (one row of it, if repeated).

    Rows without doc_id cannot be told apart and stay.
    """
    found = near_duplicates(docs)
    keep = stored(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "keep")
    # merge joins at every size: the kept ids grow with the input and are never broadcast
    once = docs.join(keep.filter("n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    repeated = docs.join(keep.filter("n > 1").select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(repeated).unionByName(docs.filter("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
