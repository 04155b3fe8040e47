"""Repeated strings (op13) against a dictionary of all windows, deep-shallow sorting against sorted()."""
import hashlib
import random

import numpy as np
import pytest

from firmlens.llm import suffix_dedup
from firmlens.llm.registry import QUERIES, importable

SF = "/root/testdata/sf0.001"


def slow_spans(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            seen.setdefault(t[j:j + length], []).append((i, j))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i][j:j + length] = True
    out = []
    for t, g in zip(texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def some_texts(seed, n=60, alphabet="ab", longest=60, passages=3):
    pick = random.Random(seed)
    word = lambda k: "".join(pick.choice(alphabet) for _ in range(k))
    shared = [word(pick.randint(5, longest)) for _ in range(passages)]
    texts = [word(pick.randint(0, longest)) + (pick.choice(shared) if pick.random() < 0.6 else "") + word(pick.randint(0, longest)) for _ in range(n)]
    return texts + texts[:3]


def found(df, length, gram, group):
    got = suffix_dedup.deduplicated(df, length, gram, group).collect()
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans or [])
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def check(spark, texts, length, gram, group):
    importable(spark)
    rows = [(k, t, "x", 1, b"d", 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, id int, digest binary, part int").repartition(3)
    want = sorted((k, *s) for k, s in enumerate(slow_spans([(t or "").encode() for t in texts], length)))
    assert found(df, length, gram, group) == want


@pytest.mark.parametrize("seed,alphabet,length,gram,group", [(1, "ab", 20, 8, 2), (2, "abcdefgh", 20, 8, 3), (3, "aé", 24, 4, 1), (4, "abcdefgh", 12, 8, 256)])
def test_spans_equal_brute_force(spark, seed, alphabet, length, gram, group):
    check(spark, some_texts(seed, alphabet=alphabet), length, gram, group)


def test_odd_texts(spark):
    line = "the same line of some words again and again, "
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 201, "b" * 450, "ab" * 300, line * 12, "x" + line * 9, "é" * 130, "é" * 130, line * 3 + "end"]
    check(spark, texts + [texts[8]], 200, 64, 256)


def test_near_copies_in_one_group(spark):
    """One passage with other words around it in every document: its segments crowd under one anchor."""
    pick = random.Random(7)
    passage = " ".join(pick.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(pick.randint(0, 99)) for _ in range(60))
    texts = ["".join(pick.choice("qwertz uiop") for _ in range(150)) + passage + "".join(pick.choice("qwertz uiop") for _ in range(150)) for _ in range(40)]
    check(spark, texts, 200, 64, 4)


def test_very_long_text_and_null_ids(spark):
    importable(spark)
    pick = random.Random(9)
    long = "".join(pick.choice("abcdefghijklmnop") for _ in range(1_300_000))
    texts = [long, long[700_000:700_300], "z" * 10 + long[-250:], "own " * 3]
    df = spark.createDataFrame([(None, texts[0]), (2 ** 53 + 1, texts[1]), (None, texts[2]), (2 ** 53 + 3, texts[3])], "doc_id long, text string").coalesce(1)
    saved, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 1 << 18
    try:
        got = found(df, 200, 64, 256)
    finally:
        suffix_dedup.CHUNK = saved
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(-1, 260, 250, 1), (-1, 1_300_000, 550, 2), (2 ** 53 + 1, 300, 300, 1), (2 ** 53 + 3, 12, 0, 0)]


def test_anchors_in_parts():
    text = ("".join(random.Random(4).choice("abc") for _ in range(5000))).encode()
    saved, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 700
    try:
        _, first, lead, span, *_ , repeats = suffix_dedup.anchors([text, b"", text[:100], text], 200, 64)
    finally:
        suffix_dedup.CHUNK = saved
    assert int(((span + 1) * repeats).sum()) == 2 * (5000 - 199) and (lead <= 136).all() and (span <= lead).all()


def test_deep_shallow_is_sorted():
    pick = random.Random(5)
    for _ in range(30):
        base = "".join(pick.choice("ab") for _ in range(90))
        strings = [(base[:pick.randint(0, 90)] + "".join(pick.choice("ab\0") for _ in range(pick.randint(0, 20)))).encode() for _ in range(pick.randint(1, 80))]
        order, shared = suffix_dedup.deep_shallow(strings)
        assert sorted(order.tolist()) == list(range(len(strings)))
        ranked = [strings[i] for i in order]
        assert ranked == sorted(strings)
        for a, b, s in zip(ranked, ranked[1:], shared[1:].tolist()):
            assert a[:s] == b[:s] and (a[s:s + 1] != b[s:s + 1] or a == b)


def test_empty_table(spark):
    importable(spark)
    assert suffix_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op13_deep_shallow_spans"](spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in rows], slow_spans([(r.text or "").encode() for r in rows], 200)))
