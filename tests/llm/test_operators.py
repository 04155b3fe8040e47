"""The corpus operators against brute force and on odd inputs."""
import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from firmlens.llm import (block_labeller, byte_bpe, hamming_index, licences, line_quality, packing, personal_data, quotations, simhash, web_archive)
from firmlens.llm.registry import importable

NOTICE = "Released under the MIT License."
TEXTS = [None, "", " \n\t ", "one", "A b c d e f", "a B c d E f", "x@y.zz and 1.2.3.4 and 1.2.3.400, +1 (555) 555-0100; 4111 1111 1111 1111 token = \"0123456789abcdef\"",
         f"some words\n{NOTICE}\nmore words", "l1 l1 l1\nl1 l1 l1\nz", "é ß 中文 don't  !!\r\n", "word " * 3000, "word " * 3000, "#" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = [(k, t, 1, 2, "n", [1]) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], 1, 2, "n", [1])]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, n long, unit string, ids array<int>").repartition(2)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 2:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_fingerprints_and_components(docs):
    found = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(t) for t in TEXTS]
    assert found == {(k, f - (f >> 63 << 64), r) for k, (f, r) in enumerate(zip(fps, slow_components(fps)))}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("pairs_up_to", [1, 3, 48])
def test_links_lose_no_pair(spark, pairs_up_to):
    importable(spark)
    pick = random.Random(5)
    fps = [pick.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # a dense group and chains
        f = pick.choice(fps)
        for _ in range(pick.randint(1, 3)):
            f ^= 1 << pick.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(k, f - (f >> 63 << 64)) for k, f in enumerate(fps)], "node long, fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, pairs_up_to)).collect()}
    assert [found.get(k, k) for k in range(len(fps))] == slow_components(fps)


def test_golay_decoding_is_perfect():
    decode = simhash.decoder()
    pick = np.random.default_rng(0)
    words = pick.integers(0, 1 << 23, 200)
    for w in words.tolist():  # two words within two bits share the codeword of the word half way
        v = w ^ 5
        assert {int(decode[w ^ e]) for e in [0, *(1 << i for i in range(23))]} & {int(decode[v ^ e]) for e in [0, *(1 << i for i in range(23))]}
    assert np.bincount(decode).tolist() == [2048] * 4096  # balls of radius 3 fill the space


def slow_base(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(windows) < 400 else set(range(len(words)))
    lines = (text or "").split("\n")
    dup = sum(bool(re.search("[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_quality_counts(docs):
    got = {r["doc_id"]: r for r in line_quality.judge(docs, None).collect()}
    for k, text in enumerate(TEXTS):
        n = slow_base(text)
        assert tuple(got[k][c] for c in line_quality.MEASURES) == n
        assert got[k]["kept"] == (not got[k]["base_failed"]) and got[k]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert line_quality.judge(docs.limit(0), None).count() == 0


def test_viterbi_against_all_sequences():
    g = np.random.default_rng(2)
    field = line_quality.Field(g.normal(size=3), g.normal(size=(2, 2)), g.normal(size=2))
    lines = np.array([1, 4, 2, 6])
    features = g.normal(size=(lines.sum(), 3))
    labels, at = field.decode(features, lines), 0
    for n in lines:
        score = features[at:at + n] @ field.weights
        best = max(range(1 << n), key=lambda y: field.start[y & 1] + sum(score[i] * (y >> i & 1) for i in range(n)) + sum(field.move[y >> i & 1, y >> i + 1 & 1] for i in range(n - 1)))
        assert labels[at:at + n].tolist() == [best >> i & 1 for i in range(n)]
        at += n


def test_held_out_quality(spark):
    importable(spark)
    d = "/root/testdata/sf0.1"  # enough labelled documents of each class to train on a half
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = line_quality.train(documents, labels.filter("doc_id % 2 = 0"))
    judged = line_quality.judge(documents, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert judged[(judged.quality == 1) & ~judged.base_failed].kept.mean() > 0.97
    assert judged[judged.quality == 0].kept.mean() < 0.02  # by the field or by the base rules


def test_packing(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    got = packing.token_pieces(docs, capacity=100).toPandas().sort_values(["doc_id", "piece"])
    for k, text in enumerate(TEXTS):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        part = got[got.doc_id == k].drop_duplicates(["piece"])
        assert b"".join(part.ids) == np.array(ids, "<u4").tobytes() and part.start.tolist() == list(range(0, len(ids), 100))
    packed = packing.pack(packing.token_pieces(docs, capacity=100), capacity=100, part_rows=20).toPandas().sort_values(["sequence_id", "offset"])
    assert len(packed) == len(got) and packed.groupby("sequence_id").length.sum().max() <= 100
    assert (packed.offset == packed.groupby("sequence_id").length.cumsum() - packed.length).all()
    assert packing.pack(packing.token_pieces(docs.limit(0))).count() == 0


def test_lower_bound_is_sound():
    pick = random.Random(3)
    for _ in range(30):
        lengths = np.array([pick.randint(1, 60) for _ in range(8)])
        fewest = next(k for k in range(1, 9) if _fits(sorted(lengths.tolist(), reverse=True), [60] * k))
        values, counts = np.unique(lengths, return_counts=True)
        assert packing.lower_bound(values, counts, 60) <= fewest <= len(packing.best_fit(lengths, 60)[2])


def _fits(items, room):
    return not items or any(_fits(items[1:], room[:k] + [r - items[0]] + room[k + 1:]) for k, r in enumerate(room) if r >= items[0] and r not in room[:k])


def test_byte_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert all(got[k]["ids"] == plain.encode_ordinary(t or "") and bytes(got[k]["decoded"]) == (t or "").encode() for k, t in enumerate(TEXTS))
    pick = random.Random(1)
    parts = ["'s", "s", "'re", "r", "e", "'ll", "l", "d", " ", "  ", "\n", "\t", "\x1c", "\x85", "1", "²", "é", "中", "#", "!", "😀", "a", "'"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(5000)] + ["a" * 500, " " * 99 + "x"]
    ids, n, slices, n_slices = byte_bpe.encoded(texts, byte_bpe.slices_of(path))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode_ordinary(t) for t in texts]
    last = np.split(slices, np.cumsum(n_slices)[:-1])[-1].tolist()
    assert byte_bpe.decode_slices(ids[-n[-1]:].tolist(), last, 1, len(last), byte_bpe.slices_of(path).tokens) == b" x"
    assert byte_bpe.encode(docs.limit(0)).count() == 0


def test_byte_bpe_works_in_bounded_parts(monkeypatch):
    """Texts, tokens and what is remembered are held a part at a time, whatever the batch; the parts lose no row."""
    texts = pa.array(["ab " * 10, None, "", "x" * 100, "c d"] * 40)
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 64)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2)
    ranges = list(byte_bpe._chunks(texts.slice(3)))
    assert [k for a, b in ranges for k in range(a, b)] == list(range(197)) and all(b - a == 1 or sum(len(t or "") for t in texts[3 + a:3 + b].to_pylist()) <= 64 for a, b in ranges)
    lists = pa.array([[1, 2], [], None, [3] * 30, [4]], pa.list_(pa.int32()))
    assert list(byte_bpe._chunks(lists.slice(1), 4)) == [(0, 2), (2, 3), (3, 4)] and list(byte_bpe._chunks(lists.slice(5), 4)) == []
    memory = byte_bpe.Slices(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = byte_bpe.token_table(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for a, b in ranges:
        part = [t or "" for t in texts[3 + a:3 + b].to_pylist()]
        ids, n, slices, n_slices = byte_bpe.encoded(part, memory)
        assert byte_bpe.decoded(byte_bpe._lists(ids, n), byte_bpe._lists(slices, n_slices), tokens).to_pylist() == [t.encode() for t in part]
        memory["y" * 300]
    assert len(memory) <= 2 >= len(memory.before) and "y" * 300 not in memory


def test_archives(spark):
    importable(spark)
    pages = [(1, "http://M.example.com/a?b#c", "<p>é</p>"), (2, "http://m.example.com/a?b", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "https://u@h:80", "x\r\n\r\ny"), (5, "https://u@h:80", "x\r\n\r\ny")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, size int")
    index, lines = web_archive.archive(df)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["digest"], bytes(r["payload"])) for r in web_archive.read_back(index, lines, 3).collect())
    largest = {}
    for p, _, h in pages:
        largest[h or ""] = max(p, largest.get(h or "", 0))
    want = []
    for p, _, h in pages:
        raw, to = (h or "").encode(), largest[h or ""]
        want.append((p, "response" if to == p else "revisit", None if to == p else to, base64.b32encode(hashlib.sha1(raw).digest()).decode(), raw if to == p else b""))
    assert got == sorted(want, key=repr) or sorted(got, key=repr) == sorted(want, key=repr)
    assert [f["X-Page-Id"] for f, _ in web_archive.look_up(index, spark, ["HTTP://m.example.com/a?b"])] == ["1", "2"]
    assert web_archive.read_back(*web_archive.archive(df.limit(0)), 1).count() == 0


def test_index_of_many_blocks(spark):
    """Repeated keys over several blocks and parts, pages without id, and keys that are not there."""
    importable(spark)
    rows = [(f"com,h{k % 7})/{k % 5}", None if k % 9 == 0 else k // 2, f"f{k % 3}", 10 * k, k) for k in range(400)]
    lines = spark.createDataFrame(rows, "key string, page_id long, file string, start long, size long")
    path = "file://" + web_archive._absolute(web_archive.folder(spark, "warc"))
    index = web_archive.build_index(lines, path, 5, block_lines=7)
    assert 1 < len(index.parts) <= 5
    finder = web_archive.Finder(index)
    for key in sorted({r[0] for r in rows}) + ["", "com,h3)", "zzz"]:
        assert sorted(map(tuple, finder.lines((key, 0, 0), (key, 2, 0))), key=repr) == sorted((r for r in rows if r[0] == key), key=repr)
    for r in rows[::13]:
        place = web_archive._place(r[0], r[1])
        assert sorted(map(tuple, finder.lines(place, place)), key=repr) == sorted((x for x in rows if x[:2] == r[:2]), key=repr)
    finder.close()


def test_large_ids_beside_null_ids(spark):
    """Ids that no double holds come through every operator in one batch with null ids."""
    importable(spark)
    big = [2 ** 53 + 1, None, 2 ** 53 + 3, -(2 ** 53) - 1]
    texts = ["some words " * 30, "other words", "some words " * 30, None]
    docs_ = spark.createDataFrame([(i, t) for i, t in zip(big, texts)], "doc_id long, text string").coalesce(1)
    want = sorted(map(repr, big))

    def ids(df, c="doc_id"):
        return sorted(repr(r[c]) for r in df.select(c).collect())

    packed = packing.pack(packing.token_pieces(docs_))
    assert ids(packed) == want and {r["part_bins"] >= r["part_bound"] for r in packed.collect()} == {True}
    near = simhash.near_duplicates(docs_)
    assert ids(near) == want
    assert {r["doc_id"]: r["component_id"] for r in near.collect()}[2 ** 53 + 3] == 2 ** 53 + 1
    assert ids(line_quality.judge(docs_, None)) == want
    pages = spark.createDataFrame([(i, f"http://h/{k}", f"<p>{t}</p>") for k, (i, t) in enumerate(zip(big, texts))], "page_id long, url string, html string").coalesce(1)
    index, lines = web_archive.archive(pages)
    back = web_archive.read_back(index, lines, 2)
    assert ids(back, "page_id") == want
    assert {r["page_id"]: r["refers_to"] for r in back.collect()}[2 ** 53 + 1] == 2 ** 53 + 3
    maker = block_labeller.PageMaker(["w"], 1)
    labeller = block_labeller.fit([(block_labeller.blocks_of(maker.page()[0]), None) for _ in range(0)] or [([(("p", "in:p"), "a b.", 0)], [True])], passes=1)
    assert ids(block_labeller.extract(pages, labeller), "page_id") == want


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    importable(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    body = " ".join(f"word{k}" for k in range(60))
    names = "doc_id long, text string, kept string, n_words int, base_failed int, cands string, spans string, row int, new string, n_chars long, `a.b` int, n int, fp string, component_id int"
    rows = [(2 ** 53 + 1, f"{body} mail x@y.zz", "k", 1, 2, "c", "s", 3, "n", len(body) + 12, 4, 5, "f", 6), (None, body, None, None, None, None, None, None, None, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, names).coalesce(1)
    one = line_quality.stage(spark, df, str(tmp_path))
    assert one.columns == df.columns and sorted(map(repr, one.collect())) == sorted(map(repr, df.collect()))
    two = simhash.stage(spark, one, "")
    assert two.columns == df.columns and sorted(map(repr, two.collect())) == sorted(map(repr, df.collect()))
    three = personal_data.stage(spark, two, "").collect()
    want = [r if r[0] is None else (r[0], f"{body} mail [email]", *r[2:9], len(body) + 13, *r[10:]) for r in rows]
    assert sorted(repr(tuple(r)) for r in three) == sorted(map(repr, want))


def test_nearest_vectors(spark):
    importable(spark)
    g = np.random.default_rng(0)
    v = np.concatenate([g.normal(size=(600, 16)), g.normal(size=(1, 16)) + 0.01 * g.normal(size=(200, 16))]) * g.uniform(0.5, 2, (800, 1))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16)]
    df = hamming_index.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = hamming_index.search(df, df.filter("vec_id % 20 = 0"), index_block=300, query_block=16).toPandas()
    hits = 0
    for q in range(0, 800, 20):
        score = (v * v[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(800), -score)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, score[mine.vec_id])
        hits += len(set(best) & set(mine.vec_id))
    assert hits / (40 * 20) >= 0.9
    assert hamming_index.search(df.limit(0), df).count() == 0


def test_probes_retrieve_every_code_within_the_radius():
    g = np.random.default_rng(3)
    centres = g.integers(0, 1 << 16, (5, 16), dtype=np.uint16)
    codes = np.concatenate([g.integers(0, 1 << 16, (300, 16), dtype=np.uint16), *(c ^ (1 << g.integers(0, 16, (40, 16))).astype(np.uint16) for c in centres)])
    block = hamming_index.Block(codes)
    for query in [*centres, *codes[:20], g.integers(0, 1 << 16, 16, dtype=np.uint16)]:
        distance = np.bitwise_count(codes ^ query).sum(axis=1)
        for enough in (1, 30, 400, 10 ** 6):
            found, radius, reached = block.within(query, enough)
            assert found.tolist() == np.flatnonzero(distance <= radius).tolist() and len(found) >= min(enough, len(codes)) and reached >= len(found)
            assert (distance < radius).sum() < enough
    assert block.within(centres[0], 10)[2] < 100  # near codes are reached without the rest


def test_nearest_with_repeats_and_ties(spark):
    importable(spark)
    rows = [(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [0.5, 0.0, 0.0]), (3, [0.0, 2.0, 0.0]), (2 ** 53 + 1, [0.25, 0.0, 0.5])]
    df = hamming_index.clean_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, code string, g int"), "vec_id", "embedding")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hamming_index.search(df, df.filter("vec_id in (1, 3)"), k=3).collect())
    assert got == [(1, 1, 0, 1.0), (1, 2, 2, 1.0), (1, 3, 2 ** 53 + 1, 0.25), (3, 1, 0, 2.0), (3, 2, 1, 0.0), (3, 3, 2, 0.0)]


def test_block_labels_on_held_out_layouts():
    words = [f"w{k}" for k in range(300)]
    maker, training = block_labeller.PageMaker(words, 1), []
    for _ in range(200):
        html, texts = maker.page()
        blocks = block_labeller.blocks_of(html)
        training.append((blocks, [t in texts and "title" not in p for p, t, _ in blocks]))
    reader = block_labeller.fit(training[:150], passes=40)
    found = reader.content([b for b, _ in training[150:]])
    assert np.mean([y == bool(x) for (_, labels), c in zip(training[150:], found) for y, x in zip(labels, c)]) > 0.95
    assert block_labeller.blocks_of(None) == [] and reader.content([[]])[0].tolist() == []
    assert [t for _, t, _ in block_labeller.blocks_of("<p>a &amp;\n b<br>c<p>d<script>x</script>")] == ["a & b c", "d"]


def test_article_blocks_of_given_pages(spark):
    importable(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in block_labeller.extract(pages, block_labeller.train(pages)).collect()}
    want = {r["page_id"]: "\n".join(t for p, t, _ in block_labeller.blocks_of(r["html"]) if "article" in p) for r in pages.select("page_id", "html").collect()}
    assert found.keys() == want.keys()
    assert sum(found[k] != want[k] for k in want) <= 0.01 * len(want)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_personal_data(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(docs).collect()}
    for k, text in enumerate(TEXTS):
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                    want.append((m.start(), m.end(), kind))
        assert sorted((x["s"], x["e"], x["kind"]) for x in got[k] if x["strict"]) == sorted(want)
    assert personal_data.stage(docs.sparkSession, docs, "").filter("doc_id = 6").first()["text"].startswith("[email] and [ip] and 1.2.3.400, [phone]")
    assert personal_data.personal_data(docs.limit(0)).count() == 0


def test_gazetteer_proposes_names_and_addresses(spark):
    importable(spark)
    texts = ["Dear Anna Schmidt, call Jean Dupont-Martin.", "He lives at 12 Old Mill Road, or 7 Elm St.", "12 apples on the Road", "Anna went", "x" * 5000 + " é Maria Lopez " + "y" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(texts[r["doc_id"]][x["s"]:x["e"]], x["kind"], x["gazetteer"], x["apart"]) for x in r["cands"] if x["gazetteer"]] for r in personal_data.candidates(df, ["doc_id"]).collect()}
    assert found == {0: [("Anna Schmidt", "name", 1, 1), ("Jean Dupont-Martin", "name", 1, 1)], 1: [("12 Old Mill Road", "address", 1, 1), ("7 Elm St", "address", 1, 1)],
                     2: [], 3: [], 4: [("Maria Lopez", "name", 1, 1)]}
    kept = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in personal_data.personal_data(df).collect()}
    assert kept[0] == ["name", "name"] and kept[1] == ["address", "address"]


def test_many_matches_in_one_text(spark):
    """Places of matches over many blocks and pieces, in a text of some megabytes."""
    importable(spark)
    pick = random.Random(1)
    text = " é ".join(f"{pick.randint(0, 255)}.{pick.randint(0, 255)}.1.{k % 300} w{k}" + "z" * 40 for k in range(20000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = personal_data.candidates(df, ["doc_id"]).first()["cands"]
    want = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
    assert [(x["s"], x["e"]) for x in got if x["kind"] == "ip"] == want and len(text) > 1_000_000


def test_expectation_maximisation_against_a_plain_loop():
    """Shares of two labelers' vote patterns, from counts drawn with known reliabilities."""
    pick, n = random.Random(4), len(personal_data.LABELERS)
    counts = {}
    for _ in range(4000):
        truth = pick.random() < 0.4
        votes = tuple((1 if (pick.random() < 0.9) == truth else -1) for _ in range(n))
        counts[votes] = counts.get(votes, 0) + 1
    patterns = sorted(("secret", v, c) for v, c in counts.items())
    table, share = personal_data.reliabilities(patterns)
    assert all(abs(table[j, 1, 1] - 0.9) < 0.03 and abs(table[j, 1, 0] - 0.1) < 0.03 for j in range(n))
    for (_, votes, _), p in zip(patterns, share):  # Bayes' rule with the reliabilities that were drawn
        up, down = 0.4, 0.6
        for v in votes:
            up, down = up * (0.9 if v == 1 else 0.1), down * (0.1 if v == 1 else 0.9)
        assert abs(p - up / (up + down)) < 0.1
    model = personal_data.fit(patterns)
    assert all((model.kinds["secret"] + sum(w * v for w, v in zip(model.votes, votes)) > 0) == (p > 0.5) for (_, votes, _), p in zip(patterns, share) if abs(p - 0.5) > 0.3)


def test_long_secrets_are_taken_whole(spark):
    importable(spark)
    token = "aZ09_-" * 700
    jwt = f"eyJhbGciOi.{token}/+x.{token[:50]}=="
    user = "long.user-name_" * 20 + "x"
    texts = [f'api_key="{token}" end', f"token: {jwt}. Then", f"write to {user} [at] example [dot] com now", 'password = "abcdefghijkl"', ".-" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][x["s"]:x["e"]] for x in r["cands"] if x["kind"] in ("secret", "mail_words")] for r in personal_data.candidates(df, ["doc_id"]).collect()}
    assert found == {0: [f'api_key="{token}"'], 1: [f"token: {jwt}"], 2: [f"{user} [at] example [dot] com"], 3: [texts[3]], 4: []}


def against_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, want))


def test_licences(docs):
    rows = licences.scan(docs).collect()
    assert [(r["doc_id"], r["licence"], r["dice"]) for r in rows] == [(7, "MIT", 1.0)]
    assert licences.scan(docs.limit(0)).count() == 0
    for _, text in licences.TEMPLATES:  # a match lacks at most a third of the bigrams, so it holds a key word
        left = sum(c for p, c in licences.bigrams_of(text).items() if not set(p.split()) & set(licences.key_words(licences.TEMPLATES)))
        assert left < sum(licences.bigrams_of(text).values()) * licences.MIN_DICE / (2 - licences.MIN_DICE)


def test_licences_inside_longer_texts(spark):
    mit = licences.TEMPLATES[0][1].split()
    body = " ".join(mit[:67]) + ".\n\n" + " ".join(mit[67:87]) + ":\n\n" + " ".join(mit[87:])
    other = " ".join(f"w{k}" for k in range(120))
    apache = next(t for name, t in licences.TEMPLATES if name == "Apache-2.0" and len(t) > 100).split()
    header = "\n#\n".join("# " + " ".join(apache[k:k + 9]) for k in range(0, len(apache), 9))
    rows = [(1, f"{other}\n\n{body}\n\n{other}"), (2, f"{header}\n\nimport x\n{other}"), (3, f"a b c\nd e Released under the\nMIT License. f g h {other}"),
            (4, f"{other} licensed under CC BY 4.0 {other}"), (5, f"{body}\n{other}\n{body} {other} software"), (6, f"{other}\n\n{' '.join(mit[:80])}\n\n{other}"), (7, NOTICE)]
    got = {(r["doc_id"], r["licence"]): (r["dice"], r["n_passages"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == {(1, "MIT"), (2, "Apache-2.0"), (3, "MIT"), (4, "CC-BY-4.0"), (5, "MIT"), (7, "MIT")}
    assert all(dice == 1.0 for dice, _ in got.values()) and got[1, "MIT"][1] == got[5, "MIT"][1] == 1  # equal passages count once


def test_quotation_threads(spark):
    importable(spark)
    a, b = "The first message says this at length.\nWith a second line of words.", "A different opening for the talk."
    rows = [(1, 0, "user", a), (1, 1, "user", b), (1, 2, "assistant", "On Monday x wrote:\n> " + a.replace("\n", "\n> ") + "\n\nI agree."),
            (1, 3, "user", ">> the first  MESSAGE says this at length.\n> I agree, mostly and fully.\nnew"), (1, 4, "user", "> " + b + "\nlater reply to b"),
            (1, 5, "user", "> later reply to b\ndeeper"), (2, 0, "user", "> " + b + "\nfrom elsewhere"), (2, 1, None, None), (3, 0, "user", ""), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got, want = against_sql(quotations.conversations(df), quotations.SQL, conversations=pd.DataFrame(rows, columns=df.columns).convert_dtypes())
    assert got == want
    kept = {(r["conv_id"], r["turn"]): r for r in quotations.conversations(df).collect()}
    assert kept[1, 2]["text"] == "I agree." and kept[1, 2]["parent_turn"] == 0 and kept[1, 5]["thread_turn"] == 1 and kept[1, 5]["depth"] == 2
    assert kept[2, 0]["n_sources"] == 1 and kept[2, 0]["parent_turn"] is None
    assert quotations.conversations(df.limit(0)).count() == 0


def test_quotations_of_other_conversations(spark):
    importable(spark)
    said = "A passage that several people write."
    rows = [(5, 2, "user", f"> {said}\nnew"), (5, 4, "user", said), (9, 0, "user", said), (7, 3, "user", said), (7, 1, "user", f"> {said}\nmore"), (8, 0, "user", f"> {said}")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["turn"], r["from_conv"], r["from_turn"]) for r in quotations.links(df).collect()}
    assert found == {(5, 2, 7, 3), (7, 1, 5, 4), (8, 0, 5, 4)}  # the smallest other conversation, also where the quoting one is the smallest
    got, want = against_sql(quotations.conversations(df), quotations.SQL, conversations=pd.DataFrame(rows, columns=df.columns).convert_dtypes())
    assert got == want
    kept = {(r["conv_id"], r["turn"]): r for r in quotations.conversations(df).collect()}
    assert kept[5, 2]["n_linked_passages"] == kept[5, 2]["n_sources"] == 1


def test_short_quotations(spark):
    importable(spark)
    rows = [(1, 0, "user", "Yes, agreed"), (1, 1, "user", "ok thanks"), (1, 2, "user", "> Yes, agreed\nthen this"), (1, 3, "user", "> 好的\nno source"), (1, 4, "user", "好的"),
            (1, 5, "user", "> 好的\nhere"), (1, 6, "user", "> ---\n\n> ok thanks\n> and unheard words"), (1, 7, "user", "ok\na longer line of words"),
            (1, 8, "user", "> ok\n> a longer line of words\nx"), (2, 0, "user", "> ok thanks\nnot from elsewhere"), (1, 9, "user", "ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = {(r["conv_id"], r["turn"]): r for r in quotations.conversations(df).collect()}
    assert {k: r["parent_turn"] for k, r in kept.items() if r["parent_turn"] is not None} == {(1, 2): 0, (1, 5): 4, (1, 6): 1, (1, 8): 7}
    assert kept[1, 5]["thread_turn"] == 4 and kept[1, 8]["n_sources"] == 1 and kept[2, 0]["n_linked_passages"] == 1
    with_floor = {(r["conv_id"], r["turn"]): r for r in quotations.conversations(df, min_chars=12).collect()}
    assert with_floor[2, 0]["n_linked_passages"] == 0 and with_floor[1, 5]["thread_turn"] == 4
    got, want = against_sql(quotations.conversations(df), quotations.SQL, conversations=pd.DataFrame(rows, columns=df.columns).convert_dtypes())
    assert got == want
