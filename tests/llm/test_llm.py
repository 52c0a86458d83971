"""The training-data operators against brute force, round trips and SQL, with the cases that data throw up."""

import collections
import hashlib
import random
import time
import zlib
from array import array

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from veritab.llm import bpe, chat, exact_dedup, html_text, ngram_join, packing, quality, queries, suffix_dedup, token_store, topk
from veritab.llm.common import min_labels
from veritab.llm.encode import PieceEncoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def docs_of(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


ODD = [None, "", " ", "a", "a", "\n\t", "x  y \n z", words(3000, 1), words(3000, 1), words(40, 2), words(40, 2).upper(), "<|endoftext|> é İ Σ ΑΣ ŀ՘ 漢字", "no" * 400, "a b"]


# --- tokens


def test_encoders_equal_the_library():
    rng = random.Random(3)
    parts = ["a", "B", "İ", "Σ", "é", "́", " ", "  ", "\n", "\t", "1", "½", "'s", ",", ".", "!", "<|endoftext|>", "漢", "😀", "​", " ", "x,", "y.\n", "가", "\x1c"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for path, keep in ((WORD, False), (BYTE, True)):
        t = Tokenizer.from_file(path)
        want = [array("I", e.ids).tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
        assert PieceEncoder(path, keep, most=50).encode(texts) == want
        if path == WORD:
            got = bpe.WordBpe(path, most=50).encode(texts)
            assert [a for a, _ in got] == want
            assert [b for _, b in got] == [t.decode(array("I", w).tolist(), skip_special_tokens=False) for w in want]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoders_on_code_points(path):
    """Characters outside the large scripts alone, before a mark, between letters and a mark, and after a combining accent."""
    chars = [chr(c) for c in (*range(0x3100), *range(0xA000, 0xABFF), *range(0xF900, 0x10000), *range(0x10000, 0x10FFF))]
    letters = [c for c in chars if c.isalpha() or ord(c) < 0x180]
    texts = chars + [c + "," for c in letters] + ["a" + c + "." for c in letters] + ["́" + c for c in chars]
    t = Tokenizer.from_file(path)
    want = [array("I", e.ids).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    assert PieceEncoder(path, path == BYTE).encode(texts) == want
    if path == WORD:
        assert [ids for ids, _ in bpe.WordBpe(path).encode(texts)] == want


def test_long_words_merge_alike():
    w = bpe.WordBpe(WORD)
    for text in ("ab" * 60, "theinof" * 9, "q" * 100):
        ends = [*text[:-1], text[-1] + "</w>"]
        assert w._merge_long(ends) == w.merge(text)


def test_token_store(spark, tmp_path):
    texts = [*ODD, words(9000, 5)]
    docs = docs_of(spark, texts, [5 * i % 17 + (100 if i == 3 else 0) for i in range(len(texts))])
    token_store.write_tokens(docs, str(tmp_path / "t"), BYTE, True, 2)
    got = token_store.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    t = Tokenizer.from_file(BYTE)
    by_id = collections.defaultdict(list)
    for r in docs.collect():
        by_id[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == len(texts)
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids in by_id[r.doc_id] and r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    assert token_store.read_document(spark, str(tmp_path / "t"), got[-1].doc_id) in by_id[got[-1].doc_id]
    assert token_store.read_document(spark, str(tmp_path / "t"), 10**9) is None


def test_empty_tables(spark, tmp_path):
    none = docs_of(spark, [])
    token_store.write_tokens(none, str(tmp_path / "t"), BYTE, True, 2)
    assert token_store.read_tokens(spark, str(tmp_path / "t")).count() == 0
    assert bpe.digests(none, WORD).count() == 0 and bpe.encode_decode(none, WORD).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0
    assert suffix_dedup.digests(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# --- dedup


@pytest.mark.parametrize("most_broadcast", [exact_dedup.MOST_BROADCAST, 0])
def test_exact_dedup(spark, most_broadcast):
    texts = [*ODD, "a b", "ab", " a b ", "ab"]
    ids = list(range(len(texts)))
    ids[3] = ids[4]  # a repeated row
    docs = docs_of(spark, texts, ids).withColumn("kept", F.lit("clash"))
    got = exact_dedup.exact_dedup(docs, most_broadcast=most_broadcast).collect()
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[norm(t)].append((-len(t or ""), i))
    for r in got:
        g = groups[norm(r.text)]
        assert (r.keep_id, r.group_size) == (min(g)[1], len(g)) and r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups) and len(got) == len(texts)


def test_exact_dedup_ids(spark):
    rows = [(None, "a"), ("9", "a"), (None, "a"), ("8", " a"), (None, "b"), (None, "b"), (None, "c")]
    got = sorted((r.text or "", r.doc_id or "", r.keep_id or "", r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == sorted([("a", "", "8", 4, False), ("a", "9", "8", 4, False), ("a", "", "8", 4, False), (" a", "8", "8", 4, True), ("b", "", "", 2, False), ("b", "", "", 2, True), ("c", "", "", 1, True)])


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None)
    n, parent = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(find(i), n[i]) for i in range(len(texts))]


def family(base, size, seed):
    rng, out = random.Random(seed), []
    for _ in range(size):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark):
    texts = ODD + family(words(120, 8), 60, 1) + family(words(60, 9), 25, 2) + [words(50, 100 + i) for i in range(20)] + [words(30, 10)] * 30
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts)


@pytest.mark.parametrize("blocks", [4096, 16])
def test_near_duplicates_in_split_buckets(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks)
    texts = family(words(80, 8), 70, 1) + family(words(80, 8), 30, 5) + family(words(90, 8), 30, 6)
    docs = docs_of(spark, texts).select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("row"), "text")
    keys = ngram_join._keys(docs, ngram_join.runs_needed(levels=4), 2.0).cache()
    reps = keys.groupBy("set_key").agg(F.min_by("row", "id").alias("row"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("paths").alias("paths"))
    found = ngram_join.links(docs, reps, reps, bucket=8).groupBy("rep").agg(F.sum("linked").alias("n"))
    copies = {r.rep: r.copies for r in reps.collect()}
    want = {i: n - (copies[i] - 1) for i, (_, n) in enumerate(brute_links(texts)) if i in copies}
    assert {r.rep: r.n for r in found.collect()} == {i: n for i, n in want.items() if n}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = words(60, 31), words(60, 32)
    rows = [(5, a), (5, b), (7, b + " more"), (9, a + " more"), (None, a + " other"), (5, a), (None, words(40, 33)), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.near_duplicates(docs).collect()))
    assert got == sorted([(5, 5, 3), (5, 5, 1), (7, 5, 1), (9, 5, 3), (0, 5, 3), (5, 5, 3), (0, 0, 0), (3, 3, 0), (3, 3, 0)])


def test_shingle_sets_and_sketches():
    texts = [t or "" for t in ODD] + [words(n, n) for n in range(1, 9)]
    assert all((x == ngram_join.shingles(t)).all() for x, t in zip(ngram_join.shingle_sets(texts), texts, strict=True))
    rng, least, missed = np.random.default_rng(2), ngram_join._least_agreement(0.8, 5e-5), 0
    for n in (9, 90, 900):
        for _ in range(200):
            t = rng.integers(0, 1 << 64, n + n // 9 * 2, np.uint64)
            x, y = (np.unpackbits(np.frombuffer(ngram_join._sketch(np.sort(s)), np.uint8)) for s in (t[: n + n // 9], t[n // 9 :]))
            missed += int((x == y).sum() < least)
    assert not missed


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    got = {r.node: r.label for r in min_labels(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100}


def brute_repeats(texts):
    data, seen = [(t or "").encode() for t in texts], collections.Counter()
    for b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for b in data:
        cut = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cut[i] += 1
                cut[i + 200] -= 1
        gone = np.cumsum(cut)[:-1] > 0
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]])))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_cover_is_a_difference_set():
    p, c = suffix_dedup.PERIOD, suffix_dedup.COVER
    assert sorted((a - b) % p for a in c for b in c if a != b) == list(range(1, p))


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:  # many chunks, windows and buckets
        for k, v in (("CHUNK_BYTES", 3000), ("BUCKET_SUFFIXES", 500)):
            monkeypatch.setattr(suffix_dedup, k, v)
    p = words(60, 20)
    edge = "".join(random.Random(4).choice("xyz") for _ in range(200))
    texts = [*ODD, p + words(30, 21), words(17, 22) + p, words(5, 23) + p + words(5, 24) + p[:250], "z" * 700, edge, edge + "q", "é" * 150 + p, words(900, 25), edge[:199]]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)
    left = suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"} and len(left) == len(texts)


def test_different_texts_of_one_pattern_stay(spark):
    """Strings that polynomials modulo 2**64 don't tell apart, whatever the letters: Thue-Morse blocks."""
    sign = [bin(i).count("1") % 2 for i in range(64)]
    block = lambda a, b: "".join((a, b)[x] for x in sign)
    texts = [block(a, b) + block(c, d) + block(e, f) + "tail next" for a, b, c, d, e, f in ("abcdef", "badcfe", "cdefab", "dcfeba", "abdcef", "bacdfe", "aabbcc", "ghijkl", "hgjilk")]
    texts += [texts[0] + "!", "z" + texts[3]]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_keys_and_products():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, suffix_dedup.PRIME, 500, np.uint64) for _ in range(2))
    a[:3], b[:3] = (0, 1, suffix_dedup.PRIME - 1), (suffix_dedup.PRIME - 1,) * 3
    assert [int(x) * int(y) % suffix_dedup.PRIME for x, y in zip(a, b, strict=True)] == suffix_dedup._times(a, b).tolist()
    base, data = int(a[9]), rng.integers(0, 256, 500).astype(np.uint8)
    want = [sum((int(x) + 1) * pow(base, j, suffix_dedup.PRIME) for j, x in enumerate(data[i : i + 200])) % suffix_dedup.PRIME for i in (0, 7, 300)]
    assert suffix_dedup._Lane(base).at(data, np.array([0, 7, 300])).tolist() == want
    keys = suffix_dedup._key(np.array([5, 1, 5, 5, 9], np.uint64), np.array([2, 9, 1, 2, 300], np.uint64))
    own = suffix_dedup._ranks(keys)[2]
    assert own.tolist() == [(1, 9), (5, 1), (5, 2), (9, 300)]
    assert (suffix_dedup._expand(suffix_dedup._squeeze(own, 2), 2) == own).all()
    assert suffix_dedup._hits(keys, None, 0).tolist() == [True, False, False, True, False]


# --- quality


def test_quality_holds_out_well(spark):
    got = quality.op1_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    m = got[got.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.95 and len(got) == 1000 and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())


def test_prior_and_odd_texts(spark):
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 2800), n[:1200]])
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.05
    docs = docs_of(spark, ODD)
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert {r.score for r in quality.score(docs, None, ["doc_id"]).collect()} == {0.5}


# --- packing, chat, pages, search


def test_packing(spark):
    texts = [*ODD, words(9000, 5)] + [words(n, n) for n in range(20, 900, 13)]
    got = packing.pack_documents(docs_of(spark, texts)).toPandas()
    t = Tokenizer.from_file(WORD)
    for i, text in enumerate(texts):
        ids = array("I", t.encode(text or "", add_special_tokens=False).ids + [1]).tobytes()
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() * 4 == len(ids) and own.start.tolist() == list(range(0, len(ids) // 4, 4096))
        assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    assert got.sequence_id.nunique() == packing.lower_bound(np.bincount(got.length, minlength=4097))


def test_exchange_saves_sequences(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.choice([rng.randrange(1, 60), rng.randrange(800, 2500)]), i) for i in range(600)]
    items = spark.createDataFrame(rows, packing.PIECE_SCHEMA)
    many = packing.pack(items, group_pieces=100).select("sequence_id").distinct().count()
    alone = sum(packing._pack_round(items, 6, 0, 4096).groupBy("part").agg(F.max("bins").alias("n")).toPandas().n)
    assert packing.lower_bound(np.bincount([r[3] for r in rows], minlength=4097)) <= many < alone


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = np.sort(rng.integers(1, rng.integers(2, 100), rng.integers(1, 60)))[::-1]
        assert packing.lower_bound(np.bincount(n, minlength=101), 100) <= len(packing.best_fit(n, 100)[2])


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\:", "<s", "[INST]", "", "a\\\\:b</s>", "é"]
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], nasty[(c + t) % 8] + words(60, t) * (t % 5)) for c in range(6) for t in range(12)]
    rows += [(9, 0, None, None), (9, 0, None, None), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(turns, budget=200, history=60)
    for w in out.collect():
        assert len(chat.parse(w.text)) > w.repeated and all(w.text[s.start : s.end] is not None for s in w.loss_spans)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    assert got.keys() == want.keys() and got[1].n_windows > 1
    for c, ts in want.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(ts), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert all(chat.unescape(chat.escape(x)) == x and not any(k in chat.escape(x) for k in chat.CONTROLS) for x in nasty)


PAGE = '<html><head><title>t</title></head><body><nav><a>m</a></nav><div class="x">{box}</div>{main}<div class="comments"><p>c</p></div><footer>f</footer></body></html>'


def test_pages(spark):
    art = "<article><h1>H &amp; x</h1><p><b>one<br><p>two &nbsp; <i>three</i><script>var a='</p>';</script></article>"
    rows = [(i, f"http://h.example/{i}", PAGE.format(box="Subscribe now", main=f"<div><p>body {i}</p></div>")) for i in range(12)]
    rows += [(20, "http://h.example/a", PAGE.format(box="Subscribe now", main=art)), (21, "http://o.example/b", PAGE.format(box="Subscribe now", main="<p>x")), (22, None, None), (23, "odd", ""), (24, "http://h.example/d", "<article>" + "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"body {i}" for i in range(12))  # the box is a template of h.example
    assert got[20].text == "H & x\none\ntwo three" and got[20].n_chars == 19
    assert got[21].text == "Subscribe now\nx" and got[22].text == "" and got[23].text == "" and got[24].text == "deep"


def pages_of(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_tags_in_linear_time():
    for piece in ("<a ", "<a b='", '<a "\'>', "<p><b>", "<i><div><b></i>", "<!-- <", "<script>", "</x>"):
        began = time.time()
        html_text.main_text(html_text.parse(piece * 60_000))
        assert time.time() - began < 20
    text = lambda s: html_text.main_text(html_text.parse(s))
    assert text('<p>5 < 6 <a title="x > y">link</a> it\'s <b class=\'c>d\'>bold</b></p>') == "5 < 6 link it's bold"
    assert text("<p>one<p>two <b>three</p> four") == "one\ntwo three\nfour"


def test_top_k_of_shuffled_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(0, 3, (90, 8)).astype(np.float32))] + [(90, [9000.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    a, b = (sorted(map(tuple, topk.top_k(v, F.col("vec_id") % 10 == 0, most_broadcast=n).collect())) for n in (topk.MOST_BROADCAST, 0))
    assert a == b and len(a) == 50
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(1, [1e9] * 8), (2, [1.0] * 8)], "vec_id long, embedding array<double>"), F.lit(True))


def test_stages_on_odd_rows(spark):
    """Nulls, empties, repeated and null ids, clashing columns and an empty table in every stage; no other text is lost for an id."""
    a, b = words(80, 41), words(80, 42)
    rows = [(1, a), (5, a + " tail"), (5, b), (None, b), (5, b), (7, None), (7, ""), (None, words(60, 43)), (9, a + " tail")]
    names = ("score", "kept", "keep_id", "group_size", "text_sha256", "class_id", "n_links", "__spans", "__out", "__n_bytes", "__doc", "__row", "__score", "row", "spans", "out")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    for name, work in corpus_pipeline.STAGES[:4]:
        out = work(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and all(r[n] == f"own {n}" for r in got for n in names)
        texts = sorted(r.text or "" for r in got)
        if name == "exact_dedup":
            assert texts == sorted({t or "" for _, t in rows})
        if name == "near_dedup":
            assert len(got) == 5 and {r.doc_id for r in got} == {1, 5, 7, None} and a in texts and b in texts
        assert work(spark, docs.limit(0), SF).count() == 0
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.count() == len(rows) and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_templates_of_every_page(spark):
    # The only article is a comment, in an aside or in a remark; furniture is counted but its varied text doesn't hide a template.
    odd = ['<article class="comment">c</article>', "<aside><article>a</article></aside>", "<!-- <article> </article> -->", "<nav>n</nav>"]
    rows = [(i, f"http://h.example/{i}", f"<div>Join us <nav>{i}</nav></div><div><p>body {i}</p></div>{odd[i % 4]}") for i in range(16)]
    assert pages_of(spark, rows) == {i: f"body {i}" for i in range(16)}
    # Recurs beside articles, not in them: stays in the one article.
    rows = [(i, f"http://g.example/{i}", f"<div>Note</div><article><p>t {i}</p>{'<div>Note</div>' if i == 3 else ''}</article>") for i in range(16)]
    assert pages_of(spark, rows) == {i: f"t {i}" + ("\nNote" if i == 3 else "") for i in range(16)}
    root = html_text.parse("<nav><a>m</a></nav><p>x</p>")
    assert html_text.subtree_hashes(root)[id(root.children[0])][0] in {h for h, _ in html_text._candidates(root)}


def test_furniture_by_class():
    text = lambda s: html_text.main_text(html_text.parse(s))
    art = "<article><h1>T</h1><p>body</p></article>"
    for kept in ('class="container no-sidebar"', 'id="page-with-header"', 'class="sidebar"', 'class="widget page"'):
        assert text(f"<div {kept}>{art}</div>") == "T\nbody"
        assert text(f"<div {kept}><main><p>a</p></main></div><p>more text beside it") == "a"
        assert text(f"<div {kept}><p>most of the text</p></div><p>less") == "most of the text\nless"
    assert text('<article><h1 class="article-header">T</h1><h2 class="header">U</h2><p class="related-work">r</p><div class="share x">s</div></article>') == "T\nU\nr"
    assert text('<div class="big related"><article>see</article></div>' + art) == "T\nbody"
    assert text('<div class="ad">Buy</div><p>a page without an article') == "a page without an article"
    assert text(art + '<article class="comment">c</article>') == "T\nbody"


def test_article_in_wrappers():
    text = lambda s: html_text.main_text(html_text.parse(s))
    art = "<article><h1>T</h1><p>body of the article</p></article>"
    for before, after in (('<form id="aspnetForm">', "</form>"), ("<aside>", "</aside>"), ("<noscript>", "</noscript>"), ('<div role="dialog">', "</div>"), ('<div data-role="search">', "</div>"), ('<div title="class=ad" data-id="share">', "</div>"), ('<form><div role="alert">', "</div></form>")):
        assert text(f"<nav>a b c d e f g h i j k l m n o p</nav>{before}{art}{after}<footer>f</footer>") == "T\nbody of the article", before
    assert text('<article><p data-role="search">found</p></article>') == "found"
    assert text("<aside><article>teaser</article></aside><div><p>the body in a div</p></div>") == "the body in a div"
    assert text(f"<form><input>q <button>go</button></form>{art}<noscript>turn it on</noscript>") == "T\nbody of the article"
    for furniture in ('class="cookie-notice"', 'class="ad-box"', 'id="comments-list"', "class='share_bar x'"):
        assert text(f"<article><p>{words(30, 1)}</p><div {furniture}>gone</div></article>") == words(30, 1)
    assert text(f'<div class="ads-free-layout">{art}</div>') == "T\nbody of the article"
    assert text('<article><div class="notice-board"><p>most of this article</p></div>by me</article>') == "most of this article\nby me"


def test_pages_equal_a_second_reading():
    """All given pages by a reader of its own: the article's blocks, without elements and class words of furniture."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.blocks, self.now = [], [], []

        def end(self):
            if block := " ".join("".join(self.now).split()):
                self.blocks.append(block)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCK:
                self.end()
            if tag not in html_text.VOID:
                words = " ".join(v or "" for k, v in attrs if k in ("class", "id")).split()
                self.open.append((tag, tag in "nav footer aside form script style button noscript head".split() or tag != "article" and any(w.split("-")[0] in html_text.DROPPED_WORDS - {"header"} for w in words) or "comment" in words))
            elif tag == "br":
                self.now.append(" ")

        def handle_endtag(self, tag):
            if tag in html_text.BLOCK:
                self.end()
            while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
                pass

        def handle_data(self, data):
            if any(t in html_text.CONTENT for t, _ in self.open) and not any(gone for _, gone in self.open):
                self.now.append(data)

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    same = 0
    for source in pages.html:
        reader = Reader()
        reader.feed(source)
        reader.close()
        reader.end()
        same += html_text.main_text(html_text.parse(source)) == "\n".join(reader.blocks)
    assert same == len(pages)


def test_templates_equal_brute_force(spark):
    """A host of 60 pages, one of 4 and one of 2: boxes go by their share of the host's different pages, prose never."""
    prose = ["<h2>References</h2>", "<p>See also.</p>", "<b>Note:</b>", "<table><tr><td>Yes</td><td>row {i}</td></tr></table>"]
    rng, hosts = random.Random(8), {"large": 60, "small": 4, "tiny": 2}
    made = {h: [(i, [b for b in range(6) if rng.random() < b / 5], [p.format(i=i) for p in prose if rng.random() < 0.6]) for i in range(n)] for h, n in hosts.items()}
    made["large"] += [made["large"][0]] * 40  # copies count once
    rows, want = [], {}
    for h, made_pages in made.items():
        pages = {repr(x): x for x in made_pages}.values()
        n = [sum(b in boxes for _, boxes, _ in pages) for b in range(6)]
        for i, boxes, own in made_pages:
            source = "".join(f"<div>box {b}</div>" for b in boxes) + f"<div><p>{h} {i}</p>" + "".join(own) + "</div>"
            left = [f"box {b}" for b in boxes if n[b] < 3 or 4 * n[b] < len(pages)]
            body = html_text.main_text(html_text.parse(f"<div><p>{h} {i}</p>" + "".join(own) + "</div>"))
            want[len(rows)] = "\n".join([*left, body])
            rows.append((len(rows), f"http://{h}.example/{len(rows)}", source))
    got = pages_of(spark, rows)
    assert got == want
    for h, gone in (("large", True), ("small", True), ("tiny", False)):
        assert gone == any("<div>box 5" in s and "box 5" not in got[k] for k, u, s in rows if h in u)
    assert sum("References" in t for t in got.values()) > 20


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (230, 16)).astype(np.float32)
    v[40:120] = v[3]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (510, [None] * 16), (520, [float("nan")] * 16), (530, [1.0, 2.0]), (540, [float("inf")] * 16)]
    got = collections.defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    for q in range(0, 230, 10):
        s = w @ w[q]
        assert got[q] == [(i, s[i]) for i in sorted((i for i in range(230) if i != q), key=lambda i: (-s[i], i))[:5]]
    assert not {500, 510, 520, 530, 540} & got.keys()


# --- registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    key = lambda d: sorted(repr([None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x for x in r]) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(a.columns) == sorted(b.columns) and key(a) == key(b)


def test_pipeline(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), {}
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, SF)
        frame = out.toPandas()
        stages[name] = frame
        if name != "packing":
            assert frame.columns.tolist() == docs.columns
            docs = spark.createDataFrame(frame, docs.schema)
    good = set(labels[labels.quality == 1].doc_id)
    first = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(good & set(stages["quality"].doc_id)) >= 0.97 * len(good & set(first.doc_id))
    norm = stages["quality"].text.str.replace(r"[\x20\x09-\x0D]", "", regex=True)
    assert len(stages["exact_dedup"]) == norm.nunique()
    copies = stages["exact_dedup"].sort_values("doc_id")
    classes = brute_links(copies.text.tolist())
    assert set(stages["near_dedup"].doc_id) == {copies.doc_id.iloc[c] for c, _ in classes}
    near = stages["near_dedup"].sort_values("doc_id")
    cut = stages["repeat_cut"].set_index("doc_id").text
    for i, text, (_, gone, _, sha) in zip(near.doc_id, near.text, brute_repeats(near.text.tolist()), strict=True):
        assert (cut[i] == text) == (gone == 0)
        if cut[i].isascii() and text.isascii():
            assert hashlib.sha256(cut[i].encode()).hexdigest() == sha
    packed, t = stages["packing"], Tokenizer.from_file(WORD)
    assert set(packed.doc_id) == set(near.doc_id)
    for i, own in packed.sort_values("piece").groupby("doc_id"):
        ids = array("I", t.encode(cut[i] or "", add_special_tokens=False).ids + [1]).tobytes()
        assert own.start.tolist() == list(range(0, len(ids) // 4, 4096)) and own.length.sum() * 4 == len(ids)
        assert [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= packing.CAPACITY
    # A lower bound: one sequence more may be what these lengths need.
    assert 0 <= packed.sequence_id.nunique() - packing.lower_bound(np.bincount(packed.length, minlength=packing.CAPACITY + 1)) <= 1


def test_stage_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from veritab.llm.common import stage

    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    out = stage(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count(), "dropped")
    assert out.count() == 997 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    # What count() itself shuffles is one row a task.
    assert len(files() - before) <= 16
    held = stage(spark.range(10_000).repartition(8, "id"), "dropped again")
    now = files()
    stage(held.repartition(8, "id"), "and again")
    assert files() <= now


def test_large_buckets_send_their_own_sets_only(spark, monkeypatch):
    """op5: sets of no large bucket were shuffled with the others whenever a bucket was split."""
    tokens = {r: np.sort(np.random.default_rng(r).integers(0, 1 << 63, 40, dtype=np.uint64)) for r in range(30)}
    sets = spark.createDataFrame([(r, bytearray(t.tobytes())) for r, t in tokens.items()], "rep long, tokens binary")
    rows = spark.createDataFrame([(7, 3), (7, 4), (9, 4)], "bucket long, rep long")
    expected = sorted((int(p), r) for b, r in ((7, 3), (7, 4), (9, 4)) for p in ngram_join._chosen(tokens[r], b, 5.0))
    plans = []
    for most in (500_000, 0):
        monkeypatch.setattr(ngram_join, "MOST_SENT", most)
        got = ngram_join._deeper(rows, sets, 5.0)
        assert sorted((r.bucket, r.rep) for r in got.collect()) == expected
        plans.append(got._jdf.queryExecution().optimizedPlan().toString())
    assert "LeftSemi" in plans[0] and "LeftSemi" not in plans[1]
