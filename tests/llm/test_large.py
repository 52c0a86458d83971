"""Texts of over a megabyte and repeated rows in every operator; recall of the near-duplicate join; a second computation of the quality model's risk."""

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_llm import docs_of, words
from veritab.llm import bpe, chat, exact_dedup, html_text, ngram_join, packing, quality, suffix_dedup, token_store, topk

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_texts_of_a_megabyte_twice(spark, tmp_path):
    """Two rows of one such text under one id, and one that differs by its last word."""
    long = words(220_000, 3)
    assert len(long) > 1_100_000
    texts = [long, long, long + " end", "short", None]
    docs = docs_of(spark, texts, [7, 7, 8, 9, None])
    scores = quality.score(docs, None, ["doc_id"]).collect()
    assert len(scores) == 5
    by_byte, by_word = (Tokenizer.from_file(p) for p in (BYTE, WORD))
    token_store.write_tokens(docs, str(tmp_path / "t"), BYTE, True, 2)
    n = sorted(r.n_tokens for r in token_store.read_tokens(spark, str(tmp_path / "t")).collect())
    assert n == sorted(len(by_byte.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    ids = [np.array(by_word.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got = bpe.digests(docs, WORD).collect()
    assert sorted(r.ids_sha256 for r in got) == sorted(hashlib.sha256(x).hexdigest() for x in ids)
    kept = exact_dedup.exact_dedup(docs).collect()
    assert sorted(r.group_size for r in kept) == [1, 1, 1, 2, 2] and sum(r.kept for r in kept) == 4
    links = sorted(r.n_links for r in ngram_join.near_duplicates(docs).collect())
    assert links == [0, 0, 2, 2, 2]
    pieces = packing.pack_documents(docs).toPandas()
    assert sorted(pieces.groupby("doc_id", dropna=False).length.sum()) == sorted([sum(len(x) // 4 + 1 for x in ids[:2]), *(len(x) // 4 + 1 for x in ids[2:])])
    cut = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.digests(docs).collect())
    assert cut == [(0, 0), (5, 0), (len(long), len(long)), (len(long), len(long)), (len(long) + 4, len(long))]
    pages = spark.createDataFrame([(1, "http://a/1", f"<article><p>{long}</p></article>")] * 2 + [(2, "http://a/2", f"<div>{'<b>x</b> ' * 150_000}</div>")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract(pages).collect()) == [299_999, len(long), len(long)]
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.windows(turns)).first()
    assert r.loss_chars == len(long) and r.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_repeated_rows(spark):
    texts = ["a b c", "a b c", words(300, 1), words(300, 1), None, None]
    docs = docs_of(spark, texts, [1, 1, 2, 2, None, None])
    labels = spark.createDataFrame([(2, 1), (2, 1), (1, 0)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()
    assert len(scored) == 6 and len({(r.doc_id, r.score) for r in scored}) == 3
    packed = packing.pack_documents(docs).toPandas()
    assert len(packed) == 6
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in (1, 1, 2, 2, 3)], "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") == 3, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 2, 1, 1]


def test_links_of_every_twentieth_document(spark):
    """Recall over sf0.01: every document whose id is divisible by 20 against all, by whole shingle sets."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.itertuples():
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    found = 0
    for i in sets:
        if i % 20 == 0 and sets[i]:
            near = [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
            assert got[i][1] == len(near) and all(got[j][0] == got[i][0] for j in near)
            found += len(near)
    assert found > 5


def test_risk_by_a_second_computation():
    """The fitted weights against a plain search: no step from them lowers the non-negative risk, written out here anew."""
    rng = np.random.default_rng(7)
    p, n = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (900, 3))
    u = np.concatenate([rng.normal(1, 1, (300, 3)), n[:700]])
    prior, ridge = 0.3, 1e-3
    model = quality.fit(p, u, prior, rounds=3000, ridge=ridge)
    loss = lambda z: np.where(z > 0, np.log1p(np.exp(-np.abs(z))), np.log1p(np.exp(-np.abs(z))) - z)

    def risk(weights, bias):
        z = lambda x: ((x - model.mean) / model.scale).clip(-8, 8) @ weights + bias
        unseen = loss(-z(u)).mean() - prior * loss(-z(p)).mean()
        return prior * loss(z(p)).mean() + max(0.0, unseen) + ridge / 2 * (weights**2).sum(), unseen

    best, unseen = risk(model.weights, model.bias)
    assert unseen > 0
    for k in range(4):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            if k < 3:
                w[k] += step
            assert risk(w, model.bias + (step if k == 3 else 0))[0] > best - 1e-6
    assert min((model.score(p) > 0.5).mean(), (model.score(n) < 0.5).mean()) > 0.9


def test_prior_is_learned():
    rng = np.random.default_rng(9)
    p = rng.normal(2, 1, (2000, 2))
    u = np.concatenate([rng.normal(2, 1, (900, 2)), rng.normal(-2, 1, (2100, 2))])
    assert abs(quality.fit(p, u).prior - 0.3) < 0.06
