"""Spelling variants, ranked lexical search and token counts against brute force and the tokenizers library."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_llm import ODD, docs_of, words
from veritab.llm import lexical, spelling, token_count

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def clashing(docs, *names):
    """The rows with further columns named like those that an operator adds, one of them null."""
    for name in names:
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    return docs


# --- token counts


def test_token_counts(spark):
    texts = [*ODD, "no" * 600_000, words(250_000, 9), "a<|endoftext|><|endoftext|> b", "x 漢字 y's  \n가 ", "\x1c \x85\xa0 '", "日本語" * 3000]
    docs = clashing(docs_of(spark, texts, [*range(len(texts) - 1), None]), "n_bytes", "n_tokens", "over_limit")
    docs = docs.unionByName(docs.limit(3))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, BYTE).collect())
    t = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 512] += 1
    assert got == want
    assert token_count.count_tokens(docs.limit(0), BYTE).count() == 0


def test_token_counts_on_code_points():
    rng = random.Random(5)
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(rng.randrange(0x3100, 0xD800)) for _ in range(500)] + [chr(rng.randrange(0xE000, 0x110000)) for _ in range(500)]
    texts = [f for c in chars for f in (c, f"a{c}", f"a {c} b", f"1{c} 's{c} \n{c}", f"  {c}")]
    counter, t = token_count.TokenCounter(BYTE, token_count.whole_tokens(BYTE), most=500), Tokenizer.from_file(BYTE)
    want = [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    assert [counter.count(x) for x in texts] == want


def test_whole_tokens_are_proven():
    whole, t = token_count.whole_tokens(BYTE), Tokenizer.from_file(BYTE)
    some = sorted(whole)[::97]
    assert len(whole) > 45_000
    assert all(len(t.model.tokenize("".join(token_count.byte_alphabet()[b] for b in w.encode()))) == 1 for w in some)
    assert all(w not in whole for w in ("ouonrein", "thshtion", ""))


# --- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    fold = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, collections.Counter(fold(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    nn, ll = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(fold(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * nn) // ll
            s = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s:
                scores.append((-s, i is None, i or 0, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("item_bytes", "block_docs"), [(lexical.ITEM_BYTES, lexical.BLOCK_DOCS), (40, 7)])
def test_search(spark, monkeypatch, item_bytes, block_docs):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    rng = random.Random(11)
    vocabulary = [words(1, i) for i in range(60)] + ["É", "é", "漢字", "A1", "a1"]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([8, 65])]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["same passage here"] * 40 + [*ODD, "x" * 1_500_000 + " passage", words(200_000, 4)]
    ids = [*range(len(texts) - 2), None, None]
    ids[5] = ids[6]
    docs = clashing(docs_of(spark, texts, ids), "score", "rank", "item_id", "terms").repartition(6)
    items = [(1, "same passage here"), (2, " ".join(vocabulary[:12])), (3, ""), (4, None), (5, "É é A1!"), (5, words(1, 3)), (None, "passage"), (7, "unheardof"), (8, words(40, 2))]
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"), "doc_id", "score")
    for k in (3, 50):
        got = [tuple(r) for r in lexical.search(docs, asked, k, item_bytes).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=repr) == brute_search(list(zip(ids, texts, strict=True)), items, k)
    assert lexical.search(docs.limit(0), asked).count() == 0 and lexical.search(docs, asked.limit(0)).count() == 0


def test_intervals_give_the_best_of_a_block():
    """Scores tie often here, so the places of equal scores decide."""
    rng = np.random.default_rng(2)
    size, terms = 500, [b"t%d" % i for i in range(9)]
    held = [np.sort(rng.choice(size, rng.integers(1, size), replace=False)) for _ in terms]
    tfs = [rng.integers(1, 3, len(p)) for p in held]
    row = {"doc_ids": list(range(size)), "lengths": [50] * size, "terms": terms, "counts": [len(p) for p in held], "places": np.concatenate(held).astype("<u2").tobytes(), "tfs": np.concatenate(tfs).astype("<u4").tobytes()}
    weights = {t: int(w) for t, w in zip(terms, rng.integers(1, 4, len(terms)), strict=True)}
    block = lexical.Block(row, weights, size, 50 * size)
    for some in (terms, terms[:1], terms[2:5], [b"none"]):
        scores = np.zeros(size, np.int64)
        for t, p, tf in zip(terms, held, tfs, strict=True):
            if t in some:
                scores[p] += weights[t] * ((10**9 * tf) // (1000 * tf + 20 * 100))
        want = sorted(((int(s), i) for i, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))
        assert block.search(some, 20) == want[:20]
        if len(want) > 30:
            floor, last = want[10]
            assert block.search(some, 20, floor, last) == want[:11]


# --- spelling variants


def brute_variants(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, forms = {}, {}
    for w, c in n.items():
        met = [v for v in n if near(w, v)]
        best = min(((-n[v], v) for v in met), default=(0, None))
        forms[w] = best[1] if -best[0] >= 10 * c else None
        out[w] = [len(met), -best[0] if forms[w] else None]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (w, forms[w], root, n[w], *out[w])
    return sorted(out.values(), key=lambda x: x[0])


@pytest.mark.parametrize("most_bucket", [spelling.MOST_BUCKET, 3])
def test_spelling_variants(spark, most_bucket):
    rng = random.Random(8)
    base = ["".join(rng.choice("aeiétrn") for _ in range(rng.randrange(7, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "ÀÿXabcdefg", "listenings"]
    pool = []
    for i, w in enumerate(base):
        pool += [w] * (400 if i % 5 == 0 else 25 if i % 2 else 2)
        for _ in range(12):
            k, c = rng.randrange(len(w)), rng.choice("aeiétrnz")
            v = rng.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[::-1]])
            pool += [v] * rng.choice([2, 2, 40])
    rng.shuffle(pool)
    texts = [" ".join(pool[i : i + 60]) for i in range(0, len(pool), 60)] + [*ODD, "no" * 700_000, f"{'abcé' * 60} {'abcé' * 60}x {'abcé' * 60} {'abcé' * 60}x {'abcz' + 'abcé' * 59} {'abcz' + 'abcé' * 59}", pool[0].upper() + "×" + pool[1]]
    ids = [*range(len(texts) - 2), None, 3]
    docs = clashing(docs_of(spark, texts, ids), "word", "n", "form", "key")
    want = brute_variants(list(zip(ids, texts, strict=True)))
    got = sorted(map(tuple, spelling.spelling_variants(docs, most_bucket).collect()), key=lambda x: x[0])
    assert got == want and sum(r[1] is not None for r in got) > 20
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [None, "", "short words"])).count() == 0


def test_signatures_meet():
    """Every two words at one edit share a key in every number of segments where the edit lies in the segment of one of them."""
    rng = random.Random(1)
    for _ in range(3000):
        w = bytes(rng.choice(b"abcdeflmnoptr\xe9\xff") for _ in range(rng.randrange(7, 15)))
        k, c = rng.randrange(len(w)), bytes([rng.choice(b"abcz\xe9")])
        for other, mine, its in ((w[:k] + c + w[k + 1 :], spelling.SAME, spelling.SAME), (w[:k] + c + w[k:], spelling.SHORT, spelling.LONG)):
            for segments in (1, 2, 4, 16):
                assert other == w or any(set(spelling._signatures(w, mine, s, segments)) & set(spelling._signatures(other, its, s, segments)) for s in range(segments))
