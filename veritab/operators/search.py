"""Best passages of a scope for each question: blocks of passages with posting lists, hash vectors and their maxima."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.plans.staging import stage

# Fixed value: dimensions of the hash embedding.
DIMENSIONS = 512
#: Passages of one scope that a task holds at a time; their vectors take 4 kB each.
BLOCK = 1024
#: Questions that are scored against a block at a time.
GROUP = 256
#: Scores that differ by less are equal.
DIGITS = 9
#: Questions or query vectors of so many bytes are sent to all tasks at once; more go one part after another.
MOST_QUERIES = 16 << 20
#: One in so many partitions of the passages is read first.
LOTS = 16


def hash_features(words: list[str]) -> np.ndarray:
    """Signed counts by bucket of the words and neighbouring pairs of a text.

    A feature's bucket is the first four bytes of its MD5, little-endian, modulo DIMENSIONS; its sign is the fifth
    byte's low bit.
    """
    features = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    if not features:
        return np.zeros(DIMENSIONS)
    md5 = hashlib.md5
    digests = np.frombuffer(b"".join([md5(f.encode()).digest() for f in features]), np.uint8).reshape(-1, 16)
    buckets = np.ascontiguousarray(digests[:, :4]).view("<u4")[:, 0] % DIMENSIONS
    return np.bincount(buckets, np.where(digests[:, 4] & 1, 1.0, -1.0), DIMENSIONS)


#: Round constants, rotations and word order of MD5 (RFC 1321).
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_WORD_OF = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16][i // 16] for i in range(64)]


def _md5_starts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit words of the MD5 of each string of data; up to 55 bytes are one block, hashed side by side."""
    first, second = np.zeros(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
    order = np.argsort(np.minimum(sizes, 56).astype(np.uint8), kind="stable")
    short = int(np.count_nonzero(sizes <= 55))
    for at in range(0, short, 8192):
        own = order[at : min(at + 8192, short)]
        n, size = len(own), sizes[own]
        width = (int(size[-1]) // 4 + 1) * 4
        text = data[np.minimum(starts[own][:, None] + np.arange(width), len(data) - 1)]
        text[np.arange(width) >= size[:, None]] = 0
        text[np.arange(n), size] = 0x80
        words = dict(enumerate(np.ascontiguousarray(text.view("<u4").T)))
        words[14] = (size * 8).astype(np.uint32)
        a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            part = i // 16
            mixed = (d ^ (b & (c ^ d))) if part == 0 else (c ^ (d & (b ^ c))) if part == 1 else (b ^ c ^ d) if part == 2 else (c ^ (b | ~d))
            mixed += a
            mixed += _SINES[i]
            if _WORD_OF[i] in words:
                mixed += words[_WORD_OF[i]]
            turn = _TURNS[part, i % 4]
            over = mixed >> (np.uint32(32) - turn)
            mixed <<= turn
            mixed |= over
            mixed += b
            a, b, c, d = d, mixed, b, c
        first[own], second[own] = a + np.uint32(0x67452301), b + np.uint32(0xEFCDAB89)
    for i in order[short:].tolist():
        first[i], second[i] = np.frombuffer(hashlib.md5(data[starts[i] : starts[i] + sizes[i]].tobytes()).digest()[:8], "<u4")
    return first, second


#: Bucket and sign of words met by this process; emptied when it holds MOST_WORDS.
_WORDS: dict[str, int] = {}
MOST_WORDS = 1 << 18


def _word_codes(words: list[str]) -> np.ndarray:
    """Twice the bucket, and one more for a positive sign, of each word."""
    new = set(words).difference(_WORDS)
    if len(_WORDS) + len(new) > MOST_WORDS:
        _WORDS.clear()
        new = set(words)
    if new:
        names = list(new)
        data = np.frombuffer(" ".join(names).encode() + b" ", np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        first, second = _md5_starts(data, starts, ends - starts)
        _WORDS.update(zip(names, ((first % DIMENSIONS).astype(np.int64) * 2 + (second & 1)).tolist(), strict=True))
    return np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))


def hash_counts(texts: list[str]) -> np.ndarray:
    """hash_features() of each text's words, which stand between single spaces: one row a text; its pairs are hashed together."""
    if not texts:
        return np.zeros((0, DIMENSIONS))
    text = " ".join(texts)
    words, data = text.split(" "), np.frombuffer(text.encode() + b" ", np.uint8)
    sizes = np.array([t.count(" ") + 1 for t in texts])
    owner, held = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.array([t != "" for t in texts]), sizes)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    first, second = _md5_starts(data, starts[pairs], ends[pairs + 1] - starts[pairs])
    codes = np.concatenate([_word_codes(words)[held], (first % DIMENSIONS).astype(np.int64) * 2 + (second & 1)])
    owners = np.concatenate([owner[held], owner[pairs]])
    return np.bincount(owners * DIMENSIONS + codes // 2, np.where(codes & 1, 1.0, -1.0), len(texts) * DIMENSIONS).reshape(len(texts), DIMENSIONS)


def runs(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) ranges of texts of about so many characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """batches in pieces of at most so many rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def sparse_vectors(texts: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """keys, buckets array<int> and weights array<double> of each row's words: its hash embedding of length 1; no shuffle.

    Words are not empty and hold no space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buckets, weights = [], []
            texts = [t or "" for t in batch.column("__words").to_pylist()]
            for a, b in runs(texts):
                for v in hash_counts(texts[a:b]):
                    some = np.flatnonzero(v)
                    buckets.append(some)
                    weights.append(v[some] / np.sqrt(v @ v) if len(some) else v[some])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(buckets, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], [*keys, "buckets", "weights"])

    chosen = texts.select(*keys, F.array_join(words, " ").alias("__words"))
    fields = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys)
    return chosen.mapInArrow(run, f"{fields}, buckets array<int>, weights array<double>")


class Block:
    """Up to BLOCK passages (place, doc, words) of one scope, in order of place; words are parted by single spaces.

    Only the asked words have posting lists.
    """

    def __init__(self, rows: list[tuple], asked: set[str], vectors: bool, sizes: bool):
        self.places = np.array([place for place, _, _ in rows], np.int64)
        self.docs = np.array([doc for _, doc, _ in rows], object)
        self.sizes = np.zeros(len(rows))
        lists: dict[str, list[int]] = {}
        for i, (_, _, text) in enumerate(rows):
            words = text.split(" ") if text else []
            if sizes:
                self.sizes[i] = len(set(words))
            for w in asked.intersection(words):
                lists.setdefault(w, []).append(i)
        self.lists = {w: np.array(x) for w, x in lists.items()}
        self.vectors = None
        if vectors:
            texts = [text or "" for _, _, text in rows]
            self.vectors = np.concatenate([np.empty((0, DIMENSIONS)), *(hash_counts(texts[a:b]) for a, b in runs(texts))])
            norms = np.sqrt((self.vectors**2).sum(axis=1))
            self.norms = np.where(norms > 0, norms, 1.0)
            unit = self.vectors / self.norms[:, None]
            self.high, self.low = unit.max(axis=0), unit.min(axis=0)

    def top(self, asked: list[tuple], q: np.ndarray | None, k: int, weights: tuple[float, float], by_passage: bool, leasts: list[float]) -> list[list[tuple]]:
        """(place, score, matched) of the k best passages that reach its least for each asked (question, only, words): by score, matched words if by_passage, and place.

        q holds the words' counts by bucket, a row a question. The words that the block holds and the largest and smallest
        weights of its buckets bound every score, so that most blocks are passed over once k good passages are known.
        """
        out: list[list[tuple]] = [[] for _ in asked]
        if not len(self.places):
            return out
        on_vectors, on_words = weights
        distinct = [list(dict.fromkeys(words)) for _, _, words in asked]
        held = [[self.lists[w] for w in own if w in self.lists] for own in distinct]
        bounds = np.array([on_words * (1.0 if by_passage and h else len(h) / max(len(own), 1)) for own, h in zip(distinct, held, strict=True)])
        if on_vectors:
            lengths = np.sqrt((q * q).sum(axis=1))
            units = np.where(lengths > 0, lengths, 1.0)
            bounds += on_vectors * (np.maximum(q, 0.0) @ self.high + np.minimum(q, 0.0) @ self.low) / units
        go = np.flatnonzero((bounds >= np.array(leasts) - 1e-9) & np.array([len(own) > 0 for own in distinct]))
        # Counts are whole numbers, so products are exact and equal texts have equal scores.
        dots = self.vectors @ q[go].T if on_vectors and len(go) else None
        for n, i in enumerate(go.tolist()):
            hits = np.bincount(np.concatenate(held[i]), minlength=len(self.places)) if held[i] else np.zeros(len(self.places), np.int64)
            score = on_words * (hits / np.maximum(self.sizes, 1.0) if by_passage else hits / len(distinct[i]))
            if dots is not None and lengths[i]:
                score = score + on_vectors * (dots[:, n] / (self.norms * lengths[i]))
            score = np.round(score, DIGITS + 3)
            only = asked[i][1]
            good = np.flatnonzero((score >= leasts[i] - 1e-9) & (score > 0) & (True if only is None else self.docs == only))
            order = np.lexsort((self.places[good], -hits[good] if by_passage else np.zeros(len(good)), -np.round(score[good], DIGITS)))[:k]
            out[i] = [(int(self.places[j]), float(score[j]), int(hits[j])) for j in good[order]]
        return out


def _answers(sent, floors: dict, k: int, weights: tuple[float, float], by_passage: bool, least: float, order: list[str], id_type: pa.DataType):
    """The k best passages of each block for the questions of its scope; a task's own k-th best scores raise its floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known, best = sent.value, dict(floors), {}
        scope, rows, keys = None, [], []
        said: dict = {}
        made: dict = {}
        types: list[pa.DataType] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal rows, keys
            if rows and scope in asked:
                if scope not in said:
                    said[scope] = {w for _, _, words in asked[scope] for w in words}
                block, out = Block(rows, said[scope], weights[0] > 0, by_passage), []
                found = []
                for at in range(0, len(asked[scope]), GROUP):
                    some = asked[scope][at : at + GROUP]
                    q = made.get((scope, at)) if weights[0] > 0 else None
                    if q is None and weights[0] > 0:
                        q = hash_counts([" ".join(words) for _, _, words in some])
                        if len(made) < 16:
                            made[scope, at] = q
                    leasts = [max(least, known.get(question, 0.0)) for question, _, _ in some]
                    found += zip(some, block.top(some, q, k, weights, by_passage, leasts), strict=True)
                for (question, _, _), hit in found:
                    for place, score, hits in hit:
                        out.append((question, scope, score, hits, *keys[place]))
                        own = best.setdefault(question, [])
                        heapq.heappush(own, score)
                        if len(own) >= k:
                            if len(own) > k:
                                heapq.heappop(own)
                            known[question] = max(known.get(question, 0.0), own[0])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [id_type, types[0], pa.float64(), pa.int64(), *types[1:]], strict=True)], ["question_id", "scope", "score", "matched", *order])
            rows, keys = [], []

        for batch in batches:
            types = [batch.column(c).type for c in ("scope", *order)]
            columns = [batch.column(c).to_pylist() for c in ("scope", "doc", "words", *order)]
            for now, doc, words, *key in zip(*columns, strict=True):
                if now != scope or len(rows) >= BLOCK:
                    yield from close()
                    scope = now
                if now in asked:
                    rows.append((len(rows), doc, words))
                    keys.append(key)
        yield from close()

    return run


def best_passages(questions: DataFrame, passages: DataFrame, order: list[str], k: int, weights: tuple[float, float], least: float, by_passage: bool = False, most_bytes: int = MOST_QUERIES) -> DataFrame:
    """(question_id, scope, rank, score, matched, order columns): the k best passages of each question's scope.

    questions has question_id (one row each), scope, words (in order, with repeats) and doc, a string: only passages of
    that doc, or all if null. passages has scope, doc, words and the columns of order, which tell the passages of a scope
    apart and break ties; words hold no space. The score is weights[0] times the cosine of the hash embeddings plus
    weights[1] times the share of the question's distinct words found (by_passage: the share of the passage's). Scores
    below least, or 0, are no answers. Null words count as none; a null scope meets nothing.

    Passages are written once, by scope inside each partition, and stay where they lie, so that a scope of any size is
    many tasks' work; no word, bucket or pair is a row. Questions go to all tasks in parts of at most most_bytes. The
    first lot of partitions is read first: the k-th best scores found there bound what the others need to look at.
    """
    spark = passages.sparkSession
    held = passages.filter("scope IS NOT NULL").select("scope", "doc", F.array_join("words", " ").alias("words"), *order).sortWithinPartitions("scope", *order)
    held = stage(held.withColumn("lot", (F.shiftright(F.monotonically_increasing_id(), 33) % LOTS).cast("int")), "passages")
    asked = questions.filter("scope IS NOT NULL").select("question_id", "scope", "doc", F.array_join("words", " ").alias("words"))
    total = asked.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    parts = -(-total // most_bytes)
    id_type = pa.schema(asked.select("question_id").limit(0).toArrow().schema).field(0).type
    kinds, own = dict(asked.dtypes), dict(held.dtypes)
    schema = ", ".join([f"question_id {kinds['question_id']}", f"scope {own['scope']}", "score double", "matched long", *(f"`{c}` {own[c]}" for c in order)])
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc(F.round("score", DIGITS)), *([F.desc("matched")] if by_passage else []), *order))
    found = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    for part in range(parts):
        # At most about most_bytes come to the driver.
        some = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == part)
        by_scope: dict = {}
        for r in some.collect():
            by_scope.setdefault(r.scope, []).append((r.question_id, r.doc, r.words.split(" ") if r.words else []))
        sent = spark.sparkContext.broadcast(by_scope)
        look = lambda rows, floors: rows.mapInArrow(_answers(sent, floors, k, weights, by_passage, least, order, id_type), schema)
        first = stage(look(held.filter("lot = 0"), {}).withColumn("rank", rank).filter(F.col("rank") <= k), "first")
        floors = {r.question_id: r.score for r in first.filter(F.col("rank") == k).select("question_id", "score").collect()}
        both = first.drop("rank").unionByName(look(held.filter("lot > 0"), floors))
        found = found.unionByName(both.withColumn("rank", rank).filter(F.col("rank") <= k))
    return found


#: A word in more passages of a scope than this is common: passages meet by their other words.
COMMON = 64


def best_by_share(questions: DataFrame, passages: DataFrame, order: list[str], least: float, common: int = COMMON) -> DataFrame:
    """(question_id, scope, score, matched, order columns): the passage of a question's scope with the largest share of its distinct words in the question.

    questions has question_id (one row each), scope and words, passages scope, words and the columns of order; ties go to
    more words met, then by order. Shares below least, or 0, are no answers.

    A passage is found by each of its words that is in at most `common` passages of the scope, so a question's candidates
    are at most so many a word. Passages of which a question holds common words only differ in their common words and
    their size: one passage stands for all that have both alike, and those are looked through by best_passages(), once for
    all questions with the same common words. The better of both is the best of all.
    """
    words = F.array_distinct(F.filter(F.split(F.array_join("words", " "), " "), lambda w: w != ""))
    held = passages.filter("scope IS NOT NULL").select("scope", words.alias("words"), F.struct(*order).alias("__o"))
    held = stage(held.withColumn("__p", F.monotonically_increasing_id()), "shares")
    asked = stage(questions.filter("scope IS NOT NULL").select("question_id", "scope", words.alias("words")), "shared")
    each = held.select("scope", "__p", F.explode("words").alias("word"), "__o")
    often = stage(each.groupBy("scope", "word").count().filter(F.col("count") > common).select("scope", "word", F.lit(True).alias("__often")), "often")
    # A common word is one row in often, however many passages have it; adaptive plans broadcast it or cut its key.
    tagged = each.join(often, ["scope", "word"], "left")
    info = stage(tagged.groupBy("__p").agg(F.first("scope").alias("scope"), F.first("__o").alias("__o"), F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(F.when(F.col("__often"), F.col("word")))).alias("__c")), "sizes")
    told = asked.select("question_id", "scope", F.explode("words").alias("word")).join(often, ["scope", "word"], "left")
    own = told.filter("__often").groupBy("question_id", "scope").agg(F.array_sort(F.collect_list("word")).alias("__q"))
    own = stage(own, "asked")
    rare = each.join(often, ["scope", "word"], "left_anti").select("scope", "word", "__p").join(told.filter("__often IS NULL").select("question_id", "scope", "word").hint("merge"), ["scope", "word"])
    met = rare.groupBy("question_id", "scope", "__p").agg(F.count(F.lit(1)).alias("__hits"))
    met = met.join(info.select("__p", "__n", "__c", "__o").hint("merge"), "__p").join(own.hint("merge"), ["question_id", "scope"], "left")
    matched = F.col("__hits") + F.coalesce(F.size(F.array_intersect("__c", "__q")), F.lit(0))
    near = met.select("question_id", "scope", (matched / F.col("__n")).alias("score"), matched.cast("long").alias("matched"), "__o")
    # What a passage has beside its common words is filled up with strings that no question holds.
    filled = F.concat("__c", F.transform(F.sequence(F.lit(1), F.col("__n") - F.size("__c")), lambda i: F.concat(F.lit("\0"), i.cast("string"))))
    kinds = info.filter(F.size("__c") > 0).groupBy("scope", "__c", "__n").agg(F.min("__o").alias("__o"))
    kinds = kinds.select("scope", F.lit(None).cast("string").alias("doc"), F.when(F.col("__n") > F.size("__c"), filled).otherwise(F.col("__c")).alias("words"), *[F.col(f"__o.`{c}`").alias(c) for c in order])
    sets = stage(own.select("scope", "__q").distinct().withColumn("question_id", F.monotonically_increasing_id()), "sets")
    alike = best_passages(sets.select("question_id", "scope", F.lit(None).cast("string").alias("doc"), F.col("__q").alias("words")), kinds, order, 1, (0.0, 1.0), least, by_passage=True)
    alike = alike.select("question_id", "score", "matched", F.struct(*order).alias("__o")).join(sets, "question_id").drop("question_id")
    both = near.unionByName(own.join(alike.hint("merge"), ["scope", "__q"]).select("question_id", "scope", "score", "matched", "__o"))
    both = both.withColumn("score", F.round("score", DIGITS + 3)).filter((F.col("score") >= least - 1e-9) & (F.col("score") > 0))
    best = F.min(F.struct((-F.round("score", DIGITS)).alias("s"), (-F.col("matched")).alias("m"), "__o", "score", "matched")).alias("b")
    found = both.groupBy("question_id", "scope").agg(best)
    return found.select("question_id", "scope", "b.score", "b.matched", *[F.col(f"b.__o.`{c}`").alias(c) for c in order])


# --- vectors

def cosine_top(vectors: DataFrame, queries: DataFrame, most: int, id_col: str = "vec_id", vec_col: str = "embedding", most_bytes: int = MOST_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the most similar vectors to each query vector, itself left out, ties to the smaller id.

    Candidates stay where they are: a task multiplies its vectors, some thousand at a time, with a part of the queries of
    at most most_bytes and keeps the best of each query, so that no pair is a row. Null vectors and null ids take no part;
    only vectors of one length meet; one of length zero, or with a null component, scores 0.
    """
    spark = vectors.sparkSession
    some = queries.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    total = some.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    parts = -(-total // most_bytes)
    rows = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    found = spark.createDataFrame([], "query_id long, id long, score double")
    for part in range(parts):
        # At most about most_bytes come to the driver.
        held: dict[int, tuple[list, list]] = {}
        for r in some.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect():
            ids, v = held.setdefault(len(r.v), ([], []))
            ids.append(r.id)
            v.append([np.nan if x is None else x for x in r.v])
        sent = spark.sparkContext.broadcast({n: (np.array(ids), _unit(np.array(v).reshape(len(v), n))) for n, (ids, v) in held.items()})
        found = found.unionByName(rows.mapInArrow(_nearest(sent, most), "query_id long, id long, score double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.where(np.isfinite(v).all(axis=1)[:, None], v, 0.0)
    norms = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norms > 0, norms, 1.0)[:, None]


def _nearest(sent, most: int, rows_each: int = 2048, queries_each: int = 256):
    """The best of each query in a task; rows_each times queries_each scores are held at a time, however many there are."""

    def best(parts: list[tuple]) -> tuple:
        r, ids, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, -np.round(s, DIGITS), r))
        r, ids, s = r[order], ids[order], s[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < most
        return r[keep], ids[keep], s[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}
        floors = {n: np.full(len(ids), -np.inf) for n, (ids, _) in sent.value.items()}
        for batch in batches:
            lists, ids = batch.column("v"), batch.column("id").to_numpy()
            at = lists.offsets.to_numpy()
            flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(at)
            for n in set(sizes.tolist()) & sent.value.keys():
                q_ids, q = sent.value[n]
                own = np.flatnonzero(sizes == n)
                for i in range(0, len(own), rows_each):
                    rows = own[i : i + rows_each]
                    units = _unit(flat[(at[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)).T
                    for a in range(0, len(q_ids), queries_each):
                        some, floor = slice(a, a + queries_each), floors[n][a : a + queries_each]
                        scores = q[some] @ units
                        r, c = np.nonzero((np.round(scores, DIGITS) >= floor[:, None]) & (q_ids[some][:, None] != ids[rows][None, :]))
                        if not len(r):
                            continue
                        held[n, a] = kept = best([*([held[n, a]] if (n, a) in held else []), (r, ids[rows][c], scores[r, c])])
                        full = np.bincount(kept[0], minlength=len(scores)) == most
                        last = np.searchsorted(kept[0], np.arange(len(scores)), "right") - 1
                        floor[full] = np.round(kept[2][last[full]], DIGITS)
        for (n, a), (r, ids, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[n][0][a + r]), pa.array(ids), pa.array(s)], ["query_id", "id", "score"])

    return run


# --- names in texts

#: Letters of an anchor at most; a name's rarest part of so many letters is looked for first.
ANCHOR = 6


def names_in_texts(texts: DataFrame, names: DataFrame, scope: str, name: str, text: str) -> DataFrame:
    """Rows of texts beside those of names of the same scope whose name the text contains, cases as they are.

    A name's anchor is that part of it of ANCHOR letters (the whole of a shorter one) which the fewest names of its scope
    have. A text meets the names whose anchor stands in it, and each is then looked for as a whole: the work follows the
    text and its hits, not the number of names. Empty and null names are in no text. Columns of the two must differ but for
    scope.
    """
    parts = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(c) - n + 1)), lambda i: F.substr(c, i, n)))
    known = names.filter(F.col(name) != "").withColumn("__n", F.least(F.char_length(name), F.lit(ANCHOR)))
    each = known.select(scope, name, F.explode(parts(F.col(name), F.col("__n"))).alias("__anchor")).distinct()
    rare = each.groupBy(scope, "__anchor").agg(F.count(F.lit(1)).alias("__names"))
    anchors = each.join(rare.hint("merge"), [scope, "__anchor"]).groupBy(scope, name).agg(F.min_by("__anchor", F.struct("__names", "__anchor")).alias("__anchor"))
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(ANCHOR)), lambda n: parts(F.col(text), n))))
    # Texts are numbered and meet as anchors only; they come back for those that have one. All sides grow with the input:
    # what is small when compressed is many times larger on the driver, so none of them is broadcast.
    rows = stage(texts.withColumn("__text", F.monotonically_increasing_id()), "texts")
    met = rows.select(scope, "__text", F.explode(pieces).alias("__anchor")).join(anchors.hint("merge"), [scope, "__anchor"]).select("__text", scope, name)
    found = met.join(rows.hint("merge"), ["__text", scope]).filter(F.col(text).contains(F.col(name))).select("__text", scope, name)
    return found.join(rows.hint("merge"), ["__text", scope]).join(known.drop("__n").hint("merge"), [scope, name]).drop("__text")
