"""Spelling variants: words of one edit meet by partition-and-enumerate signatures of their letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import partitions_for, stage

#: Shortest word in code points, fewest occurrences, and how much more frequent a form is.
SHORTEST, FEWEST, TIMES = 7, 2, 10
#: Where 31 divides the checksum of a run, one of its code points is deleted.
DIVISOR = 31
#: Counts that a task holds before it sends them on.
MOST_COUNTS = 200_000
#: Words of one bucket that a task holds; larger buckets are cut by what their words share outside a segment.
MOST_BUCKET = 8192
#: Longer words are compared by two, as their number of places is no small factor; a bucket holds only so many of them.
LONG_WORD, MOST_LONG = 200, 64

#: In latin-1, where every code point outside U+0000 to U+00FF is a question mark; only A-Z are lower-cased.
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % SHORTEST)
#: Letters by part, for vectors that differ in one place (parts of 3) and in two (parts of 4).
_PART = {n: [bytes(b for b in range(256) if b % n != i) for i in range(n)] for n in (3, 4)}
SAME, SHORT, LONG = 0, 1, 2


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of docs (doc_id, text): runs of Latin letters, one code point dropped where the checksum of id and run says so.

    A run that is shorter than SHORTEST can't become a word, so only longer ones are looked at. Null texts have none; a
    null id is the empty string in the checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if (text := text.as_py()) is None:
                    continue
                before = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for w, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                    if h % DIVISOR == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < SHORTEST:
                            continue
                    held[w] += n
                if len(held) >= MOST_COUNTS:
                    yield send()
        if held:
            yield send()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _signatures(word: bytes, role: int, segment: int, segments: int) -> list[int]:
    """Keys of a word in a role: its letter multiset without two (SAME) or one (SHORT, LONG) of the parts, each choice a key.

    The multiset is a binary vector with a place for every occurrence of a letter, cut into parts by letter. A replaced
    letter changes two places, so of 4 parts some 2 are alike; an inserted one changes one place, so of 3 parts 2 are.
    Only what lies in the segment (of the shorter word) may differ if there are several; the rest joins the key.
    """
    length = len(word) - (role == LONG)
    a, b = length * segment // segments, length * (segment + 1) // segments
    end = len(word) - (length - b)
    inside = bytes(sorted(word[a:end]))
    parts = _PART[4 if role == SAME else 3]
    left = [inside.translate(None, others) for others in parts]
    outside = b"%d %d %d %d\n%s\n%s\n" % (role == SAME, length, segment, segments, word[:a], word[end:])
    return [xxhash.xxh3_64_intdigest(outside + b"%d %d\n%s\n%s" % (i, j, left[i], left[j])) - (1 << 63) for i, j in combinations(range(len(parts)), 2)]


def _keyed(words: DataFrame, segments: int) -> DataFrame:
    """key, role, segment, word, n of rows (word, n, role, segment of segments / 2); at first every word in every role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out: tuple[list, ...] = ([], [], [], [], [])
                part = batch.slice(start, 1000)
                had = zip(part.column("role").to_pylist(), part.column("segment").to_pylist(), strict=True) if segments > 1 else ((None, 0) for _ in range(part.num_rows))
                for text, n, (role, segment) in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), had, strict=True):
                    word = text.encode("latin-1")
                    for r in (SAME, SHORT, LONG) if role is None else (role,):
                        for s in (0,) if role is None else (2 * segment, 2 * segment + 1):
                            keys = _signatures(word, r, s, segments)
                            for column, x in zip(out, (keys, [r] * len(keys), [s] * len(keys), [text] * len(keys), [n] * len(keys)), strict=True):
                                column.extend(x)
                types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["key", "role", "segment", "word", "n"])

    return words.mapInArrow(run, "key long, role int, segment int, word string, n long")


def _one_edit(a: str, b: str) -> bool:
    """Whether a, the shorter, and b differ by one code point; equal slices are found by bisection."""
    low, high = 0, len(a)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _bucket_pairs(bucket: list[tuple]) -> Iterator[tuple]:
    """(word, n, other, its n) of the words of one bucket that differ by exactly one code point.

    Words of one length share what is left when the replaced place is taken out of both; a longer word becomes the shorter
    one without the inserted place. So a bucket costs as much as its letters, and no two other words are held together.
    """
    large = [x for x in bucket if len(x[2]) - (x[0] == LONG) > LONG_WORD]
    for (r, _, w, n), (q, _, other, m) in combinations(large, 2):
        if r == q == SAME and len(w) == len(other) and _one_edit(w, other):
            yield w, n, other, m
        elif {r, q} == {SHORT, LONG} and abs(len(w) - len(other)) == 1 and _one_edit(*sorted((w, other), key=len)):
            yield w, n, other, m
    shorter = {w: n for role, _, w, n in bucket if role == SHORT}
    same: dict[tuple[int, str], list[tuple]] = {}
    for role, _, w, n in bucket:
        if len(w) > LONG_WORD + (role == LONG):
            continue
        if role == SAME:
            for i in range(len(w)):
                met = same.setdefault((i, w[:i] + w[i + 1 :]), [])
                for other, m in met:
                    yield w, n, other, m
                met.append((w, n))
        elif role == LONG and shorter:
            for v in {w[:i] + w[i + 1 :] for i in range(len(w))}:
                if v in shorter:
                    yield w, n, v, shorter[v]


def _meet(most: int):
    """Verified pairs of each bucket of rows sorted by key (role = null), or the rows themselves of a bucket beyond most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        bucket: list[tuple] = []
        key, over, large = None, False, 0

        def send() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32())
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n", "other", "m", "role", "segment"])
            out.clear()
            return rows

        def close() -> None:
            if over:
                out.extend((w, n, None, None, role, segment) for role, segment, w, n in bucket)
            elif len(bucket) > 1:
                out.extend((*pair, None, None) for pair in _bucket_pairs(bucket))
            bucket.clear()

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "segment", "word", "n")), strict=True):
                if k != key:
                    close()
                    key, over, large = k, False, 0
                bucket.append(tuple(row))
                large += len(row[2]) > LONG_WORD
                if len(bucket) > most or large > MOST_LONG < most:
                    over = True
                    close()
                if len(out) >= 10_000:
                    yield send()
        close()
        if out:
            yield send()

    return run


def near_pairs(words: DataFrame, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """word, n, other, m: each two of words (word, n; distinct, of letters up to U+00FF) at one edit, in both directions.

    Words meet in buckets of equal signatures. A bucket of over most_bucket words isn't held: its words come again with
    keys that cut them in two segments (then four, and so on) and also hold all letters outside one of them, where the
    edit is. Where a segment is one letter, a bucket has as many words as there are letters (for longer words beside shorter
    ones their square), so the last buckets are small.
    """
    pairs, rows, segments = [], words.select("word", "n"), 1
    n = partitions_for(words.sparkSession)
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    while rows is not None:
        most_bucket = most_bucket if segments < longest else 1 << 62
        dealt = _keyed(rows, segments).repartition(n, "key").sortWithinPartitions("key")
        met = stage(dealt.mapInArrow(_meet(most_bucket), "word string, n long, other string, m long, role int, segment int"), "pairs")
        pairs.append(met.filter("role IS NULL").select("word", "n", "other", "m"))
        over = met.filter("role IS NOT NULL").select("word", "n", "role", "segment").distinct()
        rows, segments = (None if over.isEmpty() else over), 2 * segments
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))).distinct()


def spelling_variants(docs: DataFrame, most_bucket: int = MOST_BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of docs (doc_id, text); see count_words() for what a word is.

    n_near counts the words at one edit, form is the most frequent of them (ties: the smallest) if it occurs TIMES as
    often, root the end of the chain of forms. Null and empty texts have no words; a repeated row counts again; long texts
    are read whole; other columns are not read; an empty table gives an empty result.
    """
    words = stage(count_words(docs).filter(F.col("n") >= FEWEST), "words")
    best = near_pairs(words, most_bucket).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    far = -F.col("best.less") >= TIMES * F.col("n")
    found = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")), "forms")
    # Each step doubles the way; a chain has at most as many words as n has digits.
    steps = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS MATERIALIZED (SELECT doc_id, run, count(*)::BIGINT AS n, row_number() OVER () AS r FROM d WHERE length(run) >= 7 GROUP BY doc_id, run),
b AS (SELECT r, flatten(list_transform(string_split(concat(coalesce(doc_id::VARCHAR, ''), ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END)) AS bytes FROM c),
e AS (SELECT r, unnest(bytes) AS b, generate_subscripts(bytes, 1) AS i FROM b),
k AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list(b ORDER BY i)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM e, tbl GROUP BY r, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substring(run, 1, (h % length(run))::INT), substring(run, (h % length(run))::INT + 2)) ELSE run END AS word, n FROM c JOIN k USING (r)),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS MATERIALIZED (SELECT word, n, i, concat(substring(word, 1, (i - 1)::INT), substring(word, (i + 1)::INT)) AS cut FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT v.word, words.word, words.n FROM v JOIN words ON v.cut = words.word UNION SELECT words.word, v.word, v.n FROM v JOIN words ON v.cut = words.word),
g AS (SELECT word, count(*)::BIGINT AS n_near, min(struct_pack(less := -m, other := other)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 10 * n THEN best.other END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n FROM words LEFT JOIN g USING (word)),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
z AS (SELECT s.word, s.root FROM s JOIN f ON f.word = s.root WHERE f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z USING (word)
"""
