"""Ranked lexical search: posting lists with range-maximum tables, best documents first."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.llm.common import stage

#: A block of the index closes at so many documents or postings: a search holds one block and its tables, some
#: 8 * log2(BLOCK_DOCS) bytes a posting.
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 400_000
#: Items whose terms take so many bytes are searched for at once; further items in further blocks.
ITEM_BYTES = 8 << 20
#: Intervals that are split at once.
BATCH = 128
#: Of 16 parts of the index by hash of the block, so many are searched first: what they find bounds the rest.
ROUNDS = ((0, 1), (1, 4), (4, 16))

#: Bytes that are no part of a term become spaces, A-Z become a-z; bytes from 0x80 on belong to characters from U+0080 on.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
INDEX_SCHEMA = "block long, n_docs long, n_terms long, doc_ids array<{id}>, lengths array<long>, terms array<binary>, counts array<long>, places binary, tfs binary"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_FOLD).split() if text else []


def build_index(docs: DataFrame, only: set[bytes] | None = None) -> DataFrame:
    """Blocks of posting lists of docs (doc_id, text) in rows of INDEX_SCHEMA, staged; nothing is shuffled.

    A block holds its documents in ascending doc_id order (null last) with their numbers of terms, and for each term the
    places of the documents that hold it and its occurrences there. only: keep posting lists of these terms alone; every
    document with a term counts all the same. Documents without terms are not in the index.
    """
    held = docs.sparkSession.sparkContext.broadcast(frozenset(only)) if only is not None else None
    kind = docs.schema["doc_id"].dataType
    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted = held.value if held is not None else None
        base, made, postings = TaskContext.get().partitionId() << 32, 0, 0
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal made, postings
            rows.sort(key=lambda r: (r[0] is None, r[0]) if r[0] is not None else (True, 0))
            lists: dict[bytes, tuple[list, list]] = {}
            for place, (_, _, found) in enumerate(rows):
                for t, tf in found.items():
                    places, tfs = lists.setdefault(t, ([], []))
                    places.append(place)
                    tfs.append(tf)
            order = sorted(lists)
            flat = [np.array([x for t in order for x in lists[t][i]], d).tobytes() for i, d in ((0, "<u2"), (1, "<u4"))]
            lengths = [n for _, n, _ in rows]
            values = [base + made, len(rows), sum(lengths), [i for i, _, _ in rows], lengths, order, [len(lists[t][0]) for t in order], *flat]
            made, postings = made + 1, 0
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        types = [pa.int64(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            types[3] = pa.list_(ids.type)
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                terms = terms_of(text.as_py())
                if terms:
                    found = Counter(terms if wanted is None else filter(wanted.__contains__, terms))
                    rows.append((doc_id, len(terms), found))
                    postings += len(found)
                    if len(rows) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                        yield close()
        if rows:
            yield close()

    return stage(docs.select("doc_id", "text").mapInArrow(run, INDEX_SCHEMA.format(id=kind.simpleString())), "index")


class Block:
    """One block's posting lists as impacts, with a sparse table of range maxima each.

    A table entry holds impact << 16 | 0xffff - place, so that a maximum names its leftmost document, too.
    """

    def __init__(self, row: dict, weights: dict[bytes, int], n_docs: int, n_terms: int):
        self.doc_ids = row["doc_ids"]
        self.size = len(self.doc_ids)
        n = np.array(row["lengths"], np.int64)
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        places, tfs = np.frombuffer(row["places"], "<u2"), np.frombuffer(row["tfs"], "<u4").astype(np.int64)
        self.places: dict[bytes, np.ndarray] = {}
        self.rows: dict[bytes, int] = {}
        tables, starts, at, filled = [], [], 0, 0
        for term, count in zip(row["terms"], row["counts"], strict=True):
            w = weights.get(term)
            if w:
                p, tf = places[at : at + count].astype(np.int64), tfs[at : at + count]
                level = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[p])) << 16 | 0xFFFF - p
                self.rows[term], self.places[term] = len(starts), p
                own, width = [], 1
                while True:
                    own.append(filled)
                    tables.append(level)
                    filled += len(level)
                    if 2 * width > count:
                        break
                    level = np.maximum(level[:-width], level[width:])
                    width *= 2
                starts.append(own)
            at += count
        deepest = max(map(len, starts), default=0)
        self.starts = np.array([s + [0] * (deepest - len(s)) for s in starts], np.int64).reshape(len(starts), deepest)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.log = np.zeros(self.size + 2, np.int64)
        for i in range(2, self.size + 2):
            self.log[i] = self.log[i // 2] + 1

    def search(self, terms: list[bytes], k: int, floor: int = 1, last: int = 1 << 62) -> list[tuple[int, int]]:
        """The k best (score, place) of this block, ties to the smaller place; only scores above floor, or floor at a place up to last.

        Intervals of documents wait with the sum of their lists' maxima, which no document inside exceeds. Those with the
        highest sums are split at the document of the largest impact, whose score is then known, until no interval left can
        hold a document that would enter the k best.
        """
        terms = [t for t in terms if t in self.rows]
        if not terms:
            return []
        starts = self.starts[[self.rows[t] for t in terms]]
        rank = np.zeros((len(terms), self.size + 1), np.int32)
        for i, t in enumerate(terms):
            rank[i, self.places[t] + 1] = 1
        np.cumsum(rank, axis=1, out=rank)
        row, table, log = np.arange(len(terms))[:, None], self.table, self.log

        def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low, n = rank[:, a], rank[:, b]
            n = n - low
            some = n > 0
            level = log[n]
            at = np.where(some, starts[row, level] + low, 0)
            best = np.where(some, np.maximum(table[at], table[np.where(some, at + n - (1 << level), 0)]), 0)
            return (best >> 16).sum(axis=0), 0xFFFF - (best.max(axis=0) & 0xFFFF)

        def scores(at: np.ndarray) -> np.ndarray:
            low = rank[:, at]
            there = rank[:, at + 1] > low
            return np.where(there, table[np.where(there, starts[:, :1] + low, 0)] >> 16, 0).sum(axis=0)

        found_score, found_place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.array([0]), np.array([self.size])
        bound, split = bounds(a, b)
        while True:
            open_ = (bound > floor) | (bound == floor) & (a <= last)
            if not open_.any():
                break
            a, b, bound, split = a[open_], b[open_], bound[open_], split[open_]
            if len(a) > BATCH:
                order = np.lexsort((a, -bound))
                now, wait = order[:BATCH], order[BATCH:]
            else:
                now, wait = np.arange(len(a)), np.zeros(0, np.int64)
            at = split[now]
            got = scores(at)
            good = (got > floor) | (got == floor) & (at <= last)
            found_score, found_place = np.concatenate([found_score, got[good]]), np.concatenate([found_place, at[good]])
            if len(found_score) >= k:
                order = np.lexsort((found_place, -found_score))[:k]
                found_score, found_place = found_score[order], found_place[order]
                floor, last = int(found_score[-1]), int(found_place[-1])
            na, nb = np.concatenate([a[now], at + 1]), np.concatenate([at, b[now]])
            some = nb > na
            na, nb = na[some], nb[some]
            new_bound, new_split = bounds(na, nb)
            a, b, bound, split = np.concatenate([a[wait], na]), np.concatenate([b[wait], nb]), np.concatenate([bound[wait], new_bound]), np.concatenate([split[wait], new_split])
        order = np.lexsort((found_place, -found_score))[:k]
        return list(zip(found_score[order].tolist(), found_place[order].tolist(), strict=True))


def _search(items: list[tuple], weights: dict[bytes, int], floors: dict[int, tuple], n_docs: int, n_terms: int, k: int, item_type: pa.DataType):
    """items: (item_id, terms). floors: by number of the item, the k-th best (score, doc_id) known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("doc_ids", "lengths", "terms", "counts", "places", "tfs")}
                block = Block(row, weights, n_docs, n_terms)
                ids = block.doc_ids
                known = [d for d in ids if d is not None]
                out: tuple[list, list, list] = ([], [], [])
                for number, (item_id, terms) in enumerate(items):
                    floor, doc_id = floors.get(number, (1, None))
                    # Documents of a larger id lose a tie with the k-th best; null ids lose every tie.
                    last = len(ids) if number not in floors or doc_id is None else int(np.searchsorted(known, doc_id, "right")) - 1
                    for score, place in block.search(terms, k, floor, last):
                        for column, x in zip(out, (item_id, ids[place], score), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], item_type), pa.array(out[1], batch.column("doc_ids").type.value_type), pa.array(out[2], pa.int64())], ["item_id", "doc_id", "score"])

    return run


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct, sorted); rows of one item_id, null too, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    each = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return each.select("item_id", F.explode("terms").alias("term")).distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k best documents of docs (doc_id, text) for each item (item_id, text): item_id, rank (from 1), doc_id, score.

    Score and terms as README states them. Only scores above 0, fewer than k if there are no more; equal scores by
    ascending doc_id, null ids last; each row of a repeated doc_id is a document. Null and empty texts have no terms: such
    a document is not counted, such an item has no row. Rows of one item_id are one item. Empty tables give an empty
    result. Other columns are not read.

    Items go in blocks of at most item_bytes of terms. With one block the index holds posting lists of its terms alone,
    else of all terms. Each block of items is searched in every index block where it lies, in three rounds: what the first
    sixteenth and the first quarter of the index blocks yield bounds the search in the rest.
    """
    spark = docs.sparkSession
    wanted = stage(_item_terms(items), "items")
    total = wanted.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 8))).first()[0]
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    blocks = max(1, -(-(total or 0) // item_bytes))
    all_terms = None
    if blocks == 1:
        all_terms = {bytes(r.term) for r in wanted.select(F.explode("terms").alias("term")).distinct().collect()}
    index = build_index(docs, all_terms)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs or not total:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    df = index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n")))).groupBy("term").agg(F.sum("n").alias("df"))
    df = stage(df, "df") if blocks > 1 else df
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    done = []
    for b in range(blocks):
        some = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        asked = some.select(F.explode("terms").alias("term")).distinct()
        # At most item_bytes of terms and items come to the driver.
        weights = {bytes(r.term): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in df.join(asked, "term", "left_semi").collect()}
        held = [(r.item_id, [bytes(t) for t in r.terms]) for r in some.orderBy("item_id").collect()]
        number = {item_id: i for i, (item_id, _) in enumerate(held)}
        item_type = pa.schema(some.select("item_id").limit(0).toArrow().schema).field(0).type
        best, floors = None, {}
        for low, high in ROUNDS:
            part = index.filter((F.pmod(F.xxhash64("block"), F.lit(16)) >= low) & (F.pmod(F.xxhash64("block"), F.lit(16)) < high))
            found = part.mapInArrow(_search(held, weights, floors, n_docs, n_terms, k, item_type), schema)
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            best = stage(found.withColumn("rank", rank).filter(F.col("rank") <= k), "best")
            if high < 16:
                floors = {number[r.item_id]: (r.score, r.doc_id) for r in best.filter(F.col("rank") == k).collect()}
        done.append(best)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("item_id", "rank", "doc_id", "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return search(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM i JOIN f USING (term), s),
g AS (SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id,
  sum(q.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * p.n * s.nn) // s.ll)))))::BIGINT AS score
  FROM q JOIN p USING (term), s GROUP BY q.item_id, p.r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
