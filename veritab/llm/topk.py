"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritab.llm.common import partitions_for, stage

#: Vectors in a block; a task holds one query block, one candidate block and their scores at a time.
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 1024
BINS = 512
#: Query blocks of so many bytes in all are broadcast; more are sent to every group of candidate blocks.
MOST_BROADCAST = 16 << 20

BLOCK_SCHEMA = "block long, dim int, width int, ids array<long>, vectors binary"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as double. Null or non-finite components: no row."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.filter(F.col(vec_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of BLOCK_SCHEMA, up to size vectors of one dimension each; components are integers of width bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            got = held.pop(dim)
            ids, v = [i for i, _ in got], np.concatenate([x for _, x in got]) if dim else np.empty(0, np.int64)
            made += 1
            low, high = int(v.min(initial=0)), int(v.max(initial=0))
            width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
            return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([dim], pa.int32()), pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([v.astype(f"<i{width}").tobytes()], pa.binary())], ["block", "dim", "width", "ids", "vectors"])

        for batch in batches:
            lists = batch.column("v")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                v = flat[at[i] : at[i + 1]]
                held.setdefault(len(v), []).append((vec_id, v.copy()))
                if len(held[len(v)]) >= size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def _pairs(candidates: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """Each candidate block beside each query block of its dimension: a stated query set against all rows, in blocks."""
    q = queries.select("dim", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "state")
    if small:
        return candidates.join(F.broadcast(q), "dim")
    groups = partitions_for(candidates.sparkSession)
    q = q.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(q, ["dim", "group"])


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and their int64 scores; a query's own row scores the smallest long."""
    dim = row["dim"]
    q_ids, c_ids = np.array(row["q_ids"], np.int64), np.array(row["ids"], np.int64)
    q, c = np.frombuffer(row["q_vectors"], f"<i{row['q_width']}").astype(np.int64).reshape(len(q_ids), dim), np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(len(c_ids), dim)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1)
    # Sums below 2**53 are exact in double, where the product is a fast one.
    scores = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if most < 2**53 else q @ c.T
    scores[q_ids[:, None] == c_ids[None, :]] = np.iinfo(np.int64).min
    return q_ids, c_ids, scores


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in names}


_PAIR = ("dim", "width", "ids", "vectors", "q_width", "q_ids", "q_vectors", "state")


def _histograms(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, bin, n): scores of each query's current range [low, low + span) by bin of its width.

    A block's bins below its own k-th score can't hold the k-th score of all, so they are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, _PAIR):
            q_ids, _, scores = _scores(row)
            state = {s["query_id"]: s for s in row["state"]}
            low = np.array([state[i]["low"] for i in q_ids.tolist()])[:, None]
            width = np.array([state[i]["width"] for i in q_ids.tolist()])[:, None]
            span = np.array([state[i]["span"] for i in q_ids.tolist()])[:, None]
            top = scores if scores.shape[1] <= k else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]
            cut = top.min(axis=1, keepdims=True) if scores.shape[1] else low
            # The range's own scores at or above the block's k-th one.
            inside = (scores >= np.maximum(low, cut)) & (scores < low + span) & (scores > np.iinfo(np.int64).min)
            r, c = np.nonzero(inside)
            if len(r):
                b = (scores[r, c] - low[r, 0]) // width[r, 0]
                keys, n = np.unique(r * BINS + b, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[keys // BINS]), pa.array(keys % BINS), pa.array(n.astype(np.int64))], ["query_id", "bin", "n"])

    return pairs.mapInArrow(run, "query_id long, bin long, n long")


def _winners(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) at or above each query's k-th score; of a block's ties at it the k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, _PAIR):
            q_ids, c_ids, scores = _scores(row)
            state = {s["query_id"]: s["low"] for s in row["state"]}
            low = np.array([state[i] for i in q_ids.tolist()])[:, None]
            r, c = np.nonzero((scores >= low) & (scores > np.iinfo(np.int64).min))
            order = np.lexsort((c_ids[c], -scores[r, c], r))
            r, c = r[order], c[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, c = r[place < k], c[place < k]
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(c_ids[c]), pa.array(scores[r, c])], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Each query's k highest integer inner products over all other rows: query_id, rank, vec_id, score.

    Every pair is scored, block by block. A round counts each query's scores in BINS bins of its current range and
    keeps the bin with the k-th score; when bins have width 1 the k-th score itself is known. Then rows at or above it
    are taken, ties to the smaller id. Fewer than k candidates: all of them. Vectors that are null or hold a null or
    non-finite component take no part; only vectors of one length meet. Ids are the key: a row is no candidate for a
    query of its own id, rows of one query id give one query (its smallest vector), and repeated candidate rows each
    count. Scores that may not fit a long are an error. Null ids take no part; other columns are not read.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, id_col, vec_col, scale).filter("vec_id IS NOT NULL")
    n = partitions_for(spark)
    candidates = stage(_blocks(whole.repartition(n), CANDIDATE_BLOCK), "candidates")
    asked = whole.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stage(_blocks(asked.repartition(max(1, n // 8)), QUERY_BLOCK), "queries")
    # Bound of every score by Cauchy-Schwarz; one number each.
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = whole.agg(F.max(F.sqrt(square))).first()[0]
    if longest is None or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = int(longest * longest * (1 + 1e-9)) + 2
    if reach >= 1 << 61:
        raise ValueError("scores of these vectors may not fit a long")
    width = max(1, -(-(2 * reach + 1) // BINS))
    small = queries.agg(F.sum(F.length("vectors"))).first()[0] <= most_broadcast
    each = asked.select(F.col("vec_id").alias("query_id"))
    state = each.select("query_id", F.lit(-reach).cast("long").alias("low"), F.lit(width).cast("long").alias("width"), F.lit(BINS * width).cast("long").alias("span"), F.lit(0).cast("long").alias("above"))
    where = stage(queries.select("block", F.explode("ids").alias("query_id")), "where")
    while True:
        pairs = _pairs(candidates, _with_state(queries, where, state), small)
        counts = _histograms(pairs, k).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = counts.join(state, "query_id").withColumn("sofar", F.col("above") + F.sum("n").over(down)).filter(F.col("sofar") >= k)
        found = reached.groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("sofar") - F.col("n")).alias("above")), "bin").alias("b"))
        # Queries with fewer than k candidates keep the lowest bin.
        low = F.col("low") + F.coalesce(F.col("b.bin"), F.lit(0)) * F.col("width")
        last = width == 1
        span, width = width, max(1, -(-width // BINS))
        state = stage(state.join(found, "query_id", "left").select("query_id", low.alias("low"), F.lit(width).cast("long").alias("width"), F.lit(span).cast("long").alias("span"), F.coalesce("b.above", "above").alias("above")), "state")
        if last:
            break
    got = _winners(_pairs(candidates, _with_state(queries, where, state), small), k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_state(queries: DataFrame, where: DataFrame, state: DataFrame) -> DataFrame:
    """Query blocks with their queries' states, QUERY_BLOCK at most each."""
    states = where.join(state, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "low", "width", "span")).alias("state"))
    return queries.join(states, "block")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
