"""Best-fit-decreasing packing with lower bounds from dual feasible functions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import ceil_div, slices, stage, texts_of
from veritab.llm.encode import encoder_for

CAPACITY = 4096
#: Pieces of text whose ids a worker keeps; idle workers hold theirs while other stages run.
MOST_KEPT = 600_000
#: Pieces that one packing task holds, on average.
GROUP_PIECES = 20_000
#: Exchanges in a row that save no sequence and certify no partition, after which partitions stay as they are.
VAIN_ROUNDS = 2

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, fill long, part long, bins long, bound long"


def pieces(docs: DataFrame, path: str, keep_space: bool, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows of PIECE_SCHEMA: each document's ids with end_id after them, cut only where longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.uint32(end_id).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
            for a, b in slices(texts):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[a:b], encoder_for(path, keep_space, MOST_KEPT).encode(texts[a:b]), strict=True):
                    ids += tail
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc_id, p, at // 4, len(cut) // 4, zlib.crc32(cut)))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that items need at least. counts[x] is the number of items of length x, 0 to capacity.

    The largest of the bounds from two families of dual feasible functions: the one that rounds items above
    capacity - e up to a whole bin and those below e down to nothing, for every e to half a bin, and the one that
    rounds (k + 1) x / capacity down, for k to 20.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    n_above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # items of length >= i
    mass = np.concatenate([[0], np.cumsum(counts * x)])  # total length of items < i
    e = np.arange(0, capacity // 2 + 1)
    best = int((-(-(capacity * n_above[capacity - e + 1] + mass[capacity - e + 1] - mass[e]) // capacity)).max())
    for k in range(1, 21):
        value = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; lengths come in descending order."""
    room_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin has r left
    fills: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            stack = room_bins[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            if not rooms >> left & 1:
                rooms |= 1 << left
                room_bins[left] = []
            room_bins[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _pack_round(items: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, fills = best_fit(frame["length"].to_numpy(), capacity)
        bound = lower_bound(np.bincount(frame["length"], minlength=capacity + 1), capacity)
        return frame.assign(sequence_id=(turn << 52) + (part << 28) + bins, offset=offsets, fill=fills[bins], bins=len(fills), bound=bound)

    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, PACKED_SCHEMA)


def pack(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack rows of PIECE_SCHEMA into sequences of at most capacity; adds sequence_id, offset, sequences and lower_bound.

    Every partition is packed by best-fit decreasing and has a lower bound of its own. One that meets it is certified and
    closed. The pieces of all others are exchanged: pooled, dealt to as many partitions in another way, and packed again.
    A round that neither certifies a partition nor saves a sequence is undone; after VAIN_ROUNDS of those in a row, or
    with one partition left, the rest stays as it is. Last, sequences at most half full are pooled. sequences is the number of sequences made and lower_bound the
    bound of all pieces together, so their difference is what may be left to save. Repeated rows are packed like any
    others; a null doc_id is kept; an empty table gives an empty result.
    """
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")] + ["sequence_id", "offset"]
    # At most capacity rows: the histogram of lengths.
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    parts, turn, vain = max(1, ceil_div(int(histogram.sum()), group_pieces)), 0, 0
    best, bins, done, closed = _pack_round(items, parts, turn, capacity), None, [], 0
    best = stage(best, "packed")
    while True:
        # One row a partition, added up: sequences and partitions above their bound, and sequences of the certified ones.
        open_ = F.col("bins") > F.col("bound")
        each = best.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        now = each.agg(F.sum(F.when(open_, F.col("bins"))).alias("bins"), F.count(F.when(open_, 1)).alias("parts"), F.sum(F.when(~open_, F.col("bins"))).alias("closed")).first()
        closed += now.closed or 0
        bins = now.bins or 0
        if now.closed:
            done.append(best.filter(~open_))
            best = best.filter(open_)
        again = None
        while now.parts > 1 and vain < VAIN_ROUNDS:
            turn += 1
            again = stage(_pack_round(best.select(*names[:5]), now.parts, turn, capacity), "packed")
            total = again.groupBy("part").agg(F.first("bins").alias("bins"), (F.first("bins") <= F.first("bound")).alias("certified")).agg(F.sum("bins").alias("bins"), F.max("certified").alias("certified")).first()
            if total.bins < bins or total.certified and total.bins == bins:
                vain = 0
                break
            again, vain = None, vain + 1
        if again is None:
            break
        best = again
    for d in done:
        best = best.unionByName(d)
    total, bound = closed + bins, lower_bound(histogram, capacity)
    # Sequences at most half full, one a partition at most: they exchange their pieces once more.
    loose = F.col("fill") * 2 <= capacity
    left = best.filter(loose).agg(F.count_distinct("sequence_id").alias("bins"), F.count(F.lit(1)).alias("n")).first()
    if total > bound and left.bins > 1:
        again = stage(_pack_round(best.filter(loose).select(*names[:5]), ceil_div(left.n, group_pieces), turn + 1, capacity), "packed")
        made = again.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if made < left.bins:
            best, total = best.filter(~loose).unionByName(again), total - left.bins + made
    return best.select(*names).withColumn("sequences", F.lit(total).cast("long")).withColumn("lower_bound", F.lit(bound).cast("long"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text; null: empty) as packed pieces with the word_bpe vocabulary and end id 1."""
    return pack(stage(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keep_space=False, end_id=1), "pieces"))
