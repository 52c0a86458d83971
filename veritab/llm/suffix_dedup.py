"""Removal of repeated byte strings by a blockwise suffix sort over a difference cover."""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import ceil_div, drop_scratch, partitions_for, scratch_path, stage

#: Length in bytes of the strings that may start only once.
MATCH = 200
#: A perfect difference set: each non-zero difference modulo PERIOD occurs once among the members of COVER.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Two equal strings of MATCH bytes share a cover position at the same distance from their starts, less than PERIOD
#: from them, so the strings of SAMPLE bytes there are equal, too.
SAMPLE = MATCH - PERIOD + 1
#: Bytes of texts in a chunk, positions fingerprinted at a time, and suffixes sorted in a bucket (on average).
CHUNK_BYTES = 2 << 20
WINDOW = 256 << 10
BUCKET_SUFFIXES = 1 << 20
#: The modulus of the suffixes' fingerprints, a prime.
PRIME = (1 << 61) - 1
#: Bits by which fingerprints are wider than pairs of different strings need, at every size.
SAFE_BITS = 10

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Prints:
    """64-bit polynomial fingerprints of all strings of one length, by prefix sums modulo 2**64 over an odd base.

    Some different strings have equal ones, whatever the base; equal strings always have.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 4 + 5
        self.powers, self.inverses = self._powers(base), self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(WINDOW + MATCH + 1, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(out, dtype=np.uint64)

    def of(self, data: np.ndarray, length: int) -> np.ndarray:
        """The fingerprint of data[i : i + length] at each i; data holds WINDOW + MATCH bytes at most."""
        n = len(data) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.table[data] * self.powers[: len(data)], out=sums[1:])
            return (sums[length:] - sums[:-length]) * self.inverses[:n]


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for factors below it, in 31-bit halves."""
    low31, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low31, b >> np.uint64(31), b & low31
    mid = a1 * b0 + a0 * b1
    return _fold((a1 * b1 << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & low30) << np.uint64(31)) + a0 * b0)


class _Lane:
    """Polynomial fingerprints of strings of MATCH bytes modulo PRIME over a base that is drawn anew in each run.

    Two different strings agree for MATCH - 1 of the 2**61 bases at most, whatever they hold, and no text can be made
    to agree without knowing the base.
    """

    def __init__(self, base: int):
        powers, self.inverses = self._powers(base), self._powers(pow(base, -1, PRIME))
        self.highs, self.lows = powers >> np.uint64(31), powers & np.uint64((1 << 31) - 1)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out, x = np.empty(WINDOW + MATCH + 1, np.uint64), 1
        for i in range(len(out)):
            out[i] = x
            x = x * base % PRIME
        return out

    def at(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The fingerprint of data[i : i + MATCH] for each i of places; data holds WINDOW + MATCH bytes at most."""
        low30 = np.uint64((1 << 30) - 1)
        d, ends = data.astype(np.uint64) + np.uint64(1), places + MATCH
        # Prefix sums of both 31-bit halves of byte * power; neither overflows in a window.
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(d * self.highs[: len(data)], out=sums[1:])
        high = sums[ends] - sums[places]
        np.cumsum(d * self.lows[: len(data)], out=sums[1:])
        low = sums[ends] - sums[places]
        return _times(_fold((high >> np.uint64(30)) + ((high & low30) << np.uint64(31)) + low), self.inverses[places])


_PRINTS: dict[int, _Prints] = {}
_LANES: dict[int, _Lane] = {}
#: Seed of the fingerprints of the cover sample.
SAMPLE_SEED = 1000


def _prints(seed: int) -> _Prints:
    if seed not in _PRINTS:
        if len(_PRINTS) > 4:
            _PRINTS.clear()
        _PRINTS[seed] = _Prints(seed)
    return _PRINTS[seed]


def _lane(base: int) -> _Lane:
    if base not in _LANES:
        if len(_LANES) > 4:
            _LANES.clear()
        _LANES[base] = _Lane(base)
    return _LANES[base]


class _Chunk:
    """Whole texts as one byte array; ends[i] is where text i ends."""

    def __init__(self, blob: np.ndarray, sizes: np.ndarray):
        self.data, self.ends = blob, np.cumsum(sizes.astype(np.int64))
        self.starts = self.ends - sizes

    def windows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, distance from the text's start, distance to its end) for consecutive positions."""
        for a in range(0, len(self.data), WINDOW):
            b = min(a + WINDOW, len(self.data))
            i, j = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.starts, b, "left")
            counts = np.minimum(self.ends[i:j], b) - np.maximum(self.starts[i:j], a)
            at = np.arange(a, b)
            yield a, b, at - np.repeat(self.starts[i:j], counts), np.repeat(self.ends[i:j], counts) - at

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions with SAMPLE bytes left, and the fingerprints there: equal ones have equal rank in the cover."""
        positions, prints = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for a, b, done, left in self.windows():
            got = np.flatnonzero(_IN_COVER[done % PERIOD] & (left >= SAMPLE))
            positions.append(got + a)
            prints.append(_prints(SAMPLE_SEED).of(self.data[a : b + SAMPLE - 1], SAMPLE)[got])
        return np.concatenate(positions), np.concatenate(prints)

    def suffixes(self, tied: np.ndarray, plan: _Plan) -> tuple[np.ndarray, np.ndarray]:
        """Positions from which a tied cover position lies less than PERIOD ahead, with MATCH bytes left; their keys."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, np.maximum(tied - (PERIOD - 1), 0), 1)
        np.add.at(change, tied + 1, -1)
        near = np.cumsum(change[:-1]) > 0
        positions, keys = [np.empty(0, np.int64)], [np.empty(0, _KEY)]
        for a, b, _, left in self.windows():
            got = np.flatnonzero(near[a:b] & (left >= MATCH))
            if len(got):
                positions.append(got + a)
                data = self.data[a : b + MATCH - 1]
                second = _prints(plan.seed).of(data, MATCH)[got] >> np.uint64(64 - 8 * plan.extra) if plan.extra else None
                keys.append(_key(_lane(plan.base).at(data, got) << np.uint64(3), second))
        return np.concatenate(positions), np.concatenate(keys)


#: A suffix's key: its fingerprint modulo PRIME, and as many bytes of another one as the plan wants.
_KEY = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _key(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(len(a), _KEY)
    out["a"] = a
    if b is not None:
        out["b"] = b
    return out


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, which of the sorted ones differ from the one before, and the distinct keys."""
    order = np.argsort(keys["a"])
    got = keys[order]
    new = np.ones(len(keys), bool)
    equal = got["a"][1:] == got["a"][:-1]
    # Equal first lanes with different second ones hardly occur.
    if (equal & (got["b"][1:] != got["b"][:-1])).any():
        order = np.lexsort((keys["b"], keys["a"]))
        got = keys[order]
        equal = (got["a"][1:] == got["a"][:-1]) & (got["b"][1:] == got["b"][:-1])
    new[1:] = ~equal
    return order, new, got[new]


def _hits(keys: np.ndarray, found: list | None, bits: int) -> np.ndarray:
    """Which keys occur again among themselves, or in other chunks as _ties() found."""
    order, new, own = _ranks(keys)
    at = np.cumsum(new) - 1
    hit = np.bincount(at, minlength=len(own)) > 1
    bucket = own["a"] >> np.uint64(64 - bits) if bits else np.zeros(len(own), np.uint64)
    for f in found or ():
        a, b = np.searchsorted(bucket, np.uint64(f["bucket"])), np.searchsorted(bucket, np.uint64(f["bucket"]), "right")
        hit[a:b] |= np.unpackbits(np.frombuffer(zstandard.decompress(f["flags"]), np.uint8), count=int(b - a)).astype(bool)
    out = np.empty(len(keys), bool)
    out[order] = hit[at]
    return out


def _squeeze(keys: np.ndarray, extra: int) -> bytes:
    """Sorted keys as compressed differences, byte planes apart; the second lane's bytes follow as they are."""
    steps = np.diff(keys["a"], prepend=np.zeros(1, np.uint64))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    tail = np.ascontiguousarray(np.ascontiguousarray(keys["b"]).view(np.uint8).reshape(-1, 8)[:, :extra])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + tail.tobytes())


def _expand(packed: bytes, extra: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = len(raw) // (8 + extra)
    steps = np.ascontiguousarray(np.frombuffer(raw[: 8 * n], np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    tail = np.zeros((n, 8), np.uint8)
    tail[:, :extra] = np.frombuffer(raw[8 * n :], np.uint8).reshape(n, extra)
    with np.errstate(over="ignore"):
        return _key(np.cumsum(steps, dtype=np.uint64), tail.view(np.uint64).ravel())


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, sizes, blob, rows): texts of about CHUNK_BYTES together, with their other columns."""
    row_type = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType()), T.StructField("rows", T.ArrayType(row_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            blobs, others = batch.column("bytes"), batch.column("row")
            sizes = np.array([len(x) if x is not None else 0 for x in blobs.to_pylist()], np.int64)
            a, total = 0, 0
            for b in range(1, len(sizes) + 1):
                total += int(sizes[b - 1])
                if total >= CHUNK_BYTES or b == len(sizes):
                    blob = b"".join(x or b"" for x in blobs.slice(a, b - a).to_pylist())
                    own = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), others.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sizes[a:b]], pa.list_(pa.int64())), pa.array([blob], pa.binary()), own], ["chunk", "sizes", "blob", "rows"])
                    chunk, a, total = chunk + 1, b, 0

    return rows.mapInArrow(run, schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
            yield batch, i, _Chunk(np.frombuffer(batch.column("blob")[i].as_buffer() or b"", np.uint8), sizes)


_BLOCKS = "bucket long, chunk long, keys binary"


def _deal(chunk: int, keys: np.ndarray, bits: int, extra: int) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys by bucket, the leading bits of the first lane."""
    if not len(keys):
        return
    bucket = (keys["a"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(keys, cuts)
    for a in range(0, len(parts), 64):
        some = parts[a : a + 64]
        yield pa.RecordBatch.from_arrays([pa.array([int(b) for b in bucket[np.concatenate([[0], cuts])][a : a + 64]]), pa.array([chunk] * len(some)), pa.array([_squeeze(p, extra) for p in some], pa.binary())], ["bucket", "chunk", "keys"])


def _ties(blocks: DataFrame, extra: int) -> DataFrame:
    """Sort one bucket at a time; (chunk, list of (bucket, flags)): which of a chunk's keys other chunks hold as well.

    A chunk sends each key once, so the most frequent string has one entry a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        bucket = None

        def close() -> Iterator[pa.RecordBatch]:
            parts = [_expand(k, extra) for _, k in held]
            tied = _hits(np.concatenate(parts), None, 0)
            flags = np.split(tied, np.cumsum([len(p) for p in parts])[:-1])
            rows = [(c, zstandard.compress(np.packbits(f).tobytes(), 1)) for (c, _), f in zip(held, flags, strict=True) if f.any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows]), pa.array([bucket] * len(rows)), pa.array([f for _, f in rows], pa.binary())], ["chunk", "bucket", "flags"])

        for batch in batches:
            for b, c, k in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("keys"), strict=True):
                if b != bucket and held:
                    yield from close()
                    held = []
                bucket = b
                held.append((c, k.as_py()))
        if held:
            yield from close()

    spark = blocks.sparkSession
    dealt = blocks.repartition(partitions_for(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk long, bucket long, flags binary").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias("found"))


class _Plan:
    """What the passes agree on, from the number of bytes alone."""

    def __init__(self, total: int):
        samples = total * len(COVER) // PERIOD + 1
        self.sample_buckets = max(0, (ceil_div(samples, BUCKET_SUFFIXES) - 1).bit_length())
        # So many leading bits that a sample ties by chance once in 4096 times; such a tie costs a look, nothing else.
        self.kept = min(64, samples.bit_length() + 12)
        self.buckets = max(0, (ceil_div(total // 4 + 1, BUCKET_SUFFIXES) - 1).bit_length())
        # Key width by one rule: were all positions different strings, some two would agree once in 2**SAFE_BITS runs.
        self.extra = max(0, ceil_div(2 * total.bit_length() - 1 + SAFE_BITS - 61, 8))
        self.base, self.seed = secrets.randbelow(PRIME - 300) + 256, secrets.randbits(62)

    def sample_keys(self, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        at, prints = chunk.samples()
        return at, _key(prints & ~np.uint64((1 << (64 - self.kept)) - 1))

    def tied(self, chunk: _Chunk, found: list | None) -> np.ndarray:
        """Cover positions whose rank is shared: elsewhere in the chunk or in another one."""
        at, keys = self.sample_keys(chunk)
        return at[_hits(keys, found, self.sample_buckets)]


def repeated_spans(docs: DataFrame, text_col: str = "text", finish=None) -> DataFrame:
    """n_bytes (of the text in UTF-8; null: empty), spans (array of [start, end)), out and row, a struct of docs' other columns.

    finish makes out, a string, from the bytes that are left of a text; without it out is null.

    Spans are the maximal runs of bytes covered by a string of MATCH bytes that also starts anywhere else in the
    table, in the same text or another; strings never cross texts. Rows are the unit: repeated rows repeat each
    other's text. Other columns, whatever their names, come back inside row. An empty table gives an empty result.

    Chunks of whole texts are written once, bucketed by chunk, so that passes over them never shuffle texts.
    (1) The cover sample: strings of SAMPLE bytes at cover positions are ranked by fingerprint, bucket by bucket; equal
    rank is a tie. (2) Only suffixes less than PERIOD before a tied cover position can have an equal one for MATCH
    bytes; these long ties are settled in buckets of suffixes keyed by the fingerprint of their first MATCH bytes, one
    bucket in memory at a time. Suffixes are ordered by fingerprints, not letters: the job needs neighbours that are
    equal to a depth, and that order spreads any common prefix over all buckets. Bytes are not compared: fingerprints
    are taken modulo a prime over bases drawn in each run, and are as wide as the number of bytes asks (see _Plan).
    """
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("__none")]).alias("row"))
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))).first()[0] or 0
    plan = _Plan(total)
    name = f"veritab_chunks_{uuid.uuid4().hex}"
    buckets = max(partitions_for(spark), ceil_div(total, 32 * CHUNK_BYTES))
    path = scratch_path(spark, "chunks")
    _chunks(source).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    row_schema = source.schema["row"].dataType

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _each(batches):
            yield from _deal(batch.column("chunk")[i].as_py(), _ranks(plan.sample_keys(chunk)[1])[2], plan.sample_buckets, 0)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _each(batches):
            tied = plan.tied(chunk, batch.column("samples")[i].as_py())
            _, keys = chunk.suffixes(tied, plan)
            yield from _deal(batch.column("chunk")[i].as_py(), _ranks(keys)[2], plan.buckets, plan.extra)

    out_schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("out", T.StringType()), T.StructField("row", row_schema)])

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, chunk in _each(batches):
            tied = plan.tied(chunk, batch.column("samples")[i].as_py())
            at, keys = chunk.suffixes(tied, plan)
            hit = at[_hits(keys, batch.column("matches")[i].as_py(), plan.buckets)]
            owner = np.searchsorted(chunk.ends, hit, "right")
            starts, ends, texts = _runs(hit, owner)
            spans: list[list] = [[] for _ in chunk.ends]
            for t, a, b in zip(texts.tolist(), starts.tolist(), ends.tolist(), strict=True):
                base = int(chunk.starts[t])
                spans[t].append([a - base, b - base])
            bounds = zip(chunk.starts.tolist(), chunk.ends.tolist(), spans, strict=True)
            out = [finish(_cut(chunk.data[a:b].tobytes(), s)) if finish else None for a, b, s in bounds]
            lists = batch.column("rows")
            off = lists.offsets[i].as_py()
            sizes = chunk.ends - chunk.starts
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(out, pa.string()), lists.values.slice(off, len(sizes))], ["n_bytes", "spans", "out", "row"])

    try:
        samples = stage(_ties(chunks.select("chunk", "sizes", "blob").mapInArrow(first, _BLOCKS), 0), "cover").withColumnRenamed("found", "samples")
        with_samples = chunks.join(samples, "chunk", "left")
        matches = stage(_ties(with_samples.select("chunk", "sizes", "blob", "samples").mapInArrow(second, _BLOCKS), plan.extra), "matches").withColumnRenamed("found", "matches")
        out = with_samples.join(matches, "chunk", "left").select("sizes", "blob", "samples", "matches", "rows").mapInArrow(third, out_schema)
        return stage(out, "spans")
    finally:
        spark.sql(f"DROP TABLE {name}")
        drop_scratch(spark, [path])


def _runs(hits: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by [h, h + MATCH) for sorted starts h of strings inside text owner[h]: start, end, text."""
    if not len(hits):
        return hits, hits, owner
    cut = np.flatnonzero((np.diff(hits) > MATCH) | (np.diff(owner) > 0))
    first = np.concatenate([[0], cut + 1])
    return hits[first], hits[np.concatenate([cut, [len(hits) - 1]])] + MATCH, owner[first]


def _cut(data: bytes, spans) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _text(left: bytes) -> str:
    return left.decode("utf-8", "ignore")


def _sha(left: bytes) -> str:
    return hashlib.sha256(left).hexdigest()


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of their texts; bytes of a character that was cut through are dropped."""
    found = repeated_spans(docs, text_col, _text)
    return found.select(*[F.col("out" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; a null text is empty, repeated rows repeat each other."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    found = repeated_spans(docs.select("doc_id", "text"), finish=_sha)
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("out").alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
