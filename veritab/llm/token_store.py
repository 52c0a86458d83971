"""Token files: each document's ids compressed on its own with a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import partitions_for, scratch_path, slices, texts_of
from veritab.llm.encode import encoder_for

#: A block closes at so many bytes of frames or so many documents, so that a reader holds little.
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 4096
#: Documents that the dictionary is trained on: so many, of at most so many characters.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 32_768
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

BLOCK_SCHEMA = "shard int, block int, first_start long, dict_sha256 string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"


def train_dictionary(docs: DataFrame, path: str, keep_space: bool, end_id: int) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample of whole texts.

    The ids of the SAMPLE_DOCS smallest hashes are chosen first, without texts; then their texts of up to SAMPLE_CHARS
    characters are read, one row an id. Empty if the sample is too small to train on; frames are then written without a
    dictionary.
    """
    some = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    short = docs.filter(F.char_length("text") <= SAMPLE_CHARS)
    # At most SAMPLE_DOCS ids of 8 bytes are broadcast.
    texts = short.join(F.broadcast(some), docs["doc_id"].eqNullSafe(some["doc_id"]), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(encoder_for(path, keep_space).encode(texts[a:b]), pa.binary())], ["ids"])

    tail = np.uint32(end_id).tobytes()
    samples = sorted(bytes(r.ids) + tail for r in texts.select("text").mapInArrow(ids, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _blocks(path: str, keep_space: bool, end_id: int, dictionary: bytes, sha: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True)
        tail = np.uint32(end_id).tobytes()
        state = {"block": 0, "start": 0, "ids": [], "n": [], "at": [0], "frames": []}

        def close() -> pa.RecordBatch:
            row = [[shard], [state["block"]], [state["start"]], [sha], [state["ids"]], [state["n"]], [state["at"]], [b"".join(state["frames"])]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)
            state.update(block=state["block"] + 1, start=state["start"] + sum(state["n"]), ids=[], n=[], at=[0], frames=[])
            return out

        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
            for a, b in slices(texts):
                for doc_id, ids in zip(doc_ids[a:b], encoder_for(path, keep_space).encode(texts[a:b]), strict=True):
                    frame = pack.compress(ids + tail)
                    state["ids"].append(doc_id)
                    state["n"].append(len(ids) // 4 + 1)
                    state["at"].append(state["at"][-1] + len(frame))
                    state["frames"].append(frame)
                    if state["at"][-1] >= BLOCK_BYTES or len(state["ids"]) >= BLOCK_DOCS:
                        yield close()
        if state["ids"]:
            yield close()

    return run


def write_tokens(docs: DataFrame, out: str, path: str, keep_space: bool, end_id: int) -> None:
    """Encode every text of docs (doc_id, text; null: empty) in ascending doc_id order and write token files under out.

    out/blocks holds rows of BLOCK_SCHEMA: a shard's blocks in order, each with its documents' ids, token counts, an
    offset index of len(doc_ids) + 1 entries into payload, and the dictionary's hash. out/dictionary holds the
    dictionary (empty: none). Shards ascend with doc_id; a null id comes first; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dictionary = train_dictionary(docs, path, keep_space, end_id)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    ordered = docs.repartitionByRange(partitions_for(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_blocks(path, keep_space, end_id, dictionary, sha), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{out}/blocks")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Documents of the token files under out: doc_id, start (ids of all documents before it), n_tokens, ids (binary)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
    # One row a shard: as many as there were partitions, never documents.
    shards = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, total = [], 0
    for r in shards.orderBy("shard").collect():
        before.append((r.shard, total))
        total += r.n
    at = spark.createDataFrame(before, "shard int, shard_start long")
    dictionary = spark.read.parquet(f"{out}/dictionary").first()
    held, sha = bytes(dictionary.dictionary), dictionary.dict_sha256
    return blocks.join(F.broadcast(at), "shard").mapInArrow(_documents(held, sha), "doc_id long, start long, n_tokens long, ids binary")


def _documents(dictionary: bytes, sha: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in range(batch.num_rows):
                one = {k: batch.column(k)[row] for k in ("doc_ids", "n_tokens", "offsets", "first_start", "shard_start", "dict_sha256")}
                if one["dict_sha256"].as_py() != sha:
                    raise ValueError("a block names another dictionary")
                n, at = np.array(one["n_tokens"].as_py(), np.int64), one["offsets"].as_py()
                starts = one["shard_start"].as_py() + one["first_start"].as_py() + np.cumsum(n) - n
                payload = memoryview(batch.column("payload")[row].as_buffer())
                doc_ids = one["doc_ids"].as_py()
                for a in range(0, len(doc_ids), 256):
                    b = min(a + 256, len(doc_ids))
                    ids = [unpack.decompress(payload[at[i] : at[i + 1]]) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(starts[a:b]), pa.array(n[a:b]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[int] | None:
    """Ids of one document: only its block is read and only its frame is decompressed. None if it is not there."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks").filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    i = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    frame = F.expr("substring(payload, cast(element_at(offsets, i) + 1 AS INT), cast(element_at(offsets, i + 1) - element_at(offsets, i) AS INT))")
    found = blocks.withColumn("i", i).select(frame.alias("frame")).first()
    if found is None:
        return None
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first().dictionary)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return np.frombuffer(unpack.decompress(bytes(found.frame)), "<u4").tolist()


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scratch_path(spark, "tokens")
    write_tokens(docs, out, public_tokenizers.path("byte_bpe_50k.json"), keep_space=True, end_id=2)
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
