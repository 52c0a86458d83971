"""The chunk index: versions that become visible at once, and indexing that records each document's failure."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.retrieve import windows
from veritab.plans.staging import stage

CHUNK_SCHEMA = "chunk_no int, content string"


class ChunkIndex:
    """Chunks of documents under a folder, replaced a set of documents at a time.

    A write puts its chunks and the list of its documents into a folder of its own and then makes an empty commit file,
    which a file system does at once or not at all. Readers list the commits and take each document from the last one
    that names it: they see the old or the new chunks of all documents of a write, never a mix. A write that fails leaves
    no commit. compact() joins the visible versions into one; older folders may then be deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, str, bool]]:
        """(version, folder, whether it replaces all before it) of the visible writes, from the last whole one on."""
        folder = self._path(f"{self.path}/commits")
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        found = [(int(n[:12]), n.split(".")[0], n.endswith(".base")) for n in names]
        last = max((i for i, c in enumerate(found) if c[2]), default=0)
        return found[last:]

    def _write(self, chunks: DataFrame, documents: DataFrame, kind: str) -> None:
        version = max((v for v, _, _ in self.commits()), default=0) + 1
        name = f"{version:012d}-{uuid.uuid4().hex}"
        chunks.write.parquet(f"{self.path}/versions/{name}/chunks")
        documents.select("doc_id").distinct().write.parquet(f"{self.path}/versions/{name}/documents")
        self._fs.create(self._path(f"{self.path}/commits/{name}.{kind}"), False).close()

    def replace(self, chunks: DataFrame, documents: DataFrame | None = None) -> None:
        """Make chunks (doc_id, ...) the chunks of documents (doc_id; those of chunks if None); one without chunks goes."""
        self._write(chunks, chunks if documents is None else documents, "part")

    def delete(self, documents: DataFrame) -> None:
        commits = self.commits()
        if commits:
            self._write(self._read(commits).limit(0), documents, "part")

    def _read(self, commits: list[tuple[int, str, bool]]) -> DataFrame:
        frames = []
        for i, (_, name, _) in enumerate(commits):
            own = self.spark.read.parquet(f"{self.path}/versions/{name}/chunks")
            later = [self.spark.read.parquet(f"{self.path}/versions/{n}/documents") for _, n, _ in commits[i + 1 :]]
            for documents in later:
                own = own.join(documents, "doc_id", "left_anti")
            frames.append(own)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """The visible chunks; None before the first write."""
        commits = self.commits()
        return self._read(commits) if commits else None

    def compact(self) -> None:
        """Write what is visible as one version that replaces all before it."""
        found = self.read()
        if found is not None:
            self._write(found, found, "base")


def chunk_documents(docs: DataFrame, split: Callable[[str], list[str]] = windows) -> DataFrame:
    """(doc_id, chunks, status, error) of docs (doc_id, text): 'indexed', 'empty' or 'failed' with what went wrong.

    A document that split can't take stops no other one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in batch.column("text").to_pylist():
                chunks, error = [], None
                try:
                    chunks = split(text or "")
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[:500]
                for column, x in zip(out, (chunks, "failed" if error else "indexed" if chunks else "empty", error), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.list_(pa.string())), pa.array(out[1]), pa.array(out[2], pa.string())], ["doc_id", "chunks", "status", "error"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunks array<string>, status string, error string")


def index_documents(docs: DataFrame, index: ChunkIndex, status_path: str, split: Callable[[str], list[str]] = windows) -> DataFrame:
    """Index docs (doc_id, text) and return this run's (doc_id, status, error, n_chunks, text_hash), also added to status_path.

    Only documents whose last status isn't 'indexed' or 'empty' for the same text are taken, so a run again takes what
    failed, what changed and what a lost run left. Chunks become visible together; statuses are written after them, so
    a run that dies between the two is repeated, not lost.
    """
    spark = docs.sparkSession
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    fs, path = index._fs, index._path(status_path)
    if fs.exists(path):
        last = spark.read.parquet(status_path).groupBy("doc_id").agg(F.max_by(F.struct("status", "text_hash"), "run").alias("last"))
        done = last.filter("last.status <> 'failed'").select("doc_id", F.col("last.text_hash").alias("text_hash"))
        hashed = hashed.join(done, ["doc_id", "text_hash"], "left_anti")
    made = stage(chunk_documents(hashed, split).join(hashed.select("doc_id", "text_hash"), "doc_id"), "indexed")
    chunks = made.filter("status = 'indexed'").select("doc_id", F.posexplode("chunks").alias("chunk_no", "content")).withColumn("chunk_no", F.col("chunk_no") + 1)
    index.replace(chunks, made.filter("status <> 'failed'"))
    run = (max((r[0] for r in spark.read.parquet(status_path).agg(F.max("run")).collect()), default=0) + 1) if fs.exists(path) else 1
    status = made.select("doc_id", "status", "error", F.size("chunks").alias("n_chunks"), "text_hash", F.lit(run).alias("run"))
    status.write.mode("append").parquet(status_path)
    return status.drop("run")
