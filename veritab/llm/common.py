"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch folders of this Python process, newest last.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared spark.checkpoint.dir; a local one only in local mode with none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/veritab-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: lineage ends there, its shuffles are dropped."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_since(n: int) -> list[str]:
    """The scratch folders of this process from the n-th on."""
    return _SCRATCH[n:]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders; only when no DataFrame over them will be read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most_hot: int = 1000) -> DataFrame:
    """Inner-join rows to one row per group without gathering a hot group in one task.

    Groups of over max(100, total / most_hot) rows number at most most_hot, so that many rows are broadcast;
    the other groups are joined by a shuffle in which no key has more rows than that.
    """
    limit = max(100, total // most_hot)
    hot = groups.filter(F.col(size) > limit)
    cool = groups.filter(F.col(size) <= limit)
    hot_rows = rows.join(F.broadcast(hot), key)
    cool_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cool, key)
    return hot_rows.unionByName(cool_rows)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow string column; null counts as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def slices(texts: list[str], chars: int = 1_000_000):
    """Consecutive (from, to) ranges of about so many characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def min_labels(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, label), label the smallest node.

    Each round takes the smallest label among neighbours and then jumps to that label's own label,
    so the number of rounds is about the logarithm of a path's length. Labels are staged each round.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = stage(lower.join(jump, "low", "left").select("node", "before", F.least("low", F.coalesce("up", "low")).alias("label")), f"{name}-labels")
        labels = new.select("node", "label")
        if new.filter("label <> before").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b) if b else 0


class Kept:
    """Results by string in two generations: a full young one replaces the old one, and strings still in use move up again."""

    def __init__(self, most: int):
        self.half = max(1, most // 2)
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}

    def again(self, key: str):
        """What is kept of a string that the young generation lacks; None if nothing."""
        found = self.old.get(key)
        if found is not None:
            self.young[key] = found
        return found

    def drop(self, key: str) -> None:
        self.young.pop(key, None)
