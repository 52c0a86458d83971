"""Places and neighbours in order, for keys of any size: range partitions whose counts and edge rows are carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.plans.staging import stage


def ordered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows dealt by range over keys and order, written sorted, with __id: the partition above 33 bits, the place in it below."""
    return stage(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id()), name)


def _parts(placed: DataFrame, keys: list[str], *aggs) -> DataFrame:
    """One row a key and partition that holds it."""
    return placed.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.shiftright("__id", 33).alias("__part")).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"), *aggs)


def _with_parts(placed: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    on = F.shiftright("__id", 33) == F.col("__part")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(parts, on).drop("__part", *[f"__k{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with a number from 0 in each group of keys by order, though no task holds a group.

    A row's number is its place in its partition and the group's rows in the partitions before it, of which there is one
    count a group and partition. Rows that order leaves equal are numbered in any order.
    """
    placed = ordered(rows, keys, order, name)
    parts = _parts(placed, keys)
    earlier = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return _with_parts(placed, parts, keys).withColumn(name, F.col("__id") - F.col("__first") + F.col("__before")).drop("__id", "__first", "__before")


def with_previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "previous") -> DataFrame:
    """rows with `name`, a struct of the columns of the row before in its group, null for the first; and place, from 0.

    Inside a partition the row before is found by the place in it: each row sends its columns one place on. A group's
    first row in a partition takes the last one of the partition before that has the group. So no window spans a group.
    """
    placed = ordered(rows, keys, order, name)
    own = F.struct(*[F.col(c) for c in columns])
    parts = _parts(placed, keys, F.max_by(own, "__id").alias("__last"))
    by = W.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__part")
    parts = parts.withColumn("__carried", F.lag("__last").over(by)).withColumn("__before", F.coalesce(F.sum("__n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__last", "__n")
    # Rows of a partition are dealt again in runs of places; a run's first row finds the one before in the run's edge.
    run = 1 << 16
    sent = placed.select((F.col("__id") + 1).alias("__id"), own.alias("__sent")).filter(F.pmod("__id", F.lit(run)) == 0)
    runs = placed.withColumn("__run", F.shiftright("__id", 16))
    inside = runs.withColumn("__sent", F.lag(own).over(W.partitionBy("__run").orderBy("__id"))).drop("__run")
    inside = inside.join(sent.withColumnRenamed("__sent", "__edge"), "__id", "left").withColumn("__sent", F.coalesce("__sent", "__edge")).drop("__edge")
    met = _with_parts(inside, parts, keys)
    previous = F.when(F.col("__id") == F.col("__first"), F.col("__carried")).otherwise(F.col("__sent"))
    return met.withColumn(name, previous).withColumn("place", F.col("__id") - F.col("__first") + F.col("__before")).drop("__id", "__first", "__before", "__carried", "__sent")
