"""Delimited files of any size read by many tasks: each file's encoding and delimiter, records over line ends in quotes."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.operators.search import slices
from veritab.plans.staging import stage

# Delimiters by preference, and what is looked at to choose one.
DELIMITERS = (",", ";", "\t", "|")
SNIFFED, SNIFFED_RECORDS = 4096, 50


def _best_delimiter(head: Column) -> Column:
    """The delimiter that cuts the records of head most evenly: those with as many as the first, times the fewest; a comma if none does."""

    def score(i: int, d: str) -> Column:
        counts = F.transform(F.filter(head, lambda x: F.trim(x) != ""), lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(d), F.lit(""))))
        even = F.size(F.filter(counts, lambda n: n == F.get(counts, F.lit(0)))) * F.array_min(counts)
        return F.struct(F.coalesce(even, F.lit(0)).alias("s"), F.lit(-i).alias("order"), F.lit(d).alias("d"))

    best = F.array_max(F.array(*[score(i, d) for i, d in enumerate(DELIMITERS)]))
    return F.when(best["s"] > 0, best["d"]).otherwise(",")


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of whole records, each by its file's delimiter."""
    csv.field_size_limit(1 << 31)
    for batch in slices(batches):
        records, seps = batch.column("record").to_pylist(), batch.column("sep").to_pylist()
        # A bare carriage return would end a record here; what follows it stays in the record.
        cells = [[c for row in csv.reader(io.StringIO(r, newline=""), delimiter=s) for c in row] for r, s in zip(records, seps, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_no"), pa.array(cells, pa.list_(pa.string()))], ["doc_id", "row_no", "cells"])


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, table_id, row_no, cells) of delimited files, header records included; doc_id is the file, row_no its records from 0.

    A file is read as lines by as many tasks as it has splits. A record goes on where the quotes before a line are odd in
    number: each split counts its quotes, the counts before a split give the parity it starts with, and the same sums
    number the records, so that one over a split's end is put together from both sides. Encoding and delimiter are
    found for each file: UTF-8 unless a line breaks its rules, then ISO-8859-1; see _best_delimiter(). Records without
    any text have one empty cell or none. Empty files have no row.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = stage(text.withColumn("quotes", F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))).withColumn("fine", F.is_valid_utf8("line")), "lines")
    blocks = lines.groupBy("doc_id", "block").agg(F.sum("quotes").alias("quotes"), F.bool_and("fine").alias("fine"))
    before = W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = stage(blocks.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).withColumn("utf8", F.min("fine").over(W.partitionBy("doc_id"))).drop("quotes", "fine"), "blocks")
    # A split's lines are one task's: at most spark.sql.files.maxPartitionBytes of text.
    so_far = W.partitionBy("doc_id", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    own = lines.join(blocks, ["doc_id", "block"])
    parity = (F.col("odd") + F.coalesce(F.sum("quotes").over(so_far), F.lit(0))) % 2
    started = own.withColumn("starts", (parity == 0).cast("int"))
    started = stage(started.withColumn("number", F.sum("starts").over(W.partitionBy("doc_id", "block").orderBy("at"))), "started")
    counts = started.groupBy("doc_id", "block").agg(F.sum("starts").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = started.join(counts, ["doc_id", "block"]).withColumn("row_no", F.col("number") + F.col("earlier") - 1)
    decoded = F.when(F.col("utf8"), F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))
    records = numbered.groupBy("doc_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", decoded.alias("t")))), lambda x: x["t"]), "\n").alias("record"))
    clean = F.regexp_replace(F.regexp_replace("record", "^﻿", ""), "\r$", "")
    records = stage(records.withColumn("record", clean), "records")
    # What stands in quotes says nothing of the delimiter.
    bare = F.regexp_replace(F.substring("record", 1, SNIFFED), '"[^"]*("|$)', "q")
    first = records.filter(F.col("row_no") < SNIFFED_RECORDS).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", bare.alias("t")))), lambda x: x["t"]).alias("head"))
    seps = first.select("doc_id", _best_delimiter(F.col("head")).alias("sep"))
    cells = records.join(seps, "doc_id").select("doc_id", "row_no", "record", "sep").mapInArrow(_fields, "doc_id string, row_no long, cells array<string>")
    return cells.select("doc_id", F.lit("0").alias("table_id"), "row_no", "cells")
