"""Readers: delimited text, JSON documents and lines, plain text, and files by kind and signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.operators.shape import is_blank_row, text_lines
from veritab.plans.staging import stage
from veritab.sources.delimited import read_grids

# The fields that may hold a document's records.
ENVELOPES = ("data", "results", "records", "items", "payload")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files with one header as text columns; rows with nothing in them are left out. No file with a header is an error.

    Files are read by read_grids(), each with its own encoding and delimiter. Files with other headers are tables of their
    own: use read_grids() with grids_to_cells().
    """
    grid = stage(read_grids(spark, path), "grid")
    headers = grid.filter("row_no = 0").select("cells").distinct().limit(2).collect()
    if not headers:
        raise ValueError(f"no table in {path}")
    if len(headers) > 1:
        raise ValueError(f"files of several headers in {path}")
    rows = grid.filter("row_no > 0").filter(~is_blank_row(F.col("cells")))
    # A repeated or blank name gets its place, so that no column hides another.
    seen: set[str] = set()
    names = [n if n and not (n in seen or seen.add(n)) else f"{n or 'Column'} {i + 1}" for i, n in enumerate(headers[0].cells)]
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_json_lines(texts: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of texts (doc_id, text) with a JSON record a line. Records keep _jsonl_line; bad lines are errors with theirs."""
    lines = text_lines(texts).filter(F.trim("line") != "").withColumn("_jsonl_line", F.col("line_no") + 1)
    parsed = lines.withColumn("ok", F.try_parse_json("line").isNotNull()).withColumn("r", F.from_json("line", schema))
    return parsed.filter("ok").select("doc_id", "r.*", "_jsonl_line"), parsed.filter("NOT ok").select("doc_id", "_jsonl_line", "line")


def select_records(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, table, records, warning, pos) of JSON documents: which array holds the records; pos is its place in the object.

    A bare list is the table; else the first list with rows among ENVELOPES in that order; else the only list with
    rows; else each list is a table of its own, with a warning; else the object is one record. records is JSON text of
    an array; text that is no JSON gives a warning and no records.
    """
    none = F.lit(None).cast("string")
    kind = F.upper(F.substring(F.schema_of_variant(F.try_parse_json(F.col(text_col))), 1, 5))
    d = docs.select("doc_id", F.col(text_col).alias("text"), kind.alias("kind"))
    order = lambda k: F.array_position(F.array(*[F.lit(e) for e in ENVELOPES]), F.lower(k))
    # What each field of an object holds is looked at where the document lies; no field is a row before one is chosen.
    field = lambda k, i: F.struct(i.alias("pos"), k.alias("table"), F.call_function("get_json_object", F.col("text"), F.concat(F.lit("$['"), k, F.lit("']"))).alias("records"), F.when(order(k) > 0, order(k)).otherwise(99).alias("order"))
    fields = F.transform(F.json_object_keys("text"), field)
    d = d.withColumn("lists", F.when(F.col("kind") == "OBJEC", F.filter(fields, lambda x: x["records"].startswith("[") & (F.coalesce(F.json_array_length(x["records"]), F.lit(0)) > 0))))
    first = F.array_min(F.transform("lists", lambda x: F.struct(x["order"].cast("int").alias("order"), x["pos"].alias("pos"))))
    d = d.withColumn("first", first)
    several = F.lit("several lists of records; each is a table")
    row = lambda table, records, warning, pos: F.struct(table.alias("table"), records.alias("records"), warning.alias("warning"), pos.cast("int").alias("pos"))
    known = F.col("first.order") < 99
    picked = F.filter("lists", lambda x: ~known | (x["pos"] == F.col("first.pos")))
    chosen = (
        F.when(F.col("kind") == "ARRAY", F.array(row(F.lit("records"), F.col("text"), none, F.lit(0))))
        .when((F.col("kind") == "OBJEC") & (F.size("lists") > 0), F.transform(picked, lambda x: row(x["table"], x["records"], F.when(~known & (F.size("lists") > 1), several), x["pos"])))
        .when(F.col("kind") == "OBJEC", F.array(row(F.lit("records"), F.concat(F.lit("["), F.col("text"), F.lit("]")), none, F.lit(0))))
        .when(F.col("kind").isNull(), F.array(row(none, none, F.lit("not JSON"), F.lit(0))))
    )
    return d.select("doc_id", F.explode(chosen).alias("r")).select("doc_id", "r.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of plain text files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files with source_type and file_hash: unknown extensions and wrong first bytes are rejected.

    Contents are hashed in the scan and dropped at once.
    """
    files = spark.read.format("binaryFile").load(path)
    name = S.sanitize_filename(F.col("path"))
    kind = S.source_type(name)
    rows = files.select("path", name.alias("filename"), kind.alias("source_type"), S.signature_matches(kind, F.col("content")).alias("ok"), F.sha2("content", 256).alias("file_hash"), "length")
    good = F.col("source_type").isNotNull() & F.col("ok")
    return rows.filter(good).drop("ok"), rows.filter(~F.coalesce(good, F.lit(False))).withColumn("reason", F.when(F.col("source_type").isNull(), "unknown extension").otherwise("content does not match the extension")).drop("ok")
