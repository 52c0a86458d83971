"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import join_groups, stage

#: Deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]"
#: Slots of the filter a row: one row in 16 without a copy shares a slot with another text.
SLOTS_A_ROW = 16
#: Slots in a row of the filter table, 64 in each of its longs.
BUCKET_SLOTS = 32768
#: A filter of up to so many bytes is broadcast, else joined by a shuffle.
MOST_BROADCAST = 256 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def repeated_slots(slots: DataFrame) -> DataFrame:
    """First pass. Rows (__slot) to a table (__bucket, __words): the slots that two rows or more fell into, as bits.

    Only slot numbers are shuffled, counted on the map side first.
    """
    word, bit = F.shiftright("__slot", 6), F.expr("shiftleft(1L, cast(__slot & 63 AS INT))")
    words = slots.groupBy("__slot").count().filter("count > 1").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    a_bucket = BUCKET_SLOTS // 64
    held = words.groupBy(F.floor(F.col("word") / a_bucket).alias("__bucket")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(a_bucket)).cast("int").alias("k"), "bits"))).alias("held"))
    return held.select("__bucket", F.transform(F.sequence(F.lit(0), F.lit(a_bucket - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias("__words"))


def possibly_repeated(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Second pass: rows (__slot, ...) with a boolean __maybe, true where the slot was hit twice."""
    rows = rows.withColumn("__bucket", F.floor(F.col("__slot") / BUCKET_SLOTS))
    joined = rows.join(F.broadcast(table) if small else table, "__bucket", "left")
    word = F.element_at("__words", (F.shiftright(F.pmod("__slot", F.lit(BUCKET_SLOTS)), 6) + 1).cast("int"))
    hit = F.coalesce(word, F.lit(0).cast("long")).bitwiseAND(F.expr("shiftleft(1L, cast(__slot & 63 AS INT))")) != 0
    return joined.withColumn("__maybe", hit).drop("__bucket", "__words")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Mark the exact copies in docs; every row comes back with the columns of keep (all, if None).

    Texts are equal when identical after deleting the characters of BLANKS; null counts as empty, so null and
    blank texts are copies of each other. The row with the most code points, then the smallest id (a null id is
    last), stays; of rows alike in both, one stays. Ids may be of any type that has an order. Added columns (replacing
    any of the same name): keep_id, group_size, kept, text_sha256. An empty table gives an empty result; other columns
    pass through.

    Texts are read and normalised once; rows with their digests are written. First pass: slots of a Bloom filter that
    are hit twice. Only rows whose slot was hit twice can have a copy: they are grouped by a shuffle, and all other rows
    pass straight through. A filter beyond most_broadcast bytes is joined by a shuffle of the rows.
    """
    spark: SparkSession = docs.sparkSession
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    columns = [F.col(f"`{c}`") for c in own]
    norm, text = normalised(F.col(f"`{text_col}`")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(*columns, F.col(f"`{id_col}`").alias("__id"), F.sha2(norm, 256).alias("text_sha256"), F.char_length(text).alias("__n"), F.monotonically_increasing_id().alias("__row"))
    rows = stage(keyed, "keyed")
    total = rows.count()
    buckets = max(1, -(-SLOTS_A_ROW * total // BUCKET_SLOTS))
    rows = rows.withColumn("__slot", F.pmod(F.xxhash64("text_sha256"), F.lit(buckets * BUCKET_SLOTS)))
    table = stage(repeated_slots(rows.select("__slot")), "bloom")
    rows = possibly_repeated(rows, table, buckets * BUCKET_SLOTS // 8 <= most_broadcast)
    single = rows.filter("NOT __maybe").select(*columns, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.filter("__maybe")
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    groups = stage(maybe.groupBy("text_sha256").agg(best.alias("__best"), F.count(F.lit(1)).alias("group_size")), "groups")
    joined = join_groups(maybe, groups, "text_sha256", "group_size", total)
    copies = joined.select(*columns, F.col("__best.id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__best.row")).alias("kept"), "text_sha256")
    return single.unionByName(copies)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep=["doc_id"])


OP4_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
s AS (SELECT doc_id, length(t) AS n, sha256(norm) AS text_sha256 FROM n),
r AS (SELECT doc_id, text_sha256,
  first_value(doc_id) OVER w AS keep_id,
  row_number() OVER w AS rn,
  count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM s WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
