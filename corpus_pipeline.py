"""A corpus from documents to packed sequences: quality, exact and near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; what it returns is written before the next stage
reads it. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from veritab.llm.common import drop_scratch, join_groups, scratch_since, stage

#: Scratch folders of the stage that ran last: its result is written by the time the next one begins.
_LAST: list[str] = []


def _stage(work):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, _LAST)
        mark = scratch_since(0)
        out = work(spark, docs, sf_dir)
        _LAST[:] = scratch_since(len(mark))
        return out

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as __doc, so that no column of docs meets one that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Null texts count as empty; repeated rows score alike."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = quality.score(_carried(docs), model, ["__doc"], "__score")
    return scored.filter(F.col("__score") >= quality.THRESHOLD).select("__doc.*")


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, repeated rows included; null and blank texts are one group."""
    return exact_dedup.exact_dedup(_carried(docs), keep=["__doc"]).filter("kept").select("__doc.*")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the smallest doc_id (a null id is last), then the first.

    Rows are numbered and told apart by number, so a repeated doc_id costs no other text. Texts without words stay.
    """
    rows = stage(_carried(docs).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = stage(ngram_join.near_duplicates(rows, id_col="__row").filter("n_links > 0").select("__row", "class_id"), "linked")
    ranked = found.join(rows.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "__row"))["__row"]
    kept = ranked.groupBy("class_id").agg(first.alias("kept"), F.count(F.lit(1)).alias("size"))
    lost = join_groups(found, kept, "class_id", "size", found.count()).filter("__row <> kept").select("__row")
    return rows.join(lost, "__row", "left_anti").select("__doc.*")


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that repeat across documents; n_chars follows. A null text becomes empty."""
    out = suffix_dedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most packing.CAPACITY tokens; other columns are not read."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("repeat_cut", cut_repeats),
    ("packing", pack),
]

#: Stages 1, 3 and 5 can't be said in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared scratch folder and read again."""
    from veritab.llm.common import scratch_path, shuffles_dropped

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        out = work(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{name}")
        with shuffles_dropped(spark):
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
