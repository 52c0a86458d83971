"""The catalog of documents: filters, facets, sorting, paging, reuse by content; and comparison of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritab.functions import scalars as S


def year_of(report_date: str = "report_date", created_at: str = "created_at") -> Column:
    return F.year(F.coalesce(F.col(report_date).cast("date"), F.col(created_at).cast("date")))


def catalog_filter(catalog: DataFrame, search: str | None = None, source_type: str | None = None, status: str | None = None, year: int | None = None, document_type: str | None = None, owner_email: str | None = None) -> DataFrame:
    """Rows that meet every filter given; texts are found anywhere, without regard to case."""
    if search:
        catalog = catalog.filter(F.lower("filename").contains(search.lower()))
    if source_type:
        catalog = catalog.filter(F.col("source_type") == source_type)
    if status:
        catalog = catalog.filter(F.col("status") == status)
    if year is not None:
        catalog = catalog.filter(year_of() == year)
    if document_type:
        catalog = catalog.filter(F.lower("document_type").contains(document_type.lower()))
    if owner_email:
        catalog = catalog.filter(F.lower("owner_email").contains(owner_email.lower()))
    return catalog


def owned(rows: DataFrame, catalog: DataFrame, user_id) -> DataFrame:
    """Rows of completed documents of one user; nobody else's rows ever pass."""
    mine = catalog.filter((F.col("user_id") == user_id) & (F.col("status") == "completed")).select("doc_id")
    return rows.join(mine, "doc_id", "left_semi")


def catalog_sort(catalog: DataFrame, key: str | None = "-created_at", tie: str = "doc_id") -> list[Column]:
    """Sort columns for a key; a leading minus is descending, null values sort lowest, unknown keys mean created_at."""
    name, down = (key or "-created_at").lstrip("-"), (key or "-created_at").startswith("-")
    columns = {"created_at": F.col("created_at"), "report_date": F.coalesce(F.col("report_date").cast("timestamp"), F.col("created_at").cast("timestamp")), "filename": F.lower("filename"), "value": F.col("headline_value")}
    c = columns.get(name, columns["created_at"])
    return [c.desc_nulls_last() if down else c.asc_nulls_first(), F.col(tie)]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> tuple[DataFrame, int, int]:
    """(rows of the page, count, pages): size 1 to 100, number clamped to what there is."""
    size = max(1, min(size, 100))
    count = rows.count()
    pages = max(1, -(-count // size))
    number = max(1, min(number, pages))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), count, pages


def facets(catalog: DataFrame) -> DataFrame:
    """(years, source_types, document_types): distinct values to filter by, years newest first."""
    return catalog.agg(
        F.sort_array(F.collect_set(year_of()), asc=False).alias("years"),
        F.array_sort(F.collect_set("source_type")).alias("source_types"),
        F.array_sort(F.collect_set(F.nullif("document_type", F.lit("")))).alias("document_types"),
    )


def row_search(table: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the text in any column, without regard to case."""
    columns = columns or [c for c in table.columns if not c.startswith("_")]
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return table.filter(hit)


def search_tables(tables: dict[str, tuple[DataFrame, list[str]]], text: str, key: str) -> DataFrame:
    """(table, key, found): rows of any of the tables in one of whose columns the text stands, in any case; found is the first such value.

    tables gives each table's searched columns by name. An empty text finds all rows that have a value.
    """
    out = []
    for name, (t, columns) in tables.items():
        hits = F.filter(F.array(*[F.col(c).cast("string") for c in columns]), lambda v: F.lower(v).contains(text.lower()))
        out.append(t.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.get(hits, F.lit(0)).alias("found")).filter("found IS NOT NULL"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def mixed_sort(table: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted as numbers where cells are numbers, then as text."""
    n, t = S.parse_number(F.col(column)), F.col(column).cast("string")
    return table.orderBy(n.desc_nulls_last() if descending else n.asc_nulls_last(), t.desc() if descending else t.asc())


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def latest_by_hash(catalog: DataFrame) -> DataFrame:
    """The newest completed document of each owner and content, for reuse on the same upload."""
    w = W.partitionBy("user_id", "file_hash").orderBy(F.col("created_at").desc(), F.col("doc_id").desc())
    return catalog.filter("status = 'completed'").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def uploads_to_process(uploads: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new uploads, reused): uploads (upload_id, user_id, content) whose content the owner has completed before are reused."""
    hashed = uploads.withColumn("file_hash", content_hash(F.col("content"))).drop("content")
    known = latest_by_hash(catalog).select("user_id", "file_hash", "doc_id")
    return hashed.join(known, ["user_id", "file_hash"], "left_anti"), hashed.join(known, ["user_id", "file_hash"])


def bulk_delete(catalog: DataFrame, children: dict[str, DataFrame], ids: DataFrame, user_id=None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(deleted ids, kept catalog, kept children). With a user_id only that owner's documents go."""
    gone = catalog.join(ids, "doc_id", "left_semi")
    if user_id is not None:
        gone = gone.filter(F.col("user_id") == user_id)
    gone = gone.select("doc_id")
    return gone, catalog.join(gone, "doc_id", "left_anti"), {k: v.join(gone, "doc_id", "left_anti") for k, v in children.items()}


def to_index(catalog: DataFrame, everything: bool = False) -> DataFrame:
    """Completed documents whose chunks are not indexed yet, or all completed ones."""
    done = catalog.filter("status = 'completed'")
    return done if everything else done.filter("coalesce(index_status, 'pending') <> 'indexed'")


def vision_summary(tables: DataFrame, charts: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, tables, charts, chart_like, images): figures by class."""
    kind = S.classify_figure(F.col("caption"), F.col("width"), F.col("height"))
    f = figures.groupBy("doc_id").agg(F.count_if(kind == "chart-like").alias("chart_like"), F.count_if(kind == "image").alias("images"))
    a = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables"))
    b = charts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("charts"))
    return a.join(b, "doc_id", "full").join(f, "doc_id", "full").fillna(0)


# --- comparison


def compare_metrics(before: DataFrame, after: DataFrame, key: str = "label") -> DataFrame:
    """(key, before, after, delta, percent): numeric metrics of two versions; no percent where before is 0 or absent."""
    a, b = before.select(key, F.col("value").alias("before")), after.select(key, F.col("value").alias("after"))
    both = a.join(b, key, "full")
    delta = F.col("after") - F.col("before")
    return both.withColumn("delta", delta).withColumn("percent", F.try_divide(delta, F.abs("before")) * 100)


def row_digest(table: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])), 256)


def version_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(rows_added, rows_removed, unchanged): distinct rows in one version only. One shuffle of digests with side flags."""
    sides = before.select(row_digest(before, columns).alias("d"), F.lit(1).alias("s")).unionByName(after.select(row_digest(after, columns).alias("d"), F.lit(2).alias("s")))
    each = sides.groupBy("d").agg(F.bit_or("s").alias("s"))
    out = each.agg(F.count_if(F.col("s") == 2).alias("rows_added"), F.count_if(F.col("s") == 1).alias("rows_removed"))
    return out.withColumn("unchanged", (F.col("rows_added") == 0) & (F.col("rows_removed") == 0))


def compare_datasets(before: DataFrame, after: DataFrame, with_row: bool = False) -> DataFrame:
    """(dataset, status, rows_added, rows_removed) of two versions' cells: added, removed, changed or unchanged.

    with_row also counts a row as changed that only moved.
    """
    parts = ["position", "value"] + (["source_row"] if with_row else [])

    def rows(cells: DataFrame, side: int) -> DataFrame:
        return cells.groupBy("dataset", "source_row").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*parts)))), 256).alias("d")).select("dataset", "d", F.lit(side).alias("s"))

    each = rows(before, 1).unionByName(rows(after, 2)).groupBy("dataset", "d").agg(F.bit_or("s").alias("s"))
    out = each.groupBy("dataset").agg(F.bit_or("s").alias("sides"), F.count_if(F.col("s") == 2).alias("rows_added"), F.count_if(F.col("s") == 1).alias("rows_removed"))
    status = F.when(F.col("sides") == 2, "added").when(F.col("sides") == 1, "removed").when((F.col("rows_added") > 0) | (F.col("rows_removed") > 0), "changed").otherwise("unchanged")
    return out.select("dataset", status.alias("status"), "rows_added", "rows_removed")


# --- rankings


def top_by(table: DataFrame, keys: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first rows of each key in an order, numbered."""
    w = W.partitionBy(*keys).orderBy(*order)
    return table.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= most)
