"""Cells, column profiles and the meaning of columns; duplicate rows and keys.

Two shapes carry tables. A wide table is a DataFrame. Cells are (doc_id, dataset, column, position, source_row, value):
one row a cell, for one table or a whole corpus of tables, and every analysis works on them by (doc_id, dataset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritab.functions import scalars as S
from veritab.plans.staging import stage

KEY = ["doc_id", "dataset"]
CELLS = "doc_id string, dataset string, column string, position int, source_row long, value string"
MEASURES = ("currency", "number", "quantity")
NUMERIC = ("currency", "number", "quantity", "percentage")


def to_cells(table: DataFrame, dataset: str, row_col: str, columns: list[str] | None = None, doc_id: str | None = None) -> DataFrame:
    """Cells of a wide table; row_col numbers its rows, columns are the data columns in order (names starting _ never are)."""
    columns = columns or [c for c in table.columns if c != row_col and not c.startswith("_")]
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])
    rows = table.select(F.lit(doc_id or dataset).alias("doc_id"), F.lit(dataset).alias("dataset"), F.col(f"`{row_col}`").cast("long").alias("source_row"), F.explode(parts).alias("c"))
    return rows.select("doc_id", "dataset", "c.column", "c.position", "source_row", "c.value")


def flexible_dates(values: DataFrame) -> DataFrame:
    """(value, day) for the distinct strings of values (value) that are dates in any common spelling.

    Built-in patterns take nearly all. What they leave and still looks like a date goes, once a distinct string, to a
    free-form parser.
    """
    seen = values.select("value").distinct().filter(F.col("value").isNotNull())
    tried = seen.withColumn("day", S.parse_date_builtin(F.col("value")))
    rest = tried.filter(F.col("day").isNull() & S.could_be_date(F.col("value")) & F.col("value").rlike(r"\d"))

    @F.pandas_udf("date")
    def free(texts):
        from datetime import datetime

        import pandas as pd
        from dateutil import parser

        def one(t):
            try:
                day = parser.parse(t, fuzzy=False, default=datetime(2000, 1, 1))
            except (ValueError, OverflowError, TypeError):
                return None
            return day.date() if 1900 <= day.year <= 2100 else None

        return pd.Series([one(t) for t in texts], dtype=object)

    return tried.filter("day IS NOT NULL").unionByName(rest.select("value", free("value").alias("day")).filter("day IS NOT NULL"))


def value_counts(cells: DataFrame) -> DataFrame:
    """Distinct cleaned values of each column with their counts: the one shuffle of every cell; all else is on this."""
    return (
        cells.withColumn("value", S.clean_text(F.col("value")))
        .groupBy(*KEY, "column", "position", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("source_row").alias("first_row"))
    )


def profile(cells: DataFrame, free_dates: bool = False) -> DataFrame:
    """One row a column: counts, hits by kind, distinct values, numeric statistics, samples, meaning and confidence.

    Exact distinct counts come from grouping values first, so many columns never multiply the rows. free_dates also
    tries the free-form date parser on distinct strings.
    """
    counts = value_counts(cells)
    number, value, n = S.parse_number(F.col("value")), F.col("value"), F.col("n")
    if free_dates:
        counts = counts.join(flexible_dates(counts.filter(S.could_be_date(value)).select("value")), "value", "left")
    else:
        counts = counts.withColumn("day", F.when(S.could_be_date(value), S.parse_date_builtin(value)))
    # Parsed once a distinct value and written: the counts are read twice, for the profile and for the spread.
    counts = stage(counts.withColumn("number", number).withColumn("low", F.lower(value)), "values")
    has = value.isNotNull()

    def hits(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(has & c, n)), F.lit(0))

    number = F.col("number")
    # Population moments from (value, count) pairs.
    per = counts.groupBy(*KEY, "column", "position").agg(
        F.sum(n).alias("total_count"),
        hits(F.lit(True)).alias("non_null_count"),
        hits(S.looks_percent(value)).alias("percent_hits"),
        hits(S.looks_currency(value)).alias("currency_hits"),
        hits(number.isNotNull()).alias("numeric_hits"),
        hits(F.col("day").isNotNull()).alias("date_hits"),
        hits(S.looks_boolean(value)).alias("boolean_hits"),
        hits(S.is_ambiguous_date(value)).alias("ambiguous_hits"),
        F.count_distinct("low").alias("distinct_values"),
        F.sum(F.char_length(value) * n).alias("chars"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.sum(number * n).alias("sum"),
        F.try_divide(F.sum(number * n), F.sum(F.when(number.isNotNull(), n))).alias("mean"),
        F.count_distinct("number").alias("distinct_numbers"),
        hits(number < 0).alias("negatives"),
    )
    # Ranks are cut in every partition before the shuffle.
    rank = F.row_number().over(W.partitionBy(*KEY, "column").orderBy("first_row", "value"))
    first = counts.filter(has).select(*KEY, "column", "first_row", "value").withColumn("rank", rank).filter(F.col("rank") <= 5)
    samples = first.groupBy(*KEY, "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values"))
    per = per.join(samples, [*KEY, "column"], "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    mean = per.select(*KEY, "column", F.col("mean").alias("m"))
    spread = (
        counts.filter("number IS NOT NULL")
        .join(mean, [*KEY, "column"])
        .groupBy(*KEY, "column")
        .agg(F.sqrt(F.sum((F.col("number") - F.col("m")) * (F.col("number") - F.col("m")) * n) / F.sum(n)).alias("std"))
    )
    return decide_types(per.join(spread, [*KEY, "column"], "left"))


def decide_types(per: DataFrame) -> DataFrame:
    """The meaning of each profiled column, by name and values together; the statistics kept follow from it."""
    name, n = F.col("column"), F.col("non_null_count")

    def ratio(c: str) -> Column:
        return F.try_divide(F.col(c).cast("double"), n.cast("double"))

    numeric, unique = ratio("numeric_hits"), ratio("distinct_values")
    is_date = (ratio("date_hits") >= 0.8) & ((numeric < 0.8) | S.name_has(name, S.DATE_HINTS))
    is_boolean = (F.col("boolean_hits") == n) & (F.col("distinct_values") <= 2)
    named_id = S.name_has(name, S.IDENTIFIER_HINTS) & (unique > 0.9)
    is_number = numeric >= 0.8
    is_percent = (ratio("percent_hits") >= 0.5) | S.name_has(name, S.PERCENT_HINTS)
    is_currency = (ratio("currency_hits") >= 0.3) | S.name_has(name, S.CURRENCY_HINTS)
    is_category = (F.col("distinct_values") <= F.greatest(F.lit(20.0), n * 0.5)) & (ratio("chars") <= 40)

    def kind(semantic: str, data: str, confidence: str) -> Column:
        return F.struct(F.lit(semantic).alias("semantic_type"), F.lit(data).alias("data_type"), F.lit(confidence).alias("confidence"))

    decided = (
        F.when(n == 0, kind("text", "string", "low"))
        .when(is_date, kind("date", "date", "high"))
        .when(is_boolean, kind("boolean", "boolean", "high"))
        .when(is_number & is_percent, kind("percentage", "number", "high"))
        .when(is_number & is_currency, kind("currency", "number", "medium"))
        .when(is_number & S.name_has(name, S.QUANTITY_HINTS), kind("quantity", "number", "medium"))
        .when(is_number & named_id, kind("identifier", "number", "medium"))
        .when(is_number, kind("number", "number", "high"))
        .when(named_id, kind("identifier", "string", "medium"))
        .when((unique > 0.95) & (n > 5), kind("identifier", "string", "low"))
        .when(is_category, kind("category", "string", "medium"))
        .otherwise(kind("text", "string", "medium"))
    )
    t = F.col("d.semantic_type")
    full, text, date = t.isin(*NUMERIC), t.isin("identifier", "category"), t == "date"
    total = F.col("total_count")
    return (
        per.withColumn("d", decided)
        .select(
            *KEY, "column", "position", "d.semantic_type", "d.data_type", "d.confidence", (total > n).alias("nullable"), "non_null_count", "total_count", "sample_values",
            F.when(full, F.col("min")).alias("min"), F.when(full, F.col("max")).alias("max"), F.when(full, F.col("mean")).alias("mean"),
            F.when(full, F.when(F.col("numeric_hits") > 1, F.col("std")).otherwise(0.0)).alias("std"), F.when(full, F.col("sum")).alias("sum"),
            F.when(full, F.col("distinct_numbers")).when(text, F.col("distinct_values")).alias("unique_count"),
            F.when(full, total - F.col("numeric_hits")).when(date, total - F.col("date_hits")).when(text, total - n).alias("missing_count"),
            F.when(full, n - F.col("numeric_hits")).when(date, n - F.col("date_hits")).when(text, F.lit(0)).alias("unparsed_count"),
            F.when(full, F.col("negatives")).when(text | date, F.lit(0)).alias("negative_count"),
            F.when(date, F.col("ambiguous_hits")).when(full | text, F.lit(0)).alias("ambiguous_date_count"),
            "numeric_hits", "distinct_values",
        )
    )


def first_columns(columns: DataFrame, kinds: tuple[str, ...], names: list[str]) -> DataFrame:
    """The first len(names) columns of the kinds in each dataset, by position: (key, names...); too few leave nulls."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "column")))
    found = columns.filter(F.col("semantic_type").isin(*kinds)).groupBy(*KEY).agg(ordered.alias("c"))
    return found.select(*KEY, *[F.expr(f"try_element_at(c, {i + 1}).column").alias(n) for i, n in enumerate(names)])


def column_values(cells: DataFrame, chosen: DataFrame, name_col: str, value_name: str, parse=None, **more) -> DataFrame:
    """(key, source_row, value_name) of the column that chosen names in name_col; chosen is a row a dataset."""
    parse = parse or (lambda c: S.clean_text(c))
    one = chosen.filter(F.col(name_col).isNotNull()).select(*KEY, F.col(name_col).alias("column"))
    return cells.join(one, [*KEY, "column"]).select(*KEY, "source_row", parse(F.col("value")).alias(value_name))


def duplicate_rows(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_count, distinct_rows, duplicate_rows) of a wide table: rows beyond the first of each equal cleaned tuple.

    Rows are reduced to a 256-bit digest before the shuffle.
    """
    columns = columns or [c for c in table.columns if not c.startswith("_")]
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(S.clean_text(F.col(f"`{c}`")), F.lit("\u0000")).alias(f"c{i}") for i, c in enumerate(columns)])), 256)
    groups = table.select(digest.alias("d")).groupBy("d").count()
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_rows_by_dataset(cells: DataFrame) -> DataFrame:
    """(key, row_count, duplicate_row_count) of each dataset of cells."""
    rows = cells.groupBy(*KEY, "source_row").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("position", S.clean_text(F.col("value")).alias("v"))))), 256).alias("d"))
    return rows.groupBy(*KEY, "d").count().groupBy(*KEY).agg(F.sum("count").alias("row_count"), F.sum(F.col("count") - 1).alias("duplicate_row_count"))


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count): keys that several rows have with every part there."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return table.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def first_seen(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return table.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_rn = 1").drop("_rn")


def suggest_charts(columns: DataFrame, axis_counts: DataFrame) -> DataFrame:
    """Charts of each dataset: a line over its first date, or bars (pie up to 6) over an axis with 2 to 12 values.

    axis_counts is (key, column, axis_values): distinct values of a column with null counted as one.
    """
    dates, cats, meas = (first_columns(columns, k, [n]) for k, n in (((("date", "datetime")), "date"), (("category",), "category"), (MEASURES, "measure")))
    line = dates.join(meas, KEY).filter("date IS NOT NULL AND measure IS NOT NULL").select(*KEY, F.lit("line").alias("chart_type"), F.col("date").alias("x"), F.col("measure").alias("y"))
    axis = columns.filter("semantic_type = 'category'").join(axis_counts, [*KEY, "column"]).filter("axis_values BETWEEN 2 AND 12")
    first = axis.groupBy(*KEY).agg(F.min_by(F.struct("column", "axis_values"), "position").alias("a"))
    bars = first.join(meas, KEY).filter("measure IS NOT NULL").select(*KEY, F.when(F.col("a.axis_values") <= 6, "pie").otherwise("bar").alias("chart_type"), F.col("a.column").alias("x"), F.col("measure").alias("y"))
    return line.unionByName(bars).withColumn("title", F.concat_ws(" by ", "y", "x"))


def axis_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEY, "column").agg(F.count_distinct(F.coalesce("value", F.lit("None"))).alias("axis_values"))


