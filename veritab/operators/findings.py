"""Metrics, validation, data quality, insights and anomalies over cells and their column profiles.

Every function takes cells and profiled columns (see profile.py) and returns a DataFrame keyed by (doc_id, dataset).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritab.functions import scalars as S
from veritab.operators.profile import KEY, MEASURES, NUMERIC, column_values, duplicate_rows_by_dataset, first_columns
from veritab.operators.series import numbered, with_previous

# Labels of declared totals, thresholds and caps.
TOTAL_LABELS = ("total", "grand total", "subtotal", "sum", "overall")
Z_LIMIT, Z_HIGH = 2.5, 4.0
JUMP_LIMIT, JUMP_HIGH = 0.5, 1.0
MOST_METRICS = MOST_INSIGHTS = 6
MOST_ANOMALIES, MOST_ISSUES, MOST_MATTERS = 40, 30, 8
ISSUE = ["rule_id", "severity", "message", "column", "row", "value"]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def quoted(c) -> Column:
    return F.concat(F.lit('"'), c if isinstance(c, Column) else F.col(c), F.lit('"'))


def dataset_counts(cells: DataFrame) -> DataFrame:
    """(key, row_count, duplicate_row_count)."""
    return duplicate_rows_by_dataset(cells)


# --- metrics


def metrics(columns: DataFrame, counts: DataFrame, most: int = MOST_METRICS) -> DataFrame:
    """Headline metrics of each document: sums of amounts, averages of percentages, record counts; the first six."""
    numeric = columns.filter(F.col("semantic_type").isin(*NUMERIC) & (F.col("numeric_hits") > 0))
    is_pct = F.col("semantic_type") == "percentage"
    measured = numeric.select(
        *KEY, "position", "column",
        F.concat(F.when(is_pct, "Average ").otherwise("Total "), F.col("column")).alias("label"),
        F.bround(F.when(is_pct, F.col("mean")).otherwise(F.col("sum")), 4).alias("value"),
        F.when(is_pct, "average").otherwise("sum").alias("kind"),
        F.col("semantic_type").alias("format_hint"),
        F.col("numeric_hits").alias("included_row_count"),
        (F.col("total_count") - F.col("numeric_hits")).alias("excluded_row_count"),
    )
    records = counts.select(
        *KEY, F.lit(1 << 30).alias("position"), F.lit(None).cast("string").alias("column"), F.concat(F.lit("Records in "), F.col("dataset")).alias("label"),
        F.col("row_count").cast("double").alias("value"), F.lit("count").alias("kind"), F.lit("number").alias("format_hint"),
        F.col("row_count").alias("included_row_count"), F.lit(0).cast("long").alias("excluded_row_count"),
    )
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("dataset", "position"))
    both = measured.unionByName(records).withColumn("metric_no", rank).filter(F.col("metric_no") <= most)
    return both.withColumn("validation_status", F.when(F.col("excluded_row_count") > 0, "partial").otherwise("ok")).drop("position")


def headline(metric_rows: DataFrame) -> DataFrame:
    """(doc_id, headline_label, headline_value): the first currency sum, else the first numeric metric."""
    order = F.struct(F.when((F.col("kind") == "sum") & (F.col("format_hint") == "currency"), 0).otherwise(1), "metric_no")
    return metric_rows.groupBy("doc_id").agg(F.min_by("label", order).alias("headline_label"), F.min_by("value", order).alias("headline_value"))


def explain_metric(cells: DataFrame, doc_id: str, dataset: str, column: str, kind: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """A metric's value over its rows, and its first source rows."""
    own = cells.filter((F.col("doc_id") == doc_id) & (F.col("dataset") == dataset) & (F.col("column") == column))
    rows = own.select("source_row", S.parse_number(F.col("value")).alias("value")).filter("value IS NOT NULL")
    total = {"sum": F.sum("value"), "average": F.avg("value"), "count": F.count("value").cast("double")}[kind]
    return rows.agg(total.alias("value"), F.count("value").alias("rows_used")), rows.orderBy("source_row").limit(most)


def explain_chart(cells: DataFrame, doc_id: str, dataset: str, x: str, y: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows behind a chart: both axes there. Their number, and the first ones."""
    own = cells.filter((F.col("doc_id") == doc_id) & (F.col("dataset") == dataset) & F.col("column").isin(x, y))
    rows = own.groupBy("source_row").agg(F.max(F.when(F.col("column") == x, F.col("value"))).alias("x"), F.max(F.when(F.col("column") == y, F.col("value"))).alias("y"))
    rows = rows.filter("x IS NOT NULL AND x <> '' AND y IS NOT NULL AND y <> ''")
    return rows.agg(F.count(F.lit(1)).alias("rows_used")), rows.orderBy("source_row").limit(most)


def chart_points(table: DataFrame, x: Column, y: Column) -> DataFrame:
    """(x, y): y summed by x, blank x left out. Text y keeps digits, points and minus signs only; none of them counts 0."""
    digits = F.regexp_replace(y.cast("string"), r"[^0-9.\-]", "")
    number = F.when(y.isNull() | (digits == ""), F.lit(0.0)).otherwise(digits.try_cast("double"))
    points = table.select(x.cast("string").alias("x"), number.alias("v")).filter("x IS NOT NULL AND trim(x) <> '' AND v IS NOT NULL")
    return points.groupBy("x").agg(F.sum("v").alias("y"))


def project(metric_rows: DataFrame, percents: list[float]) -> DataFrame:
    """What-if values: value * (1 + pct / 100), pct from -50 to 50."""
    pct = F.explode(F.array(*[F.lit(float(p)) for p in percents if -50 <= p <= 50]))
    return metric_rows.filter("value IS NOT NULL").withColumn("pct", pct).withColumn("projected", F.col("value") * (1 + F.col("pct") / 100))


def reconcile(counts: DataFrame, blanks: DataFrame | None = None) -> DataFrame:
    """Raw rows of each dataset = records + blank rows + one header row; duplicates stay in."""
    blanks = counts.select(*KEY, F.lit(0).cast("long").alias("blank_rows_skipped")) if blanks is None else blanks
    joined = counts.join(blanks, KEY, "left").withColumn("blank_rows_skipped", F.coalesce("blank_rows_skipped", F.lit(0)))
    return joined.withColumn("raw_rows", F.col("row_count") + F.col("blank_rows_skipped") + 1)


def data_dictionary(columns: DataFrame) -> DataFrame:
    return columns.select(*KEY, "column", "semantic_type", "data_type", "confidence", "non_null_count", "total_count", F.array_join("sample_values", ", ").alias("samples"))


# --- validation


def total_rows(cells: DataFrame, columns: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(key, source_row, label): rows with a total's label in a column of the kinds; of several the first column's."""
    labels = columns.filter(F.col("semantic_type").isin(*kinds)).select(*KEY, "column")
    found = cells.join(labels, [*KEY, "column"]).withColumn("label", S.clean_text(F.col("value"))).filter(F.lower("label").isin(*TOTAL_LABELS))
    return found.groupBy(*KEY, "source_row").agg(F.min_by("label", "position").alias("label"))


def numeric_cells(cells: DataFrame, columns: DataFrame, kinds: tuple[str, ...] = NUMERIC) -> DataFrame:
    """(key, column, position, source_row, v) of the parsed cells of the columns of the kinds."""
    own = columns.filter(F.col("semantic_type").isin(*kinds)).select(*KEY, "column")
    return cells.join(own, [*KEY, "column"]).select(*KEY, "column", "position", "source_row", S.parse_number(F.col("value")).alias("v")).filter("v IS NOT NULL")


def total_mismatches(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Each row with a total's label against the sum of all other rows, other totals included; over 1 percent or 0.01 off."""
    marked = total_rows(cells, columns, ("category", "text", "identifier"))
    values = numeric_cells(cells, columns)
    sums = values.groupBy(*KEY, "column").agg(F.sum("v").alias("total"))
    rows = cells.groupBy(*KEY).agg(F.count_distinct("source_row").alias("n")).filter("n >= 2").select(*KEY)
    claims = values.join(marked, [*KEY, "source_row"]).join(sums, [*KEY, "column"]).join(rows, KEY)
    claims = claims.withColumn("computed", F.col("total") - F.col("v"))
    off = F.abs(F.col("v") - F.col("computed")) > F.greatest(F.lit(0.01), F.abs("computed") * 0.01)
    return claims.filter(off).select(*KEY, "column", "source_row", "label", F.col("v").alias("claimed"), "computed")


def issues(columns: DataFrame, counts: DataFrame, mismatches: DataFrame | None = None, extractor_warnings: DataFrame | None = None) -> DataFrame:
    """Validation issues of each dataset by rule. Infos are no warnings: filter severity <> 'info' for those."""
    c, total, n = columns, F.col("total_count"), F.col("non_null_count")

    def rule(source: DataFrame, where: Column, rule_id: str, severity, message: Column, value=None, column="column") -> DataFrame:
        severity = severity if isinstance(severity, Column) else F.lit(severity)
        return source.filter(where).select(
            *KEY, F.lit(rule_id).alias("rule_id"), severity.alias("severity"), message.alias("message"),
            (F.col(column) if column else F.lit(None).cast("string")).alias("column"), F.lit(None).cast("long").alias("row"),
            (value if value is not None else F.lit(None)).cast("string").alias("value"),
        )

    def said(text: str, count: str) -> Column:
        return F.concat(quoted("column"), F.lit(": "), F.col(count).cast("string"), F.lit(f" {text}"))

    missing = c.withColumn("missing", total - n)
    repeats = c.filter("semantic_type = 'identifier'").withColumn("repeats", n - F.col("unique_count"))
    found = [
        rule(c, F.col("confidence") == "low", "low_confidence_type", "info", F.concat(quoted("column"), F.lit(": its meaning is uncertain"))),
        rule(missing, F.col("missing") > 0, "missing_values", F.when(n == 0, "warning").otherwise("info"), said("blank cells", "missing"), F.col("missing")),
        rule(c, F.col("unparsed_count") > 0, "unparsed_values", "warning", said("cells could not be read", "unparsed_count"), F.col("unparsed_count")),
        rule(c, F.col("semantic_type").isin("currency", "quantity") & (F.col("negative_count") > 0), "negative_values", "warning", said("negative values", "negative_count"), F.col("negative_count")),
        rule(repeats, F.col("repeats") > 0, "duplicate_identifiers", "warning", said("repeated identifiers", "repeats"), F.col("repeats")),
        rule(c, F.col("ambiguous_date_count") > 0, "ambiguous_dates", "warning", said("dates could be read two ways", "ambiguous_date_count"), F.col("ambiguous_date_count")),
        rule(counts, F.col("duplicate_row_count") > 0, "duplicate_rows", "warning", F.concat(F.col("duplicate_row_count").cast("string"), F.lit(" repeated rows")), F.col("duplicate_row_count"), None),
    ]
    if "blank_rows_skipped" in counts.columns:
        found.append(rule(counts, F.col("blank_rows_skipped") > 0, "blank_rows_skipped", "info", F.concat(F.col("blank_rows_skipped").cast("string"), F.lit(" blank rows left out")), F.col("blank_rows_skipped"), None))
    if mismatches is not None:
        text = F.concat(F.lit("row "), quoted("label"), F.lit(": "), quoted("column"), F.lit(" says "), S.format_number(F.col("claimed")), F.lit(", the other rows sum to "), S.format_number(F.col("computed")))
        found.append(rule(mismatches, F.lit(True), "total_mismatch", "error", text, F.col("claimed")))
    if extractor_warnings is not None:
        found.append(extractor_warnings.select(*KEY, *ISSUE))
    return union(found)


# --- quality


def invalid_dates(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(key, column, invalid): cells of date columns with text that no format reads."""
    dates = columns.filter("semantic_type = 'date'").select(*KEY, "column")
    t = S.clean_text(F.col("value"))
    bad = t.isNotNull() & S.parse_date_builtin(F.col("value")).isNull()
    return cells.join(dates, [*KEY, "column"]).groupBy(*KEY, "column").agg(F.count_if(bad).alias("invalid"))


def currency_signatures(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(key, column, signatures): different sets of currency marks and codes that a currency column's cells are written with."""
    money = columns.filter("semantic_type = 'currency'").select(*KEY, "column")
    marks = F.regexp_extract_all(F.upper("value"), F.lit(r"[$€£¥]|\b(?:FRW|RWF|USD|EUR|GBP|KES)\b"), F.lit(0))
    own = cells.join(money, [*KEY, "column"]).filter(S.clean_text(F.col("value")).isNotNull())
    return own.select(*KEY, "column", F.array_join(F.array_sort(F.array_distinct(marks)), "").alias("s")).groupBy(*KEY, "column").agg(F.count_distinct("s").alias("signatures"))


def quality(cells: DataFrame, columns: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, issues). Score of a document: completeness less duplicates, invalid dates and mixed units, 0 to 100."""
    bad = invalid_dates(cells, columns)
    mixed = currency_signatures(cells, columns).filter("signatures > 1")
    per_cells = columns.groupBy("doc_id").agg(F.sum("total_count").alias("total_cells"), F.sum(F.col("total_count") - F.col("non_null_count")).alias("missing_cells"))
    rows = counts.groupBy("doc_id").agg(F.sum("row_count").alias("total_rows"), F.sum("duplicate_row_count").alias("duplicate_rows"))
    parts = (
        per_cells.join(rows, "doc_id", "left")
        .join(bad.groupBy("doc_id").agg(F.sum("invalid").alias("invalid_dates")), "doc_id", "left")
        .join(mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("mixed_units")), "doc_id", "left")
        .fillna(0)
    )

    def share(a: str, b: str, most: float) -> Column:
        return F.least(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), F.lit(most))

    left = 1 - share("missing_cells", "total_cells", 1.0) - share("duplicate_rows", "total_rows", 0.3) - share("invalid_dates", "total_cells", 0.2) - F.least(F.col("mixed_units") * 0.1, F.lit(0.3))
    scores = parts.withColumn("quality_score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(left * 100, 0).cast("int"))))

    def issue(df: DataFrame, kind: str, severity, message: Column, column: Column) -> DataFrame:
        severity = severity if isinstance(severity, Column) else F.lit(severity)
        return df.select(*KEY, F.lit(kind).alias("type"), severity.alias("severity"), column.cast("string").alias("column"), message.alias("message"))

    gaps = columns.withColumn("missing", F.col("total_count") - F.col("non_null_count")).filter("missing > 0")
    found = union([
        issue(counts.filter("duplicate_row_count > 0"), "duplicates", "medium", F.concat(F.col("duplicate_row_count").cast("string"), F.lit(" repeated records")), F.lit(None)),
        issue(gaps, "missing_values", F.when(F.col("missing") >= 0.2 * F.col("total_count"), "high").otherwise("low"), F.concat(quoted("column"), F.lit(" has "), F.col("missing").cast("string"), F.lit(" blank cells")), F.col("column")),
        issue(bad.filter("invalid > 0"), "invalid_dates", "medium", F.concat(quoted("column"), F.lit(" has "), F.col("invalid").cast("string"), F.lit(" unreadable dates")), F.col("column")),
        issue(mixed, "inconsistent_units", "high", F.concat(quoted("column"), F.lit(" mixes currencies")), F.col("column")),
    ])
    return scores, top_by_severity(found, MOST_ISSUES)


def severity_code(c: str = "severity") -> Column:
    return F.when(F.col(c) == "high", 0).when(F.col(c) == "medium", 1).when(F.col(c) == "low", 2).otherwise(3)


def top_by_severity(found: DataFrame, most: int) -> DataFrame:
    """High before medium before low, then dataset, column, kind and message; the first ones of each document."""
    order = [c for c in ("dataset", "column", "type", "source_row", "message") if c in found.columns]
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(severity_code(), *order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


# --- anomalies


def z_outliers(cells: DataFrame, columns: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    """Values over limit population deviations from their column's mean: the profile is joined, no window is needed."""
    stats = columns.filter(F.col("semantic_type").isin(*NUMERIC) & (F.col("std") > 0)).select(*KEY, "column", "mean", "std")
    values = cells.join(stats, [*KEY, "column"]).withColumn("v", S.parse_number(F.col("value"))).withColumn("z", F.abs(F.col("v") - F.col("mean")) / F.col("std"))
    message = F.concat(quoted("column"), F.lit(" value "), S.format_number(F.col("v")), F.lit(" is "), F.format_number("z", 1), F.lit(" deviations from the mean"))
    return values.filter(F.col("z") > limit).select(*KEY, F.lit("outlier").alias("type"), F.when(F.col("z") >= Z_HIGH, "high").otherwise("medium").alias("severity"), "column", "source_row", F.col("v").alias("value"), F.col("z").alias("score"), message.alias("message"))


def group_outliers(table: DataFrame, keys: list[str], value: str, limit: float = Z_LIMIT) -> DataFrame:
    """Rows of a wide table over limit population deviations from their group's mean, with z."""
    stats = table.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).filter("std > 0")
    return table.join(stats, keys).withColumn("z", F.abs(F.col(value) - F.col("mean")) / F.col("std")).filter(F.col("z") > limit)


def jumps(table: DataFrame, keys: list[str], day: str, value: str, tie: str, limit: float = JUMP_LIMIT) -> DataFrame:
    """Rows whose value moved by limit or more of the one before in date order, per key; after zero nothing is said.

    A series of any length is cut by range partitions; see with_previous().
    """
    points = table.filter(F.col(day).isNotNull() & F.col(value).isNotNull())
    moved = with_previous(points, keys, [day, tie], [value, day]).withColumn("prev_value", F.col(f"previous.{value}")).withColumn("prev_day", F.col(f"previous.{day}"))
    change = F.try_divide(F.col(value) - F.col("prev_value"), F.abs("prev_value"))
    found = moved.withColumn("change", change).filter(F.abs("change") >= limit).withColumn("severity", F.when(F.abs("change") >= JUMP_HIGH, "high").otherwise("medium"))
    return found.select(*table.columns, "prev_day", "prev_value", "change", "severity")


def dated_measure(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(key, source_row, day, v, measure): the first date column beside the first measure."""
    chosen = first_columns(columns, ("date", "datetime"), ["date_column"]).join(first_columns(columns, MEASURES, ["measure"]), KEY)
    day = column_values(cells, chosen, "date_column", "day", S.parse_date)
    v = column_values(cells, chosen, "measure", "v", S.parse_number)
    return day.join(v, [*KEY, "source_row"]).filter("day IS NOT NULL AND v IS NOT NULL").join(chosen.select(*KEY, "measure"), KEY)


def period_jumps(cells: DataFrame, columns: DataFrame) -> DataFrame:
    found = jumps(dated_measure(cells, columns), KEY, "day", "v", "source_row")
    message = F.concat(quoted("measure"), F.lit(" moved "), F.format_number(F.col("change") * 100, 0), F.lit("% from "), F.col("prev_day").cast("string"), F.lit(" to "), F.col("day").cast("string"))
    return found.select(*KEY, F.lit("sudden_change").alias("type"), "severity", F.col("measure").alias("column"), "source_row", F.col("v").alias("value"), F.col("change").alias("score"), message.alias("message"))


def mismatched_totals(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """The last row labelled as a total in the first category column against the sum of all rows without such a label."""
    chosen = first_columns(columns, ("category",), ["category"]).join(first_columns(columns, MEASURES, ["measure"]), KEY)
    label = column_values(cells, chosen, "category", "label")
    v = column_values(cells, chosen, "measure", "v", S.parse_number)
    is_total = F.coalesce(F.lower("label").isin(*TOTAL_LABELS), F.lit(False))
    sums = v.filter("v IS NOT NULL").join(label, [*KEY, "source_row"], "left").groupBy(*KEY).agg(F.sum(F.when(~is_total, F.col("v"))).alias("computed"), F.max_by("v", F.when(is_total, F.col("source_row"))).alias("declared"), F.max(F.when(is_total, F.col("source_row"))).alias("source_row"))
    off = F.abs(F.col("declared") - F.col("computed")) > F.greatest(F.abs("declared") * 0.01, F.lit(0.01))
    found = sums.filter(F.col("source_row").isNotNull() & off).join(chosen, KEY)
    message = F.concat(F.lit("the declared total of "), quoted("measure"), F.lit(" is "), S.format_number(F.col("declared")), F.lit(", its rows sum to "), S.format_number(F.col("computed")))
    return found.select(*KEY, F.lit("mismatched_total").alias("type"), F.lit("high").alias("severity"), F.col("measure").alias("column"), "source_row", F.col("declared").alias("value"), F.col("computed").alias("score"), message.alias("message"))


def anomalies(cells: DataFrame, columns: DataFrame) -> DataFrame:
    return top_by_severity(union([z_outliers(cells, columns), period_jumps(cells, columns), mismatched_totals(cells, columns)]), MOST_ANOMALIES)


# --- insights


def leaders(table: DataFrame, keys: list[str], category: str, value: str, order: str | None = None) -> DataFrame:
    """(keys, leader, leader_total, trailer, trailer_total): categories with the largest and smallest sum; ties to the first seen."""
    first = F.min(order) if order else F.min(category)
    sums = table.filter(F.col(category).isNotNull() & (F.col(category).cast("string") != "") & F.col(value).isNotNull()).groupBy(*keys, category).agg(F.sum(value).alias("s"), first.alias("first"))
    up = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("s"), "first"))
    down = F.row_number().over(W.partitionBy(*keys).orderBy("s", "first"))
    ends = sums.withColumn("up", up).withColumn("down", down).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("up") == 1, F.col(category))).alias("leader"), F.max("s").alias("leader_total"),
        F.max(F.when(F.col("down") == 1, F.col(category))).alias("trailer"), F.min("s").alias("trailer_total"),
    )
    return ends.filter("n >= 2 AND leader <> trailer").drop("n")


def trends(table: DataFrame, keys: list[str], day: str, value: str, tie: str) -> DataFrame:
    """(keys, points, slope, relative_slope, first_day, last_day, direction) of series with three points or more."""
    points = table.filter(F.col(day).isNotNull() & F.col(value).isNotNull())
    x = F.col("x").cast("double")
    fit = numbered(points, keys, [day, tie], "x").withColumn("x", x).groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.regr_slope(value, "x").alias("slope"), F.avg(value).alias("mean"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    rel = F.col("slope") * F.col("points") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    fit = fit.filter("points >= 3").withColumn("relative_slope", rel)
    return fit.withColumn("direction", F.when(F.col("relative_slope") > 0.08, "increased").when(F.col("relative_slope") < -0.08, "decreased").otherwise("flat"))


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over complete pairs; null where either side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(table: DataFrame, keys: list[str], columns: list[str], least_pairs: int = 5) -> DataFrame:
    """(keys, a, b, pairs, r) for every two of the columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [safe_corr(a, b).alias(f"_r{i}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"_n{i}")]
    wide = (table.groupBy(*keys) if keys else table.groupBy()).agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_n{i}").alias("pairs"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(*keys, each.alias("p")).select(*keys, "p.*").filter((F.col("pairs") >= least_pairs) & F.col("r").isNotNull())


def _comoments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows (doc_id, dataset, positions, values) for every two columns of a dataset, as matrix products."""
    names = ["doc_id", "dataset", "pa", "pb", "n", "x", "y", "xx", "yy", "xy"]
    for batch in batches:
        own: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("dataset").to_pylist(), strict=True)):
            own.setdefault(key, []).append(i)
        lists, values = batch.column("positions"), batch.column("vs").values.to_numpy(zero_copy_only=False)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for (doc_id, dataset), rows in own.items():
            row = np.repeat(np.arange(len(rows)), [at[i + 1] - at[i] for i in rows])
            cell = np.concatenate([np.arange(at[i], at[i + 1]) for i in rows])
            positions, column = np.unique(flat[cell], return_inverse=True)
            v, there = np.zeros((len(rows), len(positions))), np.zeros((len(rows), len(positions)))
            v[row, column], there[row, column] = values[cell], 1.0
            # A column's values in complete pairs only: its products with the other column's presence.
            n, x, xx, xy = there.T @ there, v.T @ there, (v * v).T @ there, v.T @ v
            a, b = np.nonzero(np.triu(n, 1))
            sums = [n[a, b], x[a, b], x[b, a], xx[a, b], xx[b, a], xy[a, b]]
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(a), batch.column("doc_id").type), pa.array([dataset] * len(a), pa.string()), pa.array(positions[a]), pa.array(positions[b]), *map(pa.array, sums)], names)


def correlations_of_cells(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(key, pa, pb, a, b, pairs, r) for every two measures of each dataset, by position and name.

    A row's values are packed once; each task adds up the moments of all pairs of columns as matrices, less the columns'
    means, so that a dataset of many columns costs one shuffle of its rows and of as many sums as it has pairs.
    """
    kept = columns.filter(F.col("semantic_type").isin(*MEASURES)).select(*KEY, "column", F.col("mean").alias("m"))
    v = cells.join(kept, [*KEY, "column"]).withColumn("v", S.parse_number(F.col("value")) - F.coalesce("m", F.lit(0.0))).filter("v IS NOT NULL")
    packed = v.groupBy(*KEY, "source_row").agg(F.array_sort(F.collect_list(F.struct("position", "v"))).alias("c")).select(*KEY, F.col("c.position").alias("positions"), F.col("c.v").alias("vs"))
    kind = packed.schema["doc_id"].dataType.simpleString()
    sums = packed.mapInArrow(_comoments, f"doc_id {kind}, dataset string, pa int, pb int, n double, x double, y double, xx double, yy double, xy double")
    total = sums.groupBy(*KEY, "pa", "pb").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = lambda s, ss: F.col(ss) / F.col("n") - F.pow(F.col(s) / F.col("n"), 2)
    # What is left of a constant column after rounding is no spread.
    flat = lambda s, ss: spread(s, ss) <= 1e-12 * F.col(ss) / F.col("n")
    r = (F.col("xy") / F.col("n") - F.col("x") * F.col("y") / F.col("n") / F.col("n")) / F.sqrt(spread("x", "xx") * spread("y", "yy"))
    found = total.filter(F.col("n") >= 5).filter(~flat("x", "xx") & ~flat("y", "yy")).withColumn("r", r)
    name = lambda p, n: columns.select(*KEY, F.col("position").alias(p), F.col("column").alias(n))
    named = found.join(name("pa", "a"), [*KEY, "pa"]).join(name("pb", "b"), [*KEY, "pb"])
    return named.select(*KEY, "pa", "pb", "a", "b", F.col("n").cast("long").alias("pairs"), "r")


def insights(cells: DataFrame, columns: DataFrame, counts: DataFrame, most: int = MOST_INSIGHTS) -> DataFrame:
    """Sentences of each document, by dataset and then kind: range, leader, trend, outliers, correlation, duplicates."""
    measure = first_columns(columns, MEASURES, ["column", "second"])
    stats = columns.select(*KEY, "column", "min", "max", "mean", "std")
    first = measure.join(stats, [*KEY, "column"]).join(counts, KEY)
    number = S.format_number
    ranges = first.filter("min <> max").select(*KEY, F.lit(1).alias("kind_no"), F.concat(quoted("column"), F.lit(" ranges from "), number(F.col("min")), F.lit(" to "), number(F.col("max")), F.lit(" (average "), number(F.col("mean")), F.lit(") across "), F.col("row_count").cast("string"), F.lit(" records.")).alias("text"))
    category = first_columns(columns, ("category",), ["category"]).join(measure, KEY)
    both = column_values(cells, category, "category", "c", lambda c: c).join(column_values(cells, category, "column", "v", S.parse_number), [*KEY, "source_row"])
    lead = leaders(both, KEY, "c", "v", "source_row").join(measure, KEY).select(*KEY, F.lit(2).alias("kind_no"), F.concat(F.lit("By total "), F.col("column"), F.lit(", "), quoted("leader"), F.lit(" leads ("), number(F.col("leader_total")), F.lit(") and "), quoted("trailer"), F.lit(" trails ("), number(F.col("trailer_total")), F.lit(").")).alias("text"))
    trend = trends(dated_measure(cells, columns), KEY, "day", "v", "source_row").filter("direction <> 'flat'").join(measure, KEY).select(*KEY, F.lit(3).alias("kind_no"), F.concat(quoted("column"), F.lit(" "), F.col("direction"), F.lit(" from "), F.col("first_day").cast("string"), F.lit(" to "), F.col("last_day").cast("string"), F.lit(".")).alias("text"))
    far = column_values(cells, measure, "column", "v", S.parse_number).join(first.select(*KEY, "column", "mean", "std"), KEY).filter((F.col("std") > 0) & (F.abs(F.col("v") - F.col("mean")) > 2 * F.col("std")))
    outliers = far.groupBy(*KEY, "column").count().select(*KEY, F.lit(4).alias("kind_no"), F.concat(quoted("column"), F.lit(" has "), F.col("count").cast("string"), F.lit(" values more than 2 deviations from the mean.")).alias("text"))
    related = correlations_of_cells(cells, columns).join(measure.select(*KEY, F.col("column").alias("a"), F.col("second").alias("b")), [*KEY, "a", "b"]).filter(F.abs("r") >= 0.6)
    related = related.select(*KEY, F.lit(5).alias("kind_no"), F.concat(quoted("a"), F.lit(" and "), quoted("b"), F.lit(" are strongly "), F.when(F.col("r") > 0, "positively").otherwise("negatively"), F.lit(" correlated (r="), F.format_number("r", 2), F.lit(").")).alias("text"))
    repeats = counts.filter("duplicate_row_count > 0").select(*KEY, F.lit(6).alias("kind_no"), F.concat(F.col("dataset"), F.lit(" holds "), F.col("duplicate_row_count").cast("string"), F.lit(" repeated records.")).alias("text"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("dataset", "kind_no"))
    return union([ranges, lead, trend, outliers, related, repeats]).withColumn("insight_no", rank).filter(F.col("insight_no") <= most)


def discoveries(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(doc_id, text) stored with a document, or else the ones computed now."""
    have = stored.select("doc_id").distinct()
    return stored.select("doc_id", "text").unionByName(computed.join(have, "doc_id", "left_anti").select("doc_id", "text"))


def what_matters(quality_issues: DataFrame, anomaly_rows: DataFrame, discovery_rows: DataFrame, most: int = MOST_MATTERS) -> DataFrame:
    """Issues, anomalies and discoveries of a document together, by severity and then kind; the first eight."""
    found = union([
        quality_issues.select("doc_id", F.lit("quality").alias("category"), "severity", "message", F.col("rank").alias("n")),
        anomaly_rows.select("doc_id", F.lit("anomaly").alias("category"), "severity", "message", F.col("rank").alias("n")),
        discovery_rows.select("doc_id", F.lit("discovery").alias("category"), F.lit("low").alias("severity"), F.col("text").alias("message"), F.lit(0).alias("n")),
    ])
    weight = F.when(F.col("category") == "discovery", 1).otherwise(2)
    source = F.when(F.col("category") == "quality", 0).when(F.col("category") == "anomaly", 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(severity_code(), F.desc(weight), source, "n", "message"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).drop("n")


def investigate_summary(counts: DataFrame, scores: DataFrame, anomaly_rows: DataFrame, discovery_rows: DataFrame) -> DataFrame:
    """(doc_id, summary): datasets, records, score, high anomalies and discoveries in one sentence."""
    a = counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("datasets"), F.sum("row_count").alias("records"))
    b = anomaly_rows.groupBy("doc_id").agg(F.count_if(F.col("severity") == "high").alias("high"))
    c = discovery_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    all_ = a.join(scores.select("doc_id", "quality_score"), "doc_id", "left").join(b, "doc_id", "left").join(c, "doc_id", "left").fillna(0)
    s = [F.col(x).cast("string") for x in ("datasets", "records", "quality_score", "high", "found")]
    text = F.concat(s[0], F.lit(" datasets, "), s[1], F.lit(" records; quality "), s[2], F.lit("/100; "), F.when((F.col("high") == 0) & (F.col("quality_score") >= 90), "no major issues; ").otherwise(F.concat(s[3], F.lit(" high-severity anomalies; "))), s[4], F.lit(" discoveries."))
    return all_.select("doc_id", text.alias("summary"))


# --- alerts, graph, places


def column_totals(cells: DataFrame, columns: DataFrame) -> DataFrame:
    return numeric_cells(cells, columns).groupBy(*KEY, "column").agg(F.sum("v").alias("total"))


def evaluate_alerts(rules: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """rules (keys, operator, threshold) with value and triggered; without a total the value is null and nothing triggers."""
    v, t, op = F.col("value"), F.col("threshold"), F.col("operator")
    hit = F.when(op == "gt", v > t).when(op == "gte", v >= t).when(op == "lt", v < t).when(op == "lte", v <= t)
    return rules.join(totals.withColumnRenamed("total", "value"), keys, "left").withColumn("triggered", F.coalesce(hit, F.lit(False)))


def cooccurrence(table: DataFrame, keys: list[str], a: str, b: str, most_nodes: int = 30, most_edges: int = 40) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph of two category columns: weights count rows. Heaviest nodes, then edges between them."""
    rows = table.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.concat(F.lit(f"{a}:"), F.col(a).cast("string")), F.concat(F.lit(f"{b}:"), F.col(b).cast("string"))
    edges = rows.select(*keys, F.least(x, y).alias("source"), F.greatest(x, y).alias("target")).groupBy(*keys, "source", "target").agg(F.count(F.lit(1)).alias("weight"))
    nodes = edges.select(*keys, F.explode(F.array("source", "target")).alias("id"), "weight").groupBy(*keys, "id").agg(F.sum("weight").alias("weight"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    nodes = nodes.withColumn("rank", F.row_number().over(part.orderBy(F.desc("weight"), "id"))).filter(F.col("rank") <= most_nodes)
    kept = edges.join(nodes.select(*keys, F.col("id").alias("source")), [*keys, "source"], "left_semi").join(nodes.select(*keys, F.col("id").alias("target")), [*keys, "target"], "left_semi")
    kept = kept.withColumn("rank", F.row_number().over(part.orderBy(F.desc("weight"), "source", "target"))).filter(F.col("rank") <= most_edges)
    return nodes, kept


# Places and their latitude and longitude.
PLACES = {
    "rwanda": (-1.9403, 29.8739), "kigali": (-1.9441, 30.0619), "kenya": (-0.0236, 37.9062), "nairobi": (-1.2921, 36.8219),
    "uganda": (1.3733, 32.2903), "kampala": (0.3476, 32.5825), "tanzania": (-6.3690, 34.8888), "dar es salaam": (-6.7924, 39.2083),
    "burundi": (-3.3731, 29.9189), "bujumbura": (-3.3822, 29.3644), "drc": (-4.0383, 21.7587), "congo": (-4.0383, 21.7587),
    "kinshasa": (-4.4419, 15.2663), "usa": (37.0902, -95.7129), "united states": (37.0902, -95.7129), "uk": (55.3781, -3.4360),
    "united kingdom": (55.3781, -3.4360), "china": (35.8617, 104.1954), "india": (20.5937, 78.9629), "south africa": (-30.5595, 22.9375),
    "nigeria": (9.0820, 8.6753), "ethiopia": (9.1450, 40.4897), "egypt": (26.8206, 30.8025), "ghana": (7.9465, -1.0232),
    "france": (46.2276, 2.2137), "germany": (51.1657, 10.4515), "zambia": (-13.1339, 27.8493),
}


def gazetteer(spark, places: dict[str, tuple[float, float]] = PLACES) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in places.items()], "place string, lat double, lon double")


LATITUDE, LONGITUDE = r"(?i)\b(lat|latitude)\b", r"(?i)\b(lon|lng|longitude)\b"


def place_points(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(key, source_row, lat, lon, value) of datasets with a column named for latitudes and one for longitudes.

    value is the first measure, null if there is none; rows without both coordinates are left out. Other datasets have
    no points of their own: see place_totals().
    """

    def first(pattern: str, name: str) -> DataFrame:
        return columns.filter(F.col("column").rlike(pattern)).groupBy(*KEY).agg(F.min_by("column", "position").alias(name))

    chosen = first(LATITUDE, "lat_column").join(first(LONGITUDE, "lon_column"), KEY).join(first_columns(columns, MEASURES, ["measure"]), KEY, "left")
    role = F.when(F.col("column") == F.col("lat_column"), "lat").when(F.col("column") == F.col("lon_column"), "lon")
    # One column can be a coordinate and the measure.
    roles = F.array_compact(F.array(role, F.when(F.col("column") == F.col("measure"), "value")))
    named = columns.join(chosen, KEY).select(*KEY, "column", F.explode(roles).alias("role"))
    own = cells.join(named, [*KEY, "column"]).withColumn("v", S.parse_number(F.col("value")))
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("v"))).alias(r)
    return own.groupBy(*KEY, "source_row").agg(pick("lat"), pick("lon"), pick("value")).filter("lat IS NOT NULL AND lon IS NOT NULL")


def place_totals(table: DataFrame, place: Column, value: Column, places: DataFrame, most: int = 60) -> DataFrame:
    """(place, label, lat, lon, total, n) of the known places in a table; unknown ones are left out, unparsed values count 0."""
    rows = table.select(S.clean_text(place).alias("label"), F.coalesce(value, F.lit(0.0)).alias("v")).withColumn("place", F.lower("label"))
    sums = rows.filter("place IS NOT NULL").groupBy("place").agg(F.min("label").alias("label"), F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    # One row a place on either side: whether a side is small enough to be sent to all tasks is Spark's to measure.
    return sums.join(places, "place").orderBy(F.desc("total"), "place").limit(most)
