"""Sinks: export tables, JSON documents and the chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.operators.findings import data_dictionary, reconcile
from veritab.operators.profile import KEY, NUMERIC


def typed_rows(table: DataFrame, kinds: dict[str, str], row_col: str) -> DataFrame:
    """'Source Row' and each column typed by its meaning, the raw text beside it where it could not be read."""
    out = [F.col(row_col).alias("Source Row")]
    for c, kind in kinds.items():
        raw = F.col(f"`{c}`")
        if kind in NUMERIC or kind == "date":
            typed = S.parse_date(raw) if kind == "date" else S.parse_number(raw)
            out += [typed.alias(c), F.when(typed.isNull(), S.clean_text(raw)).alias(f"{c} (raw)")]
        else:
            out.append(S.clean_text(raw).alias(c))
    return table.select(*out)


def raw_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """Cleaned text only, safe to open in a spreadsheet."""
    return table.select(*[S.neutral_cell(S.clean_text(F.col(f"`{c}`"))).alias(c) for c in columns])


def source_metadata(catalog: DataFrame, counts: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, filename, source_type, times, datasets, records, issues) a document."""
    a = counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("datasets"), F.sum("row_count").alias("records"))
    b = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"))
    return catalog.join(a, "doc_id", "left").join(b, "doc_id", "left").fillna(0, ["datasets", "records", "issues"])


def overview(counts: DataFrame, metrics: DataFrame, insights: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, part, label, value): datasets and counts, metrics with rows left out, insights, entities."""
    note = F.when(F.col("excluded_row_count") > 0, F.concat(F.lit(" ("), F.col("excluded_row_count").cast("string"), F.lit(" rows excluded)"))).otherwise(F.lit(""))
    a = counts.select("doc_id", F.lit("dataset").alias("part"), F.col("dataset").alias("label"), F.col("row_count").cast("string").alias("value"))
    b = metrics.select("doc_id", F.lit("metric").alias("part"), "label", F.concat(S.format_number(F.col("value")), note).alias("value"))
    c = insights.select("doc_id", F.lit("insight").alias("part"), F.col("insight_no").cast("string").alias("label"), F.col("text").alias("value"))
    d = entities.select("doc_id", F.lit("entity").alias("part"), F.col("kind").alias("label"), F.col("value"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def report_tables(catalog: DataFrame, cells: DataFrame, columns: DataFrame, counts: DataFrame, issues: DataFrame, metrics: DataFrame, insights: DataFrame, entities: DataFrame, sections: DataFrame) -> dict[str, DataFrame]:
    """The general report by table name; every value is a DataFrame that any writer takes."""
    kinds = columns.select(*KEY, "column", "semantic_type")
    typed = cells.join(kinds, [*KEY, "column"]).select(
        *KEY, "source_row", "column", "position",
        F.when(F.col("semantic_type").isin(*NUMERIC), S.parse_number(F.col("value"))).alias("number"),
        F.when(F.col("semantic_type") == "date", S.parse_date(F.col("value"))).alias("day"), S.clean_text(F.col("value")).alias("text"),
    )
    return {
        "OVERVIEW": overview(counts, metrics, insights, entities), "SOURCE METADATA": source_metadata(catalog, counts, issues), "DATA DICTIONARY": data_dictionary(columns),
        "VALIDATION ISSUES": issues, "RECONCILIATION": reconcile(counts), "DATASETS": typed, "RAW EXTRACTED DATA": cells.withColumn("value", S.neutral_cell(S.clean_text(F.col("value")))), "SOURCE TEXT": sections,
    }


# Export names of the market tables and their columns.
MARKET_TABLES = {"market_overview": "MARKET SUMMARY", "equities": "STOCK", "trading_stats": "MARKET STATS", "bonds": "BONDS", "bond_trades": "BONDS TRADES", "exchange_rates": "EXCHANGE RATE", "indices": "INDICES"}


def market_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The market report by table name with title-case headers; empty tables are left out."""
    return {MARKET_TABLES[k]: t.select(*[F.col(c).alias(c.replace("_", " ").title()) for c in t.columns if c != "line_no"]) for k, t in tables.items() if k in MARKET_TABLES and not t.isEmpty()}


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    for name, t in tables.items():
        t.write.mode("overwrite").format(form).save(f"{path}/{name.lower().replace(' ', '_')}")


def json_documents(catalog: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """One row a document with its child rows as arrays of structs; write with .write.json()."""
    out = catalog
    for name, child in children.items():
        rows = child.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in child.columns if c != "doc_id"])).alias(name))
        out = out.join(rows, "doc_id", "left")
    return out
