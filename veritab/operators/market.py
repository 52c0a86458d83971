"""Market reports: lines of text and sheets to typed tables, their validation, rankings and insights.

docs is (doc_id, text); every result is keyed by doc_id. Lines are tested by one pattern each and parsed by its groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritab.functions import scalars as S
from veritab.operators.findings import union
from veritab.operators.profile import first_seen

# Line formats, known names, units, sheets and header names of the reports.
NUM = r"[\d,]+\.?\d*"
SIGNED = r"[+-]?[\d,]+\.\d+"
STOCK_NUM = r"[+-]?[\d,]+\.?\d*"
STOCK_LINE = r"^([A-Z0-9]{10,12})\s+([A-Z]{2,6})" + rf"\s+({STOCK_NUM})" * 9 + r"\s*$"
BOND_LINE = (
    r"^([A-Z0-9]{5,12})\s+(?:(Re-op(?:ened)?)\s+)?([A-Za-z0-9]+/\d{4}/\d{1,2}[A-Za-z]+)\s+(\d{1,2}/\d{1,2}/\d{4})\s+([\d.]+)%" + rf"\s+({NUM})" * 5 + r"\s*$"
)
INDEX_LINE = r"^([A-Z][A-Z0-9]{1,9})" + rf"\s+({SIGNED})" * 4 + r"(?:\s|$)"
INDEX_NAMES = ("RSI", "ALSI", "EAE20", "EAE")
RATE = r"(?<![A-Za-z0-9])([A-Z]{3})\s+([\d,]+\.\d{2,4})\s+([\d,]+\.\d{2,4})\s+([\d,]+\.\d{2,4})(?![\d,.])"
STAT_LINE = r"(?i)^(Shares traded|Equity Turnover|Number of deals)" + rf"\s+({NUM})" * 4
BOND_TURNOVER = r"(?i)turnover\s+of\s+Frw\s*([\d,]+)\s+worth\s+of\s+bonds\s+traded\s+in\s+(\d+)\s+deals"
MARKET_CAP = r"(?i)Market\s+Capitalization\s+\(Frw\)\s*([\d,]+)"
REPO_DEALS = r"(?i)Repo\s+Market,\s*(\d+)\s+deals?\s+worth\s+Frw\s*([\d,.]+)\s*(billion|million|thousand)?\s+were\s+traded\s+for\s+a\s+([\w-]+)"
REPO_RATE = r"(?i)tenor\s+with\s+average\s+rate\s+of\s+([\d.]+)%"
TITLE_DATE = r"(?i)(\d{1,2})(?:ST|ND|RD|TH)?\s+([A-Za-z]+)\s+(\d{4})"
EXCHANGE = "RWANDA STOCK EXCHANGE"
SHEETS = ("STOCK", "MARKET STATS", "BONDS", "BONDS TRADES", "EXCHANGE RATE")
EQUITY_FIELDS = ("high_12m", "low_12m", "high_today", "low_today", "closing", "previous", "change", "volume", "value")
STOCK_ALIASES = {"ticker": ("security", "stock", "ticker"), "closing": ("closing", "close", "closing price"), "previous": ("previous", "prev", "previous price"), "change": ("change",), "volume": ("volume",), "value": ("value", "turnover")}


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) trimmed."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("line_no", "line")).withColumn("line", S.strip(F.col("line")))


def _group(c: Column, pattern: str, k: int) -> Column:
    """Group k of a line's match; a group that took no part is null."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def _groups(c: Column, pattern: str, n: int) -> Column:
    """All n groups of the match that c begins with, matched once; what follows the match comes after them."""
    return F.split(F.regexp_replace(c, pattern, "".join(f"${k}\x01" for k in range(1, n + 1))), "\x01")


def _at(k: int, groups: str = "g") -> Column:
    """Group k of _groups(); a group that took no part is null."""
    return F.nullif(F.get(groups, F.lit(k - 1)), F.lit(""))


def equities(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines(docs).filter(line.rlike(STOCK_LINE)).withColumn("g", _groups(line, STOCK_LINE, 11)).select("doc_id", "line_no", _at(1).alias("isin"), _at(2).alias("ticker"), *[S.parse_number(_at(3 + i)).alias(f) for i, f in enumerate(EQUITY_FIELDS)])
    return first_seen(rows.withColumn("volume", F.col("volume").cast("long")), ["doc_id", "ticker"], "line_no")


def bonds(docs: DataFrame) -> DataFrame:
    """Government bonds stand between the two headings, corporate ones after the second."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gov, corp = r"(?i)a\.\s*Government bonds", r"(?i)b\.\s*Corporate bonds"
    split = docs.select("doc_id", F.split(text, corp, 2).alias("p"))
    gov_part = F.get(F.split(F.get("p", F.lit(0)), gov, 2), F.lit(1))
    parts = split.select("doc_id", gov_part.alias("text"), F.lit("TREASURY").alias("category")).unionByName(split.select("doc_id", F.get("p", F.lit(1)).alias("text"), F.lit("CORPORATE").alias("category")))
    rows = parts.filter("text IS NOT NULL").select("doc_id", "category", F.posexplode(F.split("text", r"\R")).alias("line_no", "line")).withColumn("line", S.strip(F.col("line")))
    line = F.col("line")
    security, reopened = _at(3), _at(2).isNotNull()
    return rows.filter(line.rlike(BOND_LINE)).withColumn("g", _groups(line, BOND_LINE, 10)).select(
        "doc_id", "category", "line_no", _at(1).alias("isin"), F.when(reopened, "Re-opened").alias("status"), security.alias("security"),
        F.when(reopened, F.concat(security, F.lit(" (Re-opened)"))).otherwise(security).alias("label"), S.parse_date(_at(4)).alias("maturity_date"),
        *[S.parse_number(_at(5 + i)).alias(f) for i, f in enumerate(("coupon_rate", "closing_price", "previous_price", "bids", "offers", "bond_traded"))],
        F.lit(None).cast("double").alias("yield_tm"),
    )


def indices(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines(docs).filter(line.rlike(INDEX_LINE) & _group(line, INDEX_LINE, 1).isin(*INDEX_NAMES))
    rows = rows.withColumn("g", _groups(line, INDEX_LINE, 5)).select("doc_id", "line_no", _at(1).alias("name"), *[S.parse_number(_at(2 + i)).alias(f) for i, f in enumerate(("previous", "today", "points_change", "percent_change"))])
    return first_seen(rows.withColumn("closing", F.coalesce("today", "previous")), ["doc_id", "name"], "line_no")


def find_index(index_rows: DataFrame, name: str) -> DataFrame:
    return index_rows.filter(F.upper("name") == name.upper())


def exchange_rates(docs: DataFrame) -> DataFrame:
    """Three numbers after a currency code: selling, buying, average."""
    # A match is a code and three amounts with white space between.
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RATE), F.lit(0))).alias("line_no", "m")).withColumn("g", F.split("m", r"\s+"))
    rows = rows.select("doc_id", "line_no", _at(1).alias("currency"), S.parse_number(_at(3)).alias("buying"), S.parse_number(_at(2)).alias("selling"), S.parse_number(_at(4)).alias("average"))
    return first_seen(rows.filter("buying IS NOT NULL AND selling IS NOT NULL"), ["doc_id", "currency"], "line_no")


def trading_stats(docs: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = lines(docs).filter(line.rlike(STAT_LINE)).withColumn("g", _groups(line, STAT_LINE, 5)).select("doc_id", "line_no", _at(1).alias("label"), *[S.parse_number(_at(2 + i)).alias(f) for i, f in enumerate(("previous", "today", "change", "percent_change"))])
    return first_seen(rows.withColumn("_key", F.lower("label")), ["doc_id", "_key"], "line_no").drop("_key")


def overview(docs: DataFrame) -> DataFrame:
    """One row a document: turnover, deals, capitalization and repo activity; amounts scale by their unit word."""
    t = F.coalesce(F.col("text"), F.lit(""))
    stats = trading_stats(docs).groupBy("doc_id").agg(*[F.max(F.when(F.lower("label") == k, F.col("today"))).alias(n) for k, n in (("equity turnover", "equity_turnover"), ("shares traded", "shares_traded"), ("number of deals", "equity_deals"))])
    # Each pattern goes over a text once; its groups are cut from what it found.
    found = {"b": (BOND_TURNOVER, 2), "m": (MARKET_CAP, 1), "d": (REPO_DEALS, 4), "r": (REPO_RATE, 1)}
    whole = docs.select("doc_id", *[F.regexp_extract(t, p, 0).alias(n) for n, (p, _) in found.items()])
    cut = whole.select("doc_id", *[_groups(F.col(n), p, k).alias(n) for n, (p, k) in found.items()])
    unit = F.lower(_at(3, "d"))
    scale = F.when(unit == "thousand", 1e3).when(unit == "million", 1e6).when(unit == "billion", 1e9).otherwise(1.0)
    number = lambda k, n: S.parse_number(_at(k, n))
    rest = cut.select(
        "doc_id", number(1, "b").alias("bond_turnover"), number(2, "b").cast("long").alias("bond_deals"), number(1, "m").alias("market_capitalization"),
        number(1, "d").cast("long").alias("repo_deals"), (number(2, "d") * scale).alias("repo_turnover"), S.clean_text(_at(4, "d")).alias("repo_tenor"), number(1, "r").alias("repo_rate"),
    )
    return rest.join(stats, "doc_id", "left").withColumn("equity_deals", F.col("equity_deals").cast("long"))


def titles(docs: DataFrame, filename: str | None = None) -> DataFrame:
    """(doc_id, report_title, report_date): the first line naming the exchange; the date from the text, else the file name."""
    t = F.coalesce(F.col("text"), F.lit(""))
    hits = F.filter(F.transform(F.split(t, r"\R"), lambda x: S.clean_text(x)), lambda x: F.upper(x).contains(EXCHANGE))
    words = F.concat_ws(" ", *[_group(t, TITLE_DATE, k) for k in (1, 2, 3)])
    day = S.parse_date(words)
    if filename:
        day = F.coalesce(day, S.parse_date(F.concat_ws("/", *[F.regexp_extract(filename, r"(\d{2})[-_](\d{2})[-_](\d{4})", k) for k in (1, 2, 3)])))
    return docs.select("doc_id", F.get(hits, F.lit(0)).alias("report_title"), day.alias("report_date"))


def is_market_report(source_type: Column, text: Column, sheets: Column) -> Column:
    """A pdf that names the exchange, or a workbook with two known sheets or more."""
    known = F.size(F.array_intersect(F.transform(sheets, lambda s: F.upper(F.trim(s))), F.array(*[F.lit(s) for s in SHEETS]))) >= 2
    return F.when(source_type == "pdf", F.upper(text).contains(EXCHANGE)).when(source_type == "excel", known).otherwise(F.lit(False))


# --- sheets: cells of one sheet (doc_id, source_row, column, position, value)


def _by_alias(cells: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc_id, source_row, v): the column of the first of the names that the document's header has."""
    low = F.lower(S.clean_text(F.col("column")))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), low)
    found = cells.withColumn("_o", order).filter("_o > 0")
    best = found.groupBy("doc_id").agg(F.min(F.struct("_o", "position")).alias("m"))
    return found.join(best, "doc_id").filter("_o = m._o AND position = m.position").select("doc_id", "source_row", F.col("value").alias("v"))


def sheet_table(cells: DataFrame, fields: dict[str, tuple[str, ...]], texts: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a sheet by field, each field from the first of its header names that is there; numbers unless named otherwise."""
    out = cells.select("doc_id", "source_row").distinct()
    for field, names in fields.items():
        parse = S.clean_text if field in texts else S.parse_date if field in dates else S.parse_number
        out = out.join(_by_alias(cells, names).select("doc_id", "source_row", parse(F.col("v")).alias(field)), ["doc_id", "source_row"], "left")
    return out


def sheet_equities(cells: DataFrame) -> DataFrame:
    return sheet_table(cells, STOCK_ALIASES, texts=("ticker",)).filter("ticker IS NOT NULL")


def sheet_bonds(cells: DataFrame) -> DataFrame:
    fields = {"isin": ("isin",), "security": ("security", "bond"), "category": ("category", "type"), "coupon_rate": ("coupon", "coupon rate"), "closing_price": ("closing", "close", "closing price"), "previous_price": ("previous", "previous price"), "maturity_date": ("maturity", "maturity date"), "bond_traded": ("bond traded", "traded", "volume"), "yield_tm": ("yield", "yield tm", "ytm")}
    rows = sheet_table(cells, fields, texts=("isin", "security", "category"), dates=("maturity_date",))
    return rows.withColumn("category", F.when(F.lower("category").contains("corp"), "CORPORATE").otherwise("TREASURY"))


def sheet_exchange_rates(cells: DataFrame) -> DataFrame:
    rows = sheet_table(cells, {"currency": ("currency", "code"), "buying": ("buying", "buy"), "selling": ("selling", "sell")}, texts=("currency",))
    return rows.withColumn("average", F.bround((F.col("buying") + F.col("selling")) / 2, 4)).filter("currency IS NOT NULL")


def sheet_stats(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overview fields by label, index rows) of the market stats sheet: label and value columns."""
    rows = cells.groupBy("doc_id", "source_row").agg(F.min_by(S.clean_text(F.col("value")), "position").alias("label"), F.max(F.when(F.col("position") == 1, S.parse_number(F.col("value")))).alias("value"))
    names = {"equity turnover": "equity_turnover", "shares traded": "shares_traded", "number of deals": "equity_deals", "market capitalization": "market_capitalization", "bond turnover": "bond_turnover"}
    fields = rows.groupBy("doc_id").agg(*[F.max(F.when(F.lower("label") == k, F.col("value"))).alias(v) for k, v in names.items()])
    return fields, rows.filter(F.col("label").rlike(r"^[A-Z0-9]{2,10}$") & F.col("value").isNotNull()).select("doc_id", F.col("label").alias("name"), F.col("value").alias("closing"))


# --- validation: each returns its rows with an array of warnings; dropped rows are gone


def _warned(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    return rows.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in rules])))


def validate_equities(rows: DataFrame) -> DataFrame:
    kept = _warned(rows.filter("ticker IS NOT NULL AND ticker <> ''"), (F.col("closing").isNull(), "no closing price"), (F.col("volume") < 0, "negative volume taken as unknown"))
    return kept.withColumn("volume", F.when(~(F.col("volume") < 0), F.col("volume")))


def validate_indices(rows: DataFrame) -> DataFrame:
    return rows.filter("name IS NOT NULL AND name <> '' AND closing IS NOT NULL")


def validate_bonds(rows: DataFrame) -> DataFrame:
    odd = ~F.col("coupon_rate").between(0, 100)
    kept = _warned(rows.filter("coalesce(security, isin, '') <> ''"), (odd, "implausible coupon rate taken as unknown"), (F.col("closing_price").isNull(), "no closing price"))
    return kept.withColumn("coupon_rate", F.when(~odd, F.col("coupon_rate")))


def validate_trades(rows: DataFrame) -> DataFrame:
    return rows.filter("bond IS NOT NULL AND bond <> '' AND volume > 0")


def validate_rates(rows: DataFrame) -> DataFrame:
    gaps = F.col("buying").isNull() | F.col("selling").isNull()
    low = ~gaps & ((F.col("buying") <= 0) | (F.col("selling") <= 0))
    kept = _warned(rows.filter("currency IS NOT NULL AND currency <> ''"), (gaps, "incomplete"), (low, "non-positive value taken as unknown"), (~gaps & ~low & (F.col("buying") > F.col("selling")), "buying above selling"))
    kept = kept.withColumn("_low", F.coalesce(low, F.lit(False)))
    for c in ("buying", "selling", "average"):
        kept = kept.withColumn(c, F.when(~F.col("_low"), F.col(c)))
    return kept.drop("_low")


def validate_overview(rows: DataFrame) -> DataFrame:
    for c in ("equity_turnover", "shares_traded", "bond_turnover", "market_capitalization", "repo_turnover"):
        rows = rows.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    return rows.withColumn("repo_rate", F.when(F.col("repo_rate").between(0, 100), F.col("repo_rate")))


def document_status(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """(doc_id, status): failed where none of the parts has a row of the document."""
    found = union([p.select("doc_id") for p in parts]).distinct().withColumn("_f", F.lit(True))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.when(F.col("_f"), "completed").otherwise("failed").alias("status"))


# --- what follows from the tables


def all_bonds(government: DataFrame, corporate: DataFrame) -> DataFrame:
    return government.unionByName(corporate)


def derive_trades(bond_rows: DataFrame) -> DataFrame:
    """A trade for each bond with traded volume; change is rounded to six places."""
    return bond_rows.filter("bond_traded IS NOT NULL AND bond_traded <> 0").select("doc_id", F.col("label").alias("bond"), "category", F.col("bond_traded").alias("volume"), F.col("previous_price").alias("previous"), F.col("closing_price").alias("closing"), F.bround(F.col("closing_price") - F.col("previous_price"), 6).alias("change"))


def rankings(equity_rows: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, ranking, rank, ticker, value): gainers, losers, volume and turnover; rows without the figure take no part."""

    def one(name: str, c: str, down: bool) -> DataFrame:
        w = W.partitionBy("doc_id").orderBy(F.col(c).desc() if down else F.col(c).asc(), "ticker")
        return equity_rows.filter(F.col(c).isNotNull()).select("doc_id", F.lit(name).alias("ranking"), F.row_number().over(w).alias("rank"), "ticker", F.col(c).cast("double").alias("value")).filter(F.col("rank") <= most)

    return union([one("gainers", "change", True), one("losers", "change", False), one("volume", "volume", True), one("value", "value", True)])


def movers(table: DataFrame, keys: list[str], name: str, change: str, volume: str, most: int = 8) -> DataFrame:
    """(keys, list, rank, name, value): largest moves up or down, and most traded; nothing without a move or volume."""

    def one(kind: str, value: Column, where: Column) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(F.abs("value").desc(), "name")
        rows = table.filter(where).select(*keys, F.lit(kind).alias("list"), F.col(name).alias("name"), value.alias("value"))
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)

    return union([one("movers", F.col(change).cast("double"), F.col(change) != 0), one("active", F.col(volume).cast("double"), F.col(volume) > 0)])


def market_insights(equity_rows: DataFrame, index_rows: DataFrame, bond_rows: DataFrame, overview_rows: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, insight_no, text): top gainer and decliner, most active, index moves, top yield, capitalization, turnover."""

    def said(rows: DataFrame, no: int, text: Column) -> DataFrame:
        return rows.select("doc_id", F.lit(no).alias("no"), text.alias("text"))

    n = S.format_number
    eq = equity_rows.filter("change IS NOT NULL").groupBy("doc_id").agg(F.max_by("ticker", "change").alias("up"), F.max("change").alias("up_by"), F.min_by("ticker", "change").alias("down"), F.min("change").alias("down_by"))
    active = equity_rows.filter("volume > 0").groupBy("doc_id").agg(F.max_by("ticker", "volume").alias("t"), F.max("volume").alias("v"))
    ytm = bond_rows.filter("yield_tm IS NOT NULL").groupBy("doc_id").agg(F.max_by("label", "yield_tm").alias("t"), F.max("yield_tm").alias("v"))
    found = union([
        said(eq.filter("up_by > 0"), 1, F.concat("up", F.lit(" gained the most ("), n(F.col("up_by")), F.lit(")."))),
        said(eq.filter("down_by < 0 AND down <> up"), 2, F.concat("down", F.lit(" fell the most ("), n(F.col("down_by")), F.lit(")."))),
        said(active, 3, F.concat("t", F.lit(" was traded the most ("), n(F.col("v").cast("double")), F.lit(" shares)."))),
        said(index_rows.filter("percent_change IS NOT NULL"), 4, F.concat("name", F.lit(" moved "), S.format_percent(F.col("percent_change")), F.lit("."))),
        said(ytm, 5, F.concat("t", F.lit(" has the top yield ("), S.format_percent(F.col("v")), F.lit(")."))),
        said(overview_rows.filter("market_capitalization IS NOT NULL"), 6, F.concat(F.lit("Market capitalization is "), n(F.col("market_capitalization")), F.lit("."))),
        said(overview_rows.filter("equity_turnover IS NOT NULL"), 7, F.concat(F.lit("Equity turnover is "), n(F.col("equity_turnover")), F.lit("."))),
    ])
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("no", "text"))
    return found.withColumn("insight_no", rank).filter(F.col("insight_no") <= most).select("doc_id", "insight_no", "text")


def headline_value(overview_rows: DataFrame) -> DataFrame:
    return overview_rows.select("doc_id", F.coalesce("market_capitalization", "equity_turnover", "bond_turnover").alias("headline_value"))


def to_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """Market tables (doc_id, ...) as cells, each a dataset of its document, for the general analyses."""
    out = []
    for name, t in tables.items():
        columns = [c for c in t.columns if c not in ("doc_id", "line_no", "warnings")]
        parts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
        order = F.row_number().over(W.partitionBy("doc_id").orderBy(*columns)) + 1
        rows = t.withColumn("source_row", order.cast("long")).select("doc_id", F.lit(name).alias("dataset"), "source_row", F.explode(parts).alias("c"))
        out.append(rows.select("doc_id", "dataset", "c.column", "c.position", "source_row", "c.value"))
    return union(out)
