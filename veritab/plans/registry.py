"""Registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.functions import words as T
from veritab.operators import catalog as C
from veritab.operators import findings as G
from veritab.operators import market as M
from veritab.operators import profile as P
from veritab.operators import retrieve as R
from veritab.operators import search as Q
from veritab.operators import shape as H
from veritab.sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function by its name, with its twin if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- profiles


def _profile_sql(source: str, columns: list[str]) -> str:
    """The profile's rules over every column as text."""
    has = lambda hints: "(" + " OR ".join(f"contains(lower(c), '{h}')" for h in hints) + ")"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS p, nullif(trim(regexp_replace(CAST({c} AS VARCHAR), '\\s+', ' ', 'g')), '') AS v FROM {source}" for i, c in enumerate(columns))
    return rf"""
WITH cells AS ({rows}),
parsed AS (SELECT c, v,
  CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(\.[0-9]+)?$') THEN TRY_CAST(v AS DOUBLE) END AS n,
  regexp_matches(v, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}([T ]\d{{2}}:\d{{2}}.*)?$') AS d,
  lower(v) IN ('true','false','yes','no','y','n','0','1','active','inactive') AS b FROM cells),
agg AS (SELECT c, count(*) AS total_count, count(v) AS nn, count(n) AS num, count(*) FILTER (d) AS dat, count(*) FILTER (b) AS boo,
  count(DISTINCT lower(v)) AS u, count(DISTINCT n) AS un, avg(length(v)) AS len, min(n) AS lo, max(n) AS hi, avg(n) AS mean, stddev_pop(n) AS std,
  count(*) FILTER (n < 0) AS neg FROM parsed GROUP BY c),
t AS (SELECT *, CASE WHEN nn = 0 THEN 'text'
  WHEN dat / nn >= 0.8 AND (num / nn < 0.8 OR {has(S.DATE_HINTS)}) THEN 'date'
  WHEN boo = nn AND u <= 2 THEN 'boolean'
  WHEN num / nn >= 0.8 AND {has(S.PERCENT_HINTS)} THEN 'percentage'
  WHEN num / nn >= 0.8 AND {has(S.CURRENCY_HINTS)} THEN 'currency'
  WHEN num / nn >= 0.8 AND {has(S.QUANTITY_HINTS)} THEN 'quantity'
  WHEN {has(S.IDENTIFIER_HINTS)} AND u / nn > 0.9 THEN 'identifier'
  WHEN num / nn >= 0.8 THEN 'number'
  WHEN u / nn > 0.95 AND nn > 5 THEN 'identifier'
  WHEN u <= greatest(20, nn * 0.5) AND len <= 40 THEN 'category' ELSE 'text' END AS semantic_type FROM agg)
SELECT c AS "column", semantic_type, nn AS non_null_count, total_count,
  CASE WHEN semantic_type IN ('currency','number','quantity','percentage') THEN un WHEN semantic_type IN ('identifier','category') THEN u ELSE 0 END AS unique_count,
  CASE WHEN semantic_type IN ('currency','number','quantity','percentage') THEN round(lo, 4) END AS min,
  CASE WHEN semantic_type IN ('currency','number','quantity','percentage') THEN round(hi, 4) END AS max,
  CASE WHEN semantic_type IN ('currency','number','quantity','percentage') THEN round(mean, 4) END AS mean,
  CASE WHEN semantic_type IN ('currency','number','quantity','percentage') THEN round(std, 3) END AS std,
  CASE WHEN semantic_type IN ('currency','number','quantity','percentage') THEN neg ELSE 0 END AS negative_count
FROM t"""


def _profile(t: DataFrame, name: str, row: str) -> DataFrame:
    cells = P.to_cells(t.withColumn("_row", F.col(row)), name, "_row", t.columns)
    r = lambda c, k: F.round(F.col(c), k).alias(c)
    return P.profile(cells).select("column", "semantic_type", "non_null_count", "total_count", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), r("min", 4), r("max", 4), r("mean", 4), r("std", 3), F.coalesce("negative_count", F.lit(0)).alias("negative_count"))


@query(_profile_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def profile_orders(spark, sf_dir):
    return _profile(table(spark, sf_dir, "orders"), "orders", "o_orderkey")


@query(_profile_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))
def profile_parts(spark, sf_dir):
    return _profile(table(spark, sf_dir, "part"), "part", "p_partkey")


@query(_profile_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def profile_customers(spark, sf_dir):
    return _profile(table(spark, sf_dir, "customer"), "customer", "c_custkey")


@query("""SELECT count(*) AS row_count, count(DISTINCT (coalesce(t, ''), coalesce(lang, ''))) AS distinct_rows, count(*) - count(DISTINCT (coalesce(t, ''), coalesce(lang, ''))) AS duplicate_rows
FROM (SELECT nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS t, lang FROM documents)""")
def duplicate_documents(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("SELECT l_orderkey, l_partkey, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return P.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


# --- metrics, quality, validation


def _line_cells(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumn("_row", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return P.to_cells(t, "lineitem", "_row", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""SELECT 'Total l_quantity' AS label, round(sum(l_quantity), 2) AS value, 'sum' AS kind, count(l_quantity) AS included_row_count FROM lineitem
UNION ALL SELECT 'Total l_extendedprice', round(sum(l_extendedprice), 2), 'sum', count(l_extendedprice) FROM lineitem
UNION ALL SELECT 'Total l_discount', round(sum(l_discount), 2), 'sum', count(l_discount) FROM lineitem
UNION ALL SELECT 'Total l_tax', round(sum(l_tax), 2), 'sum', count(l_tax) FROM lineitem
UNION ALL SELECT 'Records in lineitem', count(*)::DOUBLE, 'count', count(*) FROM lineitem""")
def metrics_lineitem(spark, sf_dir):
    cells = _line_cells(spark, sf_dir)
    rows = cells.groupBy(*P.KEY).agg(F.count_if(F.col("position") == 0).alias("row_count"))
    m = G.metrics(P.profile(cells), rows)
    return m.select("label", F.round("value", 2).alias("value"), "kind", "included_row_count")


@query("""SELECT CAST(round(least(1, greatest(0, 1 - avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END) - least((SELECT (count(*) - count(DISTINCT customer)) / count(*) FROM customer), 0.3))) * 100) AS INTEGER) AS quality_score,
 CAST(count(*) AS BIGINT) AS total_cells, CAST(count(*) - count(v) AS BIGINT) AS missing_cells, (SELECT count(*) - count(DISTINCT customer) FROM customer) AS duplicate_rows
FROM (SELECT unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS v FROM customer)""")
def quality_customer(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    cells = P.to_cells(t.withColumn("_row", F.col("c_custkey")), "customer", "_row", t.columns)
    scores, _ = G.quality(cells, P.profile(cells), G.dataset_counts(cells))
    return scores.select("quality_score", "total_cells", "missing_cells", "duplicate_rows")


_TOTALS = """WITH s AS (SELECT c_mktsegment AS label, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment, c_nationkey),
r AS (SELECT label, v FROM s UNION ALL SELECT 'Total', round((SELECT sum(v) FROM s) * 1.05 + 10, 2))"""


def _totals_table(spark, sf_dir) -> DataFrame:
    """Balances by segment and nation, and a declared total row that is off by five percent and ten."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    whole = s.agg(F.lit("Total").alias("segment"), F.lit(-1).alias("nation"), F.round(F.sum("balance") * 1.05 + 10, 2).alias("balance"))
    rows = s.unionByName(whole).select("segment", "nation", F.col("balance").cast("decimal(20,2)").alias("balance"))
    return rows.withColumn("_row", F.when(F.col("segment") == "Total", F.lit(1 << 40)).otherwise(F.pmod(F.xxhash64("segment", "nation"), F.lit(1 << 39))))


@query(_TOTALS + " SELECT 'Total' AS label, round((SELECT v FROM r WHERE label = 'Total'), 2) AS claimed, round((SELECT sum(v) FROM r WHERE label <> 'Total'), 2) AS computed")
def totals_reconcile(spark, sf_dir):
    cells = P.to_cells(_totals_table(spark, sf_dir), "balances", "_row", ["segment", "balance"])
    found = G.total_mismatches(cells, P.profile(cells))
    return found.select("label", F.round("claimed", 2).alias("claimed"), F.round("computed", 2).alias("computed"))


@query(_TOTALS + " SELECT 'balance' AS \"column\", round((SELECT v FROM r WHERE label = 'Total'), 2) AS declared, round((SELECT sum(v) FROM r WHERE label <> 'Total'), 2) AS computed")
def totals_declared(spark, sf_dir):
    cells = P.to_cells(_totals_table(spark, sf_dir), "balances", "_row", ["segment", "balance"])
    found = G.mismatched_totals(cells, P.profile(cells))
    return found.select("column", F.round("value", 2).alias("declared"), F.round("score", 2).alias("computed"))


# --- anomalies and insights


@query("""WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, round(abs(l_extendedprice - m) / sd, 4) AS z FROM lineitem JOIN s USING (l_returnflag) WHERE sd > 0 AND abs(l_extendedprice - m) / sd > 1.5""")
def outliers_lineitem(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return G.group_outliers(t, ["l_returnflag"], "l_extendedprice", 1.5).select("l_orderkey", "l_linenumber", "l_returnflag", F.round("z", 4).alias("z"))


@query("""WITH p AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
SELECT user_id, event_id, round((value - prev_value) / abs(prev_value), 6) AS change, CASE WHEN abs((value - prev_value) / abs(prev_value)) >= 1 THEN 'high' ELSE 'medium' END AS severity
FROM p WHERE prev_value <> 0 AND abs((value - prev_value) / abs(prev_value)) >= 0.5""")
def period_jumps_events(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return G.jumps(t, ["user_id"], "ts", "value", "event_id").select("user_id", "event_id", F.round("change", 6).alias("change"), "severity")


@query("""WITH p AS (SELECT event_id, value, lag(value) OVER (ORDER BY ts, event_id) AS prev_value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
SELECT event_id, round((value - prev_value) / abs(prev_value), 6) AS change FROM p WHERE prev_value <> 0 AND abs((value - prev_value) / abs(prev_value)) >= 0.5""")
def period_jumps_all(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return G.jumps(t, [], "ts", "value", "event_id").select("event_id", F.round("change", 6).alias("change"))


@query("""WITH p AS (SELECT o_custkey, o_totalprice AS v, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS x FROM orders),
f AS (SELECT o_custkey, count(*) AS points, regr_slope(v, x) AS slope, avg(v) AS m FROM p GROUP BY 1 HAVING count(*) >= 3)
SELECT o_custkey, points, round(slope, 6) AS slope, CASE WHEN slope * points / m > 0.08 THEN 'increased' WHEN slope * points / m < -0.08 THEN 'decreased' ELSE 'flat' END AS direction FROM f""")
def trend_by_customer(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return G.trends(t, ["o_custkey"], "o_orderdate", "o_totalprice", "o_orderkey").select("o_custkey", "points", F.round("slope", 6).alias("slope"), "direction")


@query("""WITH s AS (SELECT o_orderpriority, c_mktsegment, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT o_orderpriority, arg_max(c_mktsegment, s) AS leader, round(max(s), 2) AS leader_total, arg_min(c_mktsegment, s) AS trailer, round(min(s), 2) AS trailer_total FROM s GROUP BY 1 HAVING count(*) >= 2""")
def leaders_by_group(spark, sf_dir):
    t = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    got = G.leaders(t, ["o_orderpriority"], "c_mktsegment", "o_totalprice")
    return got.select("o_orderpriority", "leader", F.round("leader_total", 2).alias("leader_total"), "trailer", F.round("trailer_total", 2).alias("trailer_total"))


@query("""SELECT l_returnflag, 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS pairs, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem GROUP BY 1""")
def correlations_lineitem(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    got = G.correlations(t, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])
    return got.select("l_returnflag", "a", "b", "pairs", F.round("r", 6).alias("r"))


@query("""WITH e AS (SELECT least('p_brand:' || p_brand, 'p_type:' || p_type) AS source, greatest('p_brand:' || p_brand, 'p_type:' || p_type) AS target, count(*) AS weight FROM part GROUP BY ALL),
n AS (SELECT id, sum(weight) AS weight FROM (SELECT source AS id, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY 1),
t AS (SELECT id FROM n QUALIFY row_number() OVER (ORDER BY weight DESC, id) <= 30),
k AS (SELECT * FROM e WHERE source IN (FROM t) AND target IN (FROM t))
SELECT source, target, weight, row_number() OVER (ORDER BY weight DESC, source, target)::INTEGER AS rank FROM k QUALIFY rank <= 40""")
def cooccurrence_parts(spark, sf_dir):
    return G.cooccurrence(table(spark, sf_dir, "part").select("p_brand", "p_type"), [], "p_brand", "p_type")[1].select("source", "target", "weight", "rank")


@query("""WITH r AS (SELECT * FROM (VALUES ('l_quantity', 'gt', 1000.0), ('l_discount', 'lt', 1.0), ('l_extendedprice', 'gte', 1e15), ('l_tax', 'lte', 1e12), ('l_none', 'gt', 0.0)) AS v("column", operator, threshold)),
t AS (SELECT 'l_quantity' AS c, sum(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_discount', sum(l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', sum(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_tax', sum(l_tax) FROM lineitem)
SELECT "column", operator, round(v, 2) AS value, coalesce(CASE operator WHEN 'gt' THEN v > threshold WHEN 'gte' THEN v >= threshold WHEN 'lt' THEN v < threshold ELSE v <= threshold END, false) AS triggered FROM r LEFT JOIN t ON r."column" = t.c""")
def alerts_eval(spark, sf_dir):
    rules = spark.createDataFrame([("l_quantity", "gt", 1000.0), ("l_discount", "lt", 1.0), ("l_extendedprice", "gte", 1e15), ("l_tax", "lte", 1e12), ("l_none", "gt", 0.0)], "column string, operator string, threshold double")
    cells = _line_cells(spark, sf_dir)
    totals = G.column_totals(cells, P.profile(cells)).select("column", "total")
    return G.evaluate_alerts(rules, totals, ["column"]).select("column", "operator", F.round("value", 2).alias("value"), "triggered")


@query("""SELECT lower(n_name) AS place, n_name AS label, CAST(n_regionkey AS DOUBLE) AS lat, CAST(n_nationkey AS DOUBLE) AS lon, round(sum(c_acctbal), 2) AS total, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey, n_nationkey ORDER BY sum(c_acctbal) DESC LIMIT 60""")
def geo_totals(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    places = nation.select(F.lower("n_name").alias("place"), F.col("n_regionkey").cast("double").alias("lat"), F.col("n_nationkey").cast("double").alias("lon"))
    t = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    got = G.place_totals(t, F.col("n_name"), F.col("c_acctbal"), places)
    return got.select("place", "label", "lat", "lon", F.round("total", 2).alias("total"), "n")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def chart_points(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return G.chart_points(t, F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice").cast("decimal(20,2)")).select("x", F.round("y", 2).alias("y"))


@query("""WITH m AS (SELECT label, pct, value FROM (SELECT 'orders' AS label, sum(o_totalprice) AS value FROM orders), (SELECT unnest([-50.0, -10.0, 0.0, 20.0]) AS pct))
SELECT label, pct::DOUBLE AS pct, round(value * (1 + pct / 100), 3) AS projected FROM m""")
def what_if(spark, sf_dir):
    m = table(spark, sf_dir, "orders").agg(F.lit("orders").alias("label"), F.sum("o_totalprice").alias("value"))
    return G.project(m, [-50, -10, 0, 20, 80]).select("label", "pct", F.round("projected", 3).alias("projected"))


@query("""SELECT p_brand, rank, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part) WHERE rank <= 10""")
def top_parts(spark, sf_dir):
    return C.top_by(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_brand", "rank", "p_partkey", "p_retailprice")


@query("""WITH t AS (SELECT n_name AS grp, s_name AS name, s_acctbal AS change, CAST(floor(abs(s_acctbal)) AS BIGINT) AS volume FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT grp, 'movers' AS list, name, change AS value, row_number() OVER (PARTITION BY grp ORDER BY abs(change) DESC, name)::INTEGER AS rank FROM t WHERE change <> 0),
b AS (SELECT grp, 'active' AS list, name, volume::DOUBLE AS value, row_number() OVER (PARTITION BY grp ORDER BY abs(volume) DESC, name)::INTEGER AS rank FROM t WHERE volume > 0)
SELECT * FROM a WHERE rank <= 8 UNION ALL SELECT * FROM b WHERE rank <= 8""")
def top_movers(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    t = t.select(F.col("n_name").alias("grp"), "s_name", F.col("s_acctbal").alias("change"), F.floor(F.abs("s_acctbal")).alias("volume"))
    return M.movers(t, ["grp"], "s_name", "change", "volume").select("grp", "list", "name", "value", "rank")


# --- versions and the catalog


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return t.filter("o_orderstatus <> 'P'"), t.filter("o_orderstatus <> 'F'")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F')
SELECT (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS rows_added, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS rows_removed, false AS unchanged""")
def version_diff(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    return C.version_diff(a, b, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("""WITH a AS (SELECT o_orderpriority AS label, count(*)::DOUBLE AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS label, count(*)::DOUBLE AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT label, a.v AS before, b.v AS after, b.v - a.v AS delta, round((b.v - a.v) / abs(nullif(a.v, 0)) * 100, 6) AS percent FROM a FULL JOIN b USING (label)""")
def metric_diff(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    side = lambda s: t.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return C.compare_metrics(side("F"), side("O")).withColumn("percent", F.round("percent", 6))


@query("""WITH a AS (SELECT 'a' AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 1),
b AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, o_orderkey, o_orderpriority FROM orders),
u AS (SELECT dataset, o_orderkey, bool_or(s = 1) AS x, bool_or(s = 2) AS y FROM (SELECT dataset, o_orderkey, 1 AS s FROM a UNION ALL SELECT dataset, o_orderkey, 2 FROM b) GROUP BY ALL)
SELECT dataset, CASE WHEN count(*) FILTER (x <> y) > 0 THEN 'changed' ELSE 'unchanged' END AS status, count(*) FILTER (y AND NOT x) AS rows_added, count(*) FILTER (x AND NOT y) AS rows_removed FROM u GROUP BY 1""")
def dataset_diff(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").withColumn("even", F.col("o_orderkey") % 2 == 0)

    def cells(rows: DataFrame) -> DataFrame:
        both = [P.to_cells(rows.filter(F.col("even") == e).withColumn("_row", F.col("o_orderkey")), n, "_row", ["o_orderkey", "o_orderpriority"]) for e, n in ((True, "even"), (False, "odd"))]
        return both[0].unionByName(both[1])

    return C.compare_datasets(cells(t.filter("o_orderstatus <> 'P' OR NOT even")), cells(t))


def _catalog(spark, sf_dir) -> DataFrame:
    """Documents as catalog entries: two owners, dates from their ids."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id"), (F.col("doc_id") % 2).alias("user_id"), F.concat(F.lit("File_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("source").alias("source_type"), F.lit("completed").alias("status"),
        F.lit(None).cast("date").alias("report_date"), F.date_add(F.lit("2020-01-01"), (F.col("doc_id") % 2000).cast("int")).alias("created_at"), F.col("lang").alias("document_type"), F.col("n_chars").cast("double").alias("headline_value"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"),
    )


@query("""SELECT doc_id, 'File_' || doc_id || '.txt' AS filename, n_chars::DOUBLE AS headline_value FROM documents
WHERE contains('file_' || doc_id || '.txt', '1') AND lang = 'en' AND year(DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER)) = 2021 ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20""")
def catalog_page(spark, sf_dir):
    rows = C.catalog_filter(_catalog(spark, sf_dir), search="1", status="completed", year=2021, document_type="en")
    return C.page(rows, C.catalog_sort(rows, "-value"), 2, 20)[0].select("doc_id", "filename", "headline_value")


@query("""SELECT (SELECT string_agg(y, ',' ORDER BY y DESC) FROM (SELECT DISTINCT year(DATE '2020-01-01' + CAST(doc_id % 2000 AS INTEGER))::VARCHAR AS y FROM documents)) AS years,
(SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM documents)) AS source_types, (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT DISTINCT lang AS l FROM documents WHERE lang <> '')) AS document_types""")
def catalog_facets(spark, sf_dir):
    f = C.facets(_catalog(spark, sf_dir))
    return f.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in f.columns])


@query("""SELECT user_id, file_hash, doc_id FROM (SELECT doc_id % 2 AS user_id, sha256(coalesce(text, '')) AS file_hash, doc_id,
row_number() OVER (PARTITION BY doc_id % 2, sha256(coalesce(text, '')) ORDER BY doc_id % 2000 DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def latest_by_hash(spark, sf_dir):
    return C.latest_by_hash(_catalog(spark, sf_dir)).select("user_id", "file_hash", "doc_id")


@query("""SELECT count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 = 0) AS deleted, count(*) FILTER (NOT (doc_id % 2 = 0 AND doc_id % 3 = 0)) AS kept FROM documents""")
def bulk_delete(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    gone, kept, _ = C.bulk_delete(cat, {}, cat.filter("doc_id % 3 = 0").select("doc_id"), user_id=0)
    sides = gone.select(F.lit(True).alias("gone")).unionByName(kept.select(F.lit(False).alias("gone")))
    return sides.agg(F.count_if("gone").alias("deleted"), F.count_if(~F.col("gone")).alias("kept"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg')")
def row_search(spark, sf_dir):
    return C.row_search(table(spark, sf_dir, "orders"), "URG", ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "o_orderpriority")


# --- text


@query(r"""WITH w AS (SELECT doc_id, lower(unnest(l)) AS keyword, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''-]{2,}') AS l FROM documents)),
c AS (SELECT doc_id, keyword, count(*) AS count, min(pos) AS p FROM w WHERE keyword NOT IN (STOP) GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, keyword, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, p)::INTEGER AS rank FROM c QUALIFY rank <= 10""".replace("STOP", ", ".join(f"'{w}'" for w in T.PROSE_STOPWORDS)))
def keywords(spark, sf_dir):
    return T.keywords(table(spark, sf_dir, "documents"))


_CLASS_SQL = ", ".join(f"{{'n': {' + '.join(f'CAST(contains(t, $q${w}$q$) AS INTEGER)' for w in ws)}, 'o': {-i}, 'l': '{k}'}}" for i, (k, ws) in enumerate(T.CLASS_WORDS.items()))


@query(f"""WITH s AS (SELECT doc_id, list_reverse_sort([{_CLASS_SQL}]) AS r FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))
SELECT doc_id, CASE WHEN r[1].n = 0 THEN 'General dataset' WHEN r[1].n >= 2 AND r[1].n = r[2].n THEN 'General business' ELSE r[1].l END AS document_type,
CASE WHEN r[1].n = 0 THEN 'low' WHEN r[1].n < 2 OR r[1].n = r[2].n THEN 'medium' ELSE 'high' END AS confidence FROM s""")
def classify(spark, sf_dir):
    label, confidence = T.classify(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("document_type"), confidence.alias("confidence"))


def _mentions_sql(patterns, most: int) -> str:
    found = "list_concat(" + ", ".join(f"regexp_extract_all(t, '{p}')" for p in patterns) + ")"
    return f"(SELECT list_filter(m, lambda x, i: list_position(list_transform(m, lambda y: lower(y)), lower(x)) = i)[:{most}] FROM (SELECT list_transform({found}, lambda x: trim(x)) AS m))"


_NUMBERS_SQL = _mentions_sql((T.CURRENCY_MENTION, T.PERCENT_MENTION, T.LARGE_NUMBER), 12)
_DATES_SQL = _mentions_sql((T.FULL_DATE, T.MONTH_YEAR, T.NUMERIC_DATE, T.QUARTER), 8)
_KEYWORDS_SQL = r"""w AS (SELECT doc_id, lower(unnest(l)) AS keyword, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''-]{2,}') AS l FROM documents)),
c AS (SELECT doc_id, keyword, count(*) AS count, min(pos) AS p FROM w WHERE keyword NOT IN (STOP) GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, p) AS rank FROM c QUALIFY rank <= 10)""".replace("STOP", ", ".join(f"'{w}'" for w in T.PROSE_STOPWORDS))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, array_to_string({_NUMBERS_SQL}, '|') AS numbers, array_to_string({_DATES_SQL}, '|') AS dates FROM d""")
def entities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.extract_numbers(F.col("text")), "|").alias("numbers"), F.array_join(T.extract_dates(F.col("text")), "|").alias("dates"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def json_props(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("text"))
    records, _ = readers.read_json_lines(lines, "k long")
    return H.flatten(records).select(F.col("doc_id").alias("event_id"), "k")


_RUNS_SQL = r"""WITH l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]') AS l FROM documents)),
d AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN NULL WHEN contains(line, ',') THEN ',' WHEN contains(line, chr(9)) THEN chr(9) WHEN contains(line, ';') THEN ';' WHEN contains(line, '|') THEN '|' END AS dl, regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'g') AS bare FROM l),
f AS (SELECT *, CASE WHEN dl IS NOT NULL THEN length(bare) - length(replace(bare, dl, '')) + 1 END AS n FROM d),
g AS (SELECT *, coalesce(dl = lag(dl) OVER w AND n = lag(n) OVER w, false) AS same FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM g),
t AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS len FROM r)"""


@query(_RUNS_SQL + """
SELECT doc_id, CAST(run AS VARCHAR) AS table_id, (row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) - 1)::INTEGER AS row_no, n::INTEGER AS n_cells FROM t WHERE dl IS NOT NULL AND len >= 3 AND n >= 2""")
def table_runs(spark, sf_dir):
    return H.table_runs(H.text_lines(table(spark, sf_dir, "documents")))[0].select("doc_id", "table_id", "row_no", F.size("cells").alias("n_cells"))


@query(_RUNS_SQL + r""",
p AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM t WHERE NOT coalesce(dl IS NOT NULL AND len >= 3 AND n >= 2, false)),
b AS (SELECT *, coalesce(lag(t) OVER w = '', true) AS pb, coalesce(lead(t) OVER w = '', true) AS nb FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT *, pb AND nb AND length(t) <= 80 AND NOT regexp_matches(t, '[.?!,:;]$') AS heading FROM b WHERE t <> ''),
k AS (SELECT *, sum(CASE WHEN pb THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM h),
s AS (SELECT doc_id, part, bool_or(heading) AS heading, string_agg(t, chr(10) ORDER BY line_no) AS content FROM k GROUP BY ALL),
u AS (SELECT *, CASE WHEN lag(heading) OVER w THEN lag(content) OVER w END AS title FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY part))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part)::INTEGER AS section_no, title, content FROM u WHERE NOT heading""")
def sections(spark, sf_dir):
    prose = H.table_runs(H.text_lines(table(spark, sf_dir, "documents")))[1]
    return H.sections(prose)


@query("""WITH m AS (SELECT conv_id, turn, role, substr(text, 1, 1200) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS b FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY b DESC)::INTEGER AS place FROM m WHERE b <= 8""")
def recent_turns(spark, sf_dir):
    return R.recent_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", "place")


_WINDOW = "reverse(substr(t, p + 1, 1200))"
_BACK = f"greatest(CASE WHEN instr({_WINDOW}, chr(10)) > 0 THEN 1200 - instr({_WINDOW}, chr(10)) ELSE -1 END, CASE WHEN instr({_WINDOW}, ' .') > 0 THEN 1199 - instr({_WINDOW}, ' .') ELSE -1 END)"
_TO = f"(CASE WHEN length(t) - p <= 1200 THEN length(t) WHEN {_BACK} > 600 THEN p + {_BACK} + 1 ELSE p + 1200 END)"
_TRIM = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, {_TRIM.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, 0::BIGINT AS p, 1 AS no FROM d WHERE t <> '' UNION ALL SELECT doc_id, t, greatest(p + 1, {_TO} - 150), no + 1 FROM w WHERE {_TO} < length(t)),
c AS (SELECT doc_id, no, {_TRIM.format(f"substr(t, p + 1, {_TO} - p)")} AS content FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no)::INTEGER AS chunk_no, content FROM c WHERE content <> ''""")
def chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("section_no"), F.lit(None).cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return R.build_chunks([R.section_chunks(d)], most=None).select("doc_id", "chunk_no", "content")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS rn, concat_ws('; ', 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, 'c_nationkey: ' || c_nationkey, 'c_acctbal: ' || c_acctbal, 'c_mktsegment: ' || c_mktsegment) AS line FROM customer)
SELECT 'customer' AS doc_id, (rn // 20 + 1)::INTEGER AS chunk_no, 'Rows of "customer":' || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS content FROM r GROUP BY rn // 20""")
def table_chunks(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return R.build_chunks([R.dataset_chunks(P.to_cells(t.withColumn("_row", F.col("c_custkey")), "customer", "_row", t.columns), most_rows=None)], most=None).select("doc_id", "chunk_no", "content")


_STOPQ = ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS)


@query(rf"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9%]+(?:[''.][a-z0-9]+)*'), lambda x: x NOT IN ({_STOPQ}) AND length(x) > 1) AS w FROM benchmark),
f AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
h AS (SELECT item_id, md5(f) AS d FROM f),
s AS (SELECT item_id, CAST(('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::BIGINT % 512 AS INTEGER) AS bucket, sum(CASE WHEN ('0x' || d[10:10])::INTEGER % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL HAVING v <> 0)
SELECT item_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 9) AS weight FROM s""")
def hash_embed(spark, sf_dir):
    return R.hash_embedding(table(spark, sf_dir, "benchmark"), ["item_id"], "text").withColumn("weight", F.round("weight", 9))


@query(f"""WITH t AS (SELECT 'documents' AS source, doc_id AS id, NULL::BIGINT AS turn, text FROM documents UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations),
w AS (SELECT source, id, turn, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9%]+(?:[''.][a-z0-9]+)*'), lambda x: x NOT IN ({_STOPQ}) AND length(x) > 1) AS w FROM t),
h AS (SELECT source, id, turn, md5(unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS d FROM w),
s AS (SELECT source, id, turn, CAST(('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::BIGINT % 512 AS INTEGER) AS bucket, sum(CASE WHEN ('0x' || d[10:10])::INTEGER % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL HAVING v <> 0)
SELECT source, id, turn, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY source, id, turn)), 9) AS weight FROM s""")
def hash_embed_texts(spark, sf_dir):
    """Whole texts of all documents and conversation turns; hash_embed holds the benchmark's."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("turn"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), "turn", "text")
    # A document has no turn; the key of the embedding holds no null.
    keys = F.struct("source", "id", F.coalesce("turn", F.lit(-1)).alias("turn"))
    e = R.hash_embedding(d.unionByName(c).select(keys.alias("k"), "text"), ["k"], "text")
    return e.select("k.source", "k.id", F.when(F.col("k.source") == "conversations", F.col("k.turn")).alias("turn"), "bucket", F.round("weight", 9).alias("weight"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 20 = 0)
SELECT query_id, vec_id AS id, round(list_cosine_similarity(q, v), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, v), 9) DESC, vec_id)::INTEGER AS rank FROM q JOIN v ON query_id <> vec_id QUALIFY rank <= 8""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return Q.cosine_top(e, e.filter("vec_id % 20 = 0"), 8).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(rf"""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9%]+(?:[''.][a-z0-9]+)*'), lambda x: x NOT IN ({_STOPQ}) AND length(x) > 1)) AS w FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9%]+(?:[''.][a-z0-9]+)*'), lambda x: x NOT IN ({_STOPQ}) AND length(x) > 1)) AS w FROM documents),
m AS (SELECT item_id, doc_id, len(list_intersect(q.w, d.w)) / len(q.w) AS score FROM q JOIN d ON len(list_intersect(q.w, d.w)) > 0)
SELECT item_id, doc_id, round(score, 9) AS score FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1 AND score >= 0.12""")
def section_search(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.lit("corpus").alias("doc_id"), F.col("text").alias("question"))
    s = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("doc_id"), F.col("doc_id").alias("section_no"), F.col("doc_id").cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    # The title carries the id through; ids are no words of the questions.
    got = R.best_sections(q, s)
    return got.select(F.col("question_id").alias("item_id"), F.col("source").cast("long").alias("doc_id"), F.round("score", 9).alias("score"))


@query("""SELECT 1099511627776 + o_orderkey AS fact_no, o_orderkey || ' orders' AS keywords, 'For o_orderkey "' || o_orderkey || '" in "orders": o_custkey ' || o_custkey || ', o_orderstatus ' || o_orderstatus || ', o_totalprice ' || o_totalprice || ', o_orderdate ' || o_orderdate::VARCHAR || ', o_orderpriority ' || o_orderpriority || '.' AS answer FROM orders""")
def row_facts(spark, sf_dir):
    """Facts of every order; the keys of orders are its identifiers by declaration, as their names hint at none."""
    t = table(spark, sf_dir, "orders")
    names = [c for c in t.columns if not c.startswith("_")]
    cells = P.to_cells(t.withColumn("_row", F.col("o_orderkey")), "orders", "_row", names)
    kinds = [("orders", "orders", c, i, "identifier" if c == "o_orderkey" else "text") for i, c in enumerate(names)]
    columns = spark.createDataFrame(kinds, "doc_id string, dataset string, column string, position int, semantic_type string")
    return R.identifier_facts(R.identifier_rows(cells, columns)).select("fact_no", F.array_join("keywords", " ").alias("keywords"), "answer")


@query(f"""WITH {_KEYWORDS_SQL}, d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, array_to_string({_DATES_SQL}, '|') AS dates, array_to_string({_NUMBERS_SQL}, '|') AS numbers, coalesce((SELECT string_agg(keyword, '|' ORDER BY rank) FROM k WHERE k.doc_id = d.doc_id), '') AS keywords FROM d""")
def entity_facts(spark, sf_dir):
    m = R.mentions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("dates", "numbers", "keywords")])


_WORDS = lambda c: rf"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9%]+(?:[''.][a-z0-9]+)*'), lambda x: x NOT IN ({_STOPQ}) AND length(x) > 1)"
_CHUNKS_SQL = f"""d AS (SELECT doc_id, {_TRIM.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT doc_id, t, 0::BIGINT AS p, 1 AS no FROM d WHERE t <> '' UNION ALL SELECT doc_id, t, greatest(p + 1, {_TO} - 150), no + 1 FROM w WHERE {_TO} < length(t)),
c AS (SELECT doc_id, no, {_TRIM.format(f"substr(t, p + 1, {_TO} - p)")} AS content FROM w),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no)::INTEGER AS chunk_no, content FROM c WHERE content <> '')"""


_RETRIEVED_SQL = f"""WITH RECURSIVE {_CHUNKS_SQL},
t AS MATERIALIZED (SELECT 0 AS kind, doc_id AS id, chunk_no AS no, doc_id % 4 AS usr, {_WORDS("content")} AS w FROM chunks UNION ALL SELECT 1, item_id, 0, item_id % 4, {_WORDS("text")} FROM benchmark),
f AS (SELECT kind, id, no, usr, md5(unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS d FROM t),
s AS MATERIALIZED (SELECT kind, id, no, usr, CAST(('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::BIGINT % 512 AS INTEGER) AS bucket, sum(CASE WHEN ('0x' || d[10:10])::INTEGER % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM f GROUP BY ALL),
n AS MATERIALIZED (SELECT kind, id, no, sqrt(sum(v * v)) AS n FROM s GROUP BY ALL),
cos AS (SELECT q.id AS qid, p.id, p.no, sum(q.v * p.v) AS dot FROM s q JOIN s p ON q.kind = 1 AND p.kind = 0 AND q.usr = p.usr AND q.bucket = p.bucket GROUP BY ALL),
kw AS (SELECT q.id AS qid, p.id, p.no, len(list_intersect(list_distinct(q.w), list_distinct(p.w))) / len(list_distinct(q.w)) AS k FROM t q JOIN t p ON q.kind = 1 AND p.kind = 0 AND q.usr = p.usr AND len(q.w) > 0),
r AS (SELECT kw.qid AS question_id, kw.id AS doc_id, kw.no AS chunk_no, 0.7::DOUBLE * coalesce(dot / (a.n * b.n), 0) + 0.3::DOUBLE * k AS score FROM kw LEFT JOIN cos USING (qid, id, no) LEFT JOIN n a ON a.kind = 1 AND a.id = kw.qid AND a.n > 0 LEFT JOIN n b ON b.kind = 0 AND b.id = kw.id AND b.no = kw.no AND b.n > 0),
hits AS MATERIALIZED (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id, chunk_no)::INTEGER AS rank, doc_id, chunk_no, score FROM r WHERE score >= 0.15 - 1e-9 QUALIFY rank <= 8)"""


def _hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cat = d.select("doc_id", F.lit("completed").alias("status"), (F.col("doc_id") % 4).alias("user_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("filename"))
    pieces = R.build_chunks([R.section_chunks(d.select("doc_id", F.lit(1).alias("section_no"), F.lit(None).cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("content")))], most=None)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 4).alias("user_id"), F.col("text").alias("question"))
    return R.retrieve(q, pieces, cat)


@query(f"{_RETRIEVED_SQL} SELECT question_id, rank, doc_id, chunk_no, round(score, 6) AS score FROM hits")
def retrieval(spark, sf_dir):
    """The eight best passages of the asking user's documents for each benchmark item."""
    return _hits(spark, sf_dir).select("question_id", "rank", "doc_id", "chunk_no", F.round("score", 6).alias("score"))


@query(f"""{_RETRIEVED_SQL}, b AS (SELECT * FROM hits WHERE rank = 1),
o AS (SELECT h.question_id, min_by(h.doc_id, h.rank) AS other FROM hits h JOIN b USING (question_id) WHERE h.doc_id <> b.doc_id AND h.score >= 0.85 * b.score GROUP BY h.question_id)
SELECT b.question_id, CASE WHEN b.score >= 0.25 THEN 'medium' ELSE 'low' END AS confidence, concat_ws('|', 'doc ' || b.doc_id, 'doc ' || o.other) AS sources FROM b LEFT JOIN o USING (question_id)""")
def extracted_answers(spark, sf_dir):
    """The best passage, beside one of another document that is nearly as good."""
    return R.extractive_answers(_hits(spark, sf_dir)).select("question_id", "confidence", F.array_join("sources", "|").alias("sources"))


@query(f"""WITH k AS MATERIALIZED (SELECT DISTINCT unnest({_WORDS("text")}) AS name FROM documents), e AS (SELECT name FROM k WHERE length(name) >= 4)
SELECT item_id, count(*) AS n_names, min(name) AS first_name, sum(length(name))::BIGINT AS letters FROM benchmark b JOIN e ON contains(lower(b.text), e.name) GROUP BY item_id""")
def names_in_items(spark, sf_dir):
    """Which of the corpus's words stand in each benchmark item, inside longer words, too."""
    word = F.explode(T.significant_words(F.col("text")))
    names = table(spark, sf_dir, "documents").select(F.lit("corpus").alias("scope"), word.alias("name")).filter(F.char_length("name") >= 4).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.lit("corpus").alias("scope"), "item_id", F.lower("text").alias("low"))
    found = Q.names_in_texts(items, names, "scope", "name", "low")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_names"), F.min("name").alias("first_name"), F.sum(F.char_length("name")).cast("long").alias("letters"))


# --- scalar functions, pages and blocks


@query("""WITH o AS (SELECT *, o_orderkey % 4 AS k, (o_orderkey // 4) % 4 AS j FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice = round(o_totalprice) THEN format('{:,}', o_totalprice::BIGINT) ELSE format('{:,}', trunc(o_totalprice)::BIGINT) || '.' || lpad((round(o_totalprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') END AS price,
CASE WHEN o_totalprice >= 1e6 THEN format('{:.1f}', o_totalprice / 1e6) || 'M' WHEN o_totalprice >= 1e3 THEN format('{:.1f}', o_totalprice / 1e3) || 'K' ELSE '-' END AS short_price,
CASE WHEN o_totalprice > 150000 THEN 'up' WHEN o_totalprice < 150000 THEN 'down' ELSE 'flat' END AS trend,
o_custkey + 0.5::DOUBLE AS percent, round_even(o_totalprice, 0)::BIGINT AS whole,
day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous, o_orderdate::DATE::VARCHAR AS day,
o_orderpriority || '.csv' AS file, CASE k WHEN 0 THEN 'pdf' WHEN 1 THEN 'excel' WHEN 2 THEN 'json' END AS kind,
CASE k WHEN 0 THEN j = 0 WHEN 1 THEN j = 1 WHEN 2 THEN j IN (1, 2) ELSE true END AS signed, (o_orderkey % 50)::INTEGER AS page, k <> 1 AS formula,
CASE WHEN k = 0 OR (o_custkey % 1000 + 1) / 500 BETWEEN 0.6 AND 1.8 THEN 'chart-like' ELSE 'image' END AS figure FROM o""")
def scalar_formats(spark, sf_dir):
    """What is read from and said of cells, file names, labels and figures, on every order."""
    k, price = (F.col("o_orderkey") % 4 + 1).cast("int"), F.col("o_totalprice")
    pick = lambda at, *values: F.element_at(F.array(*[F.lit(v) for v in values]), at)
    numeric_day = F.date_format("o_orderdate", "dd/MM/yyyy")
    head = F.unhex(pick((F.floor(F.col("o_orderkey") / 4) % 4 + 1).cast("int"), "255044462D31", "504B030414", "D0CF11E0A1B11AE1", "00"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.format_number(price).alias("price"), F.when(price >= 1000, S.compact_number(price)).otherwise("-").alias("short_price"),
        S.trend_direction(price - 150000).alias("trend"), S.parse_percent(F.concat(F.col("o_custkey").cast("string"), F.lit(".5%"))).alias("percent"),
        S.parse_int(F.concat(F.lit("$"), F.format_number(price, 2))).alias("whole"), S.is_ambiguous_date(numeric_day).alias("ambiguous"), S.parse_date(numeric_day).cast("string").alias("day"),
        S.sanitize_filename(F.concat(F.lit("../tmp/"), "o_orderpriority", F.lit(".csv"))).alias("file"), S.source_type(F.concat(F.lit("a.b."), pick(k, "PDF", "xlsm", "ndjson", "exe"))).alias("kind"),
        S.signature_matches(pick(k, "pdf", "docx", "excel", "csv"), head).alias("signed"), S.page_from_label(F.concat(F.lit("Pages "), (F.col("o_orderkey") % 50).cast("string"), F.lit("-60"))).alias("page"),
        S.looks_formula(pick(k, "=1", "a1", "-1", "@1")).alias("formula"), S.classify_figure(pick(k, "Bar chart", "photo", "", "x"), F.col("o_custkey") % 1000 + 1, F.lit(500)).alias("figure"),
    )


@query(r"""WITH t AS (SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), '') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 420 THEN regexp_replace(substr(t, 1, 420), '\s+\S*$', '') || '…' ELSE t END AS excerpt FROM t""")
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(12) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def full_texts(spark, sf_dir):
    """Turns as a document's pages, in order."""
    return H.full_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))


@query(r"""WITH l AS (SELECT conv_id AS doc_id, turn AS section_no, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS l
FROM conversations WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 40)
SELECT doc_id, section_no, CASE WHEN length(l[1]) < 90 THEN l[1] ELSE 'Page ' || section_no END AS title, coalesce(array_to_string(CASE WHEN length(l[1]) < 90 THEN l[2:] ELSE l END, chr(10)), '') AS content FROM l""")
def page_sections(spark, sf_dir):
    """Turns as a document's pages."""
    return H.page_sections(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))


@query(r"""WITH b AS (SELECT conv_id AS doc_id, turn, role = 'user' AS h, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section_no, nullif(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), '') AS t FROM conversations)
SELECT doc_id, section_no::BIGINT AS section_no, max(t) FILTER (h) AS title, string_agg(t, chr(10) ORDER BY turn) FILTER (NOT h) AS content FROM b WHERE t IS NOT NULL GROUP BY ALL HAVING content <> ''""")
def block_sections(spark, sf_dir):
    """Turns as a document's blocks, those of the user as its headings."""
    c = table(spark, sf_dir, "conversations")
    return H.block_sections(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), (F.col("role") == "user").alias("is_heading"), "text"))


# --- validation, market rows, export tables and the catalog, on rows of the given tables


@query("""SELECT o_orderkey, o_orderpriority AS security, CASE WHEN o_custkey % 160 - 20 BETWEEN 0 AND 100 THEN (o_custkey % 160 - 20)::DOUBLE END AS coupon_rate,
concat_ws('|', CASE WHEN o_custkey % 160 - 20 NOT BETWEEN 0 AND 100 THEN 'implausible coupon rate taken as unknown' END, CASE WHEN o_custkey % 5 = 0 THEN 'no closing price' END) AS warnings FROM orders WHERE o_orderstatus <> 'F'""")
def bond_checks(spark, sf_dir):
    """Orders as bonds; those of status F have no name."""
    t = table(spark, sf_dir, "orders")
    named = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    rows = t.select("o_orderkey", named.alias("security"), F.lit(None).cast("string").alias("isin"), (F.col("o_custkey") % 160 - 20).cast("double").alias("coupon_rate"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice")).alias("closing_price"))
    return M.validate_bonds(rows).select("o_orderkey", "security", "coupon_rate", F.array_join("warnings", "|").alias("warnings"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS currency, CASE WHEN l_linenumber <> 1 THEN l_discount END AS b, l_tax AS s, l_quantity AS a FROM lineitem),
f AS (SELECT *, coalesce(b <= 0 OR s <= 0, false) AND b IS NOT NULL AND s IS NOT NULL AS low FROM r)
SELECT l_orderkey, l_linenumber, currency, CASE WHEN NOT low THEN b END AS buying, CASE WHEN NOT low THEN s END AS selling, CASE WHEN NOT low THEN a END AS average,
CASE WHEN b IS NULL OR s IS NULL THEN 'incomplete' WHEN low THEN 'non-positive value taken as unknown' WHEN b > s THEN 'buying above selling' ELSE '' END AS warnings FROM f""")
def rate_checks(spark, sf_dir):
    """Discount and tax of each line as the two sides of a rate; first lines lack one."""
    t = table(spark, sf_dir, "lineitem")
    rows = t.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("currency"), F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("buying"), F.col("l_tax").alias("selling"), F.col("l_quantity").alias("average"))
    return M.validate_rates(rows).withColumn("warnings", F.array_join("warnings", "|"))


@query("""SELECT l_orderkey AS doc_id, l_returnflag AS bond, l_linestatus AS category, l_quantity AS volume, l_discount AS previous, l_tax AS closing, round(l_tax - l_discount, 6) AS change
FROM lineitem WHERE l_linenumber NOT IN (2, 3) AND l_quantity > 0""")
def bond_trades(spark, sf_dir):
    """Lines as bonds: the second of an order is not traded, the third by a negative volume, which is no trade."""
    t = table(spark, sf_dir, "lineitem")
    traded = F.when(F.col("l_linenumber") == 2, 0.0).when(F.col("l_linenumber") == 3, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    rows = t.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("category"), traded.alias("bond_traded"), F.col("l_discount").alias("previous_price"), F.col("l_tax").alias("closing_price"))
    return M.validate_trades(M.derive_trades(rows))


@query("""SELECT p_partkey, p_brand AS ticker, CASE WHEN p_size >= 20 THEN (p_size - 20)::DOUBLE END AS volume,
concat_ws('|', CASE WHEN p_partkey % 7 = 0 THEN 'no closing price' END, CASE WHEN p_size < 20 THEN 'negative volume taken as unknown' END) AS warnings FROM part WHERE p_partkey % 3 <> 0""")
def equity_checks(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    rows = t.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("").alias("ticker"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("closing"), (F.col("p_size") - 20).cast("double").alias("volume"))
    return M.validate_equities(rows).select("p_partkey", "ticker", "volume", F.array_join("warnings", "|").alias("warnings"))


@query("""WITH o AS (SELECT *, (o_custkey % 160 - 20)::DOUBLE AS r FROM orders)
SELECT o_orderkey, CASE WHEN r >= 0 THEN r END AS equity_turnover, o_totalprice AS bond_turnover, CASE WHEN r BETWEEN 0 AND 100 THEN r END AS repo_rate FROM o""")
def overview_checks(spark, sf_dir):
    r = (F.col("o_custkey") % 160 - 20).cast("double")
    same = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", r.alias("equity_turnover"), same.alias("shares_traded"), same.alias("bond_turnover"), same.alias("market_capitalization"), same.alias("repo_turnover"), r.alias("repo_rate"))
    return M.validate_overview(rows).select("o_orderkey", "equity_turnover", "bond_turnover", "repo_rate")


@query("""WITH e AS (SELECT user_id AS doc_id, lpad(event_id::VARCHAR, 12, '0') AS ticker, value - 100 AS change, (event_id % 97)::DOUBLE AS volume, value FROM events),
r AS (SELECT doc_id, 'gainers' AS ranking, row_number() OVER (PARTITION BY doc_id ORDER BY change DESC, ticker) AS rank, ticker, change AS v FROM e WHERE change IS NOT NULL
UNION ALL SELECT doc_id, 'losers', row_number() OVER (PARTITION BY doc_id ORDER BY change, ticker), ticker, change FROM e WHERE change IS NOT NULL
UNION ALL SELECT doc_id, 'volume', row_number() OVER (PARTITION BY doc_id ORDER BY volume DESC, ticker), ticker, volume FROM e WHERE volume IS NOT NULL
UNION ALL SELECT doc_id, 'value', row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, ticker), ticker, value FROM e WHERE value IS NOT NULL)
SELECT doc_id, ranking, rank::INTEGER AS rank, ticker, round(v, 6) AS value FROM r WHERE rank <= 10""")
def equity_rankings(spark, sf_dir):
    """Events as a user's equities."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("doc_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ticker"), (F.col("value") - 100).alias("change"), (F.col("event_id") % 97).cast("double").alias("volume"), "value")
    return M.rankings(rows).withColumn("value", F.round("value", 6))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N') THEN 'completed' ELSE 'failed' END AS status FROM orders")
def report_status(spark, sf_dir):
    """Orders as reports; lines returned or accepted are their parts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_returnflag")
    return M.document_status(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), [lines.filter(F.col("l_returnflag") == f) for f in ("A", "R")])


_WRITTEN = {"day": "date", "price": "currency"}


def _written_orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Cells of orders as people write them, in 50 documents: some days unread, prices with and without a currency."""
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    day = F.when(k == 3, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    written = F.when(k == 0, F.concat(F.lit("$"), price)).when(k == 1, F.concat(price, F.lit(" USD"))).when(k == 2, F.concat(F.lit("eur "), price)).otherwise(price)
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), day.alias("day"), written.alias("price"))
    cells = P.to_cells(t, "written", "_row", list(_WRITTEN)).withColumn("doc_id", (F.col("source_row") % 50).cast("string"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _WRITTEN.items() for x in pair]), F.col("column"))
    return cells, cells.select(*P.KEY, "column").distinct().withColumn("semantic_type", kind)


@query("SELECT (o_orderkey % 50)::VARCHAR AS doc_id, 'day' AS \"column\", count(*) FILTER (o_orderkey % 4 = 3) AS invalid FROM orders GROUP BY 1")
def unread_dates(spark, sf_dir):
    return G.invalid_dates(*_written_orders(spark, sf_dir)).select("doc_id", "column", "invalid")


@query("SELECT (o_orderkey % 50)::VARCHAR AS doc_id, 'price' AS \"column\", count(DISTINCT o_orderkey % 4) AS signatures FROM orders GROUP BY 1")
def mixed_currencies(spark, sf_dir):
    return G.currency_signatures(*_written_orders(spark, sf_dir)).select("doc_id", "column", "signatures")


@query("""SELECT o_orderkey AS "Source Row", CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate::DATE::VARCHAR END AS day, CASE WHEN o_orderkey % 4 = 3 THEN 'soon' END AS "day (raw)",
CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'on request' END AS "price (raw)", o_orderpriority AS note FROM orders""")
def typed_orders(spark, sf_dir):
    """Orders as texts, typed for export; what can't be read stays beside as it was."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    t = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 4 == 3, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 5 == 0, "on  request").otherwise(F.concat(F.lit("$"), price)).alias("price"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("note"),
    )
    return sinks.typed_rows(t, {"day": "date", "price": "currency", "note": "text"}, "o_orderkey").withColumn("day", F.col("day").cast("string"))


_COLUMN_SQL = """c AS (SELECT l_orderkey AS doc_id, l_returnflag AS dataset, count(*) AS total, count(*) FILTER (l_linenumber > 1) AS n, count(*) FILTER (l_linenumber > 1 AND l_discount = 0) AS unparsed,
count(*) FILTER (l_tax = 0) AS negative, count(DISTINCT CASE WHEN l_linenumber > 1 THEN l_quantity END) AS u, count(*) FILTER (l_tax = 0.01) AS ambiguous, l_orderkey % 3 AS k FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_COLUMN_SQL}
SELECT doc_id, dataset, 'low_confidence_type' AS rule_id, 'info' AS severity, 'v' AS "column", NULL AS value FROM c WHERE n = 0
UNION ALL SELECT doc_id, dataset, 'missing_values', CASE WHEN n = 0 THEN 'warning' ELSE 'info' END, 'v', (total - n)::VARCHAR FROM c WHERE total > n
UNION ALL SELECT doc_id, dataset, 'unparsed_values', 'warning', 'v', unparsed::VARCHAR FROM c WHERE unparsed > 0
UNION ALL SELECT doc_id, dataset, 'negative_values', 'warning', 'v', negative::VARCHAR FROM c WHERE negative > 0 AND k = 1
UNION ALL SELECT doc_id, dataset, 'duplicate_identifiers', 'warning', 'v', (n - u)::VARCHAR FROM c WHERE n > u AND k = 0
UNION ALL SELECT doc_id, dataset, 'ambiguous_dates', 'warning', 'v', ambiguous::VARCHAR FROM c WHERE ambiguous > 0
UNION ALL SELECT doc_id, dataset, 'duplicate_rows', 'warning', NULL, (total - u)::VARCHAR FROM c WHERE total > u
UNION ALL SELECT doc_id, dataset, 'blank_rows_skipped', 'info', NULL, (total - n)::VARCHAR FROM c WHERE total > n""")
def validation_issues(spark, sf_dir):
    """Every rule on the profile of a column for each order and return flag."""
    there = F.col("l_linenumber") > 1
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("dataset")).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(there).alias("non_null_count"), F.count_if(there & (F.col("l_discount") == 0)).alias("unparsed_count"),
        F.count_if(F.col("l_tax") == 0).alias("negative_count"), F.count_distinct(F.when(there, F.col("l_quantity"))).alias("unique_count"), F.count_if(F.col("l_tax") == 0.01).alias("ambiguous_date_count"),
    )
    k = F.col("doc_id") % 3
    c = c.withColumns({"column": F.lit("v"), "confidence": F.when(F.col("non_null_count") == 0, "low").otherwise("high"), "semantic_type": F.when(k == 0, "identifier").when(k == 1, "currency").otherwise("text")})
    counts = c.select("doc_id", "dataset", (F.col("total_count") - F.col("unique_count")).alias("duplicate_row_count"), (F.col("total_count") - F.col("non_null_count")).alias("blank_rows_skipped"))
    return G.issues(c, counts).select("doc_id", "dataset", "rule_id", "severity", "column", "value")


@query("""SELECT l_orderkey AS doc_id, l_returnflag AS dataset, count(*) AS row_count, count(*) FILTER (l_tax = 0) AS blank_rows_skipped, count(*) + count(*) FILTER (l_tax = 0) + 1 AS raw_rows FROM lineitem GROUP BY ALL""")
def row_reconciliation(spark, sf_dir):
    """Lines of each order and flag as datasets; those without tax stand for skipped blank rows."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("dataset"), "l_tax")
    blanks = t.filter("l_tax = 0").groupBy(*P.KEY).agg(F.count(F.lit(1)).alias("blank_rows_skipped"))
    return G.reconcile(t.groupBy(*P.KEY).agg(F.count(F.lit(1)).alias("row_count")), blanks)


@query("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id AS source_row, CASE WHEN abs(value - m) / sd >= 4 THEN 'high' ELSE 'medium' END AS severity, round(value, 4) AS value, round(abs(value - m) / sd, 4) AS score FROM events, s WHERE abs(value - m) / sd > 2.5""")
def outliers_events(spark, sf_dir):
    cells = P.to_cells(table(spark, sf_dir, "events").withColumn("_row", F.col("event_id")), "events", "_row", ["value"])
    return G.z_outliers(cells, P.profile(cells)).select("source_row", "severity", F.round("value", 4).alias("value"), F.round("score", 4).alias("score"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_orders(spark, sf_dir):
    return P.first_seen(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS axis_values FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders""")
def chart_axes(spark, sf_dir):
    t = table(spark, sf_dir, "orders").withColumn("_row", F.col("o_orderkey"))
    return P.axis_counts(P.to_cells(t, "orders", "_row", ["o_orderstatus", "o_orderpriority", "o_custkey"])).select("column", "axis_values")


def _order_catalog(spark, sf_dir) -> DataFrame:
    """Orders as documents of four users; those of status O are completed, some of them indexed."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 4).alias("user_id"), F.when(F.col("o_orderstatus") == "O", "completed").otherwise("failed").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "indexed").when(F.col("o_orderkey") % 3 == 1, "pending").alias("index_status"))


@query("SELECT l_orderkey AS doc_id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 1 AND o_orderstatus = 'O')")
def owned_rows(spark, sf_dir):
    return C.owned(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber"), _order_catalog(spark, sf_dir), 1)


@query("SELECT o_orderkey AS doc_id, o_custkey % 4 AS user_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0")
def index_queue(spark, sf_dir):
    return C.to_index(_order_catalog(spark, sf_dir)).select("doc_id", "user_id")


@query("""WITH f AS (SELECT l_orderkey AS doc_id, count(*) AS n, count(*) FILTER ((l_quantity * 20) / 500 BETWEEN 0.6 AND 1.8) AS k FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, coalesce(n, 0) AS tables, 1::BIGINT AS charts, coalesce(k, 0) AS chart_like, coalesce(n - k, 0) AS images FROM orders LEFT JOIN f ON doc_id = o_orderkey""")
def figure_summary(spark, sf_dir):
    """Lines as an order's tables and, by their quantity, as its figures; one chart an order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("").alias("caption"), (F.col("l_quantity") * 20).alias("width"), F.lit(500).alias("height"))
    return C.vision_summary(lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), lines)


from veritab.plans import derived  # noqa: E402, F401  registers its queries
