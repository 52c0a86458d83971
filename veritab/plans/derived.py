"""Queries over what Spark derives from the given tables first: cells, JSON documents, files, an index, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.operators import catalog as C
from veritab.operators import findings as G
from veritab.operators import market as M
from veritab.operators import profile as P
from veritab.operators import retrieve as R
from veritab.operators import shape as H
from veritab.plans.registry import query, table
from veritab.plans.staging import scratch, spread
from veritab.sources import readers, sinks
from veritab.sources.delimited import read_grids
from veritab.sources.index import ChunkIndex, index_documents

# --- one large table as cells


def _orders(spark, sf_dir):
    t = table(spark, sf_dir, "orders").withColumns({"_row": F.col("o_orderkey"), "o_orderdate": F.to_date("o_orderdate")})
    cells = P.to_cells(t, "orders", "_row", ["o_orderdate", "o_totalprice", "o_orderpriority"])
    return cells, P.profile(cells)


_JUMPS = """o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_totalprice AS v FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
l AS (SELECT *, lag(v) OVER (ORDER BY d, o_orderkey) AS p, lag(d) OVER (ORDER BY d, o_orderkey) AS pd FROM o),
j AS (SELECT *, (v - p) / abs(p) AS change FROM l WHERE p <> 0 AND abs((v - p) / abs(p)) >= 0.5)"""


@query(f"""WITH {_JUMPS} SELECT o_orderkey AS source_row, CASE WHEN abs(change) >= 1 THEN 'high' ELSE 'medium' END AS severity, v AS value, round(change, 6) AS score,
'"o_totalprice" moved ' || format('{{:,}}', round_even(change * 100, 0)::BIGINT) || '% from ' || pd || ' to ' || d AS message FROM j""")
def period_jumps_orders(spark, sf_dir):
    """Sudden changes in the order of dates over one table as cells."""
    return G.period_jumps(*_orders(spark, sf_dir)).select("source_row", "severity", "value", F.round("score", 6).alias("score"), "message")


@query(f"""WITH {_JUMPS},
s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders),
a AS (SELECT 'outlier' AS type, CASE WHEN abs(o_totalprice - m) / sd >= 4 THEN 'high' ELSE 'medium' END AS severity, o_orderkey AS source_row, o_totalprice AS value FROM orders, s WHERE abs(o_totalprice - m) / sd > 2.5
  UNION ALL SELECT 'sudden_change', CASE WHEN abs(change) >= 1 THEN 'high' ELSE 'medium' END, o_orderkey, v FROM j)
SELECT type, severity, source_row, value, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, type, source_row)::INTEGER AS rank FROM a QUALIFY rank <= 40""")
def anomalies_orders(spark, sf_dir):
    """The forty first anomalies by severity, as a document's page shows them."""
    return G.anomalies(*_orders(spark, sf_dir)).select("type", "severity", "source_row", "value", "rank")


_SAID = "CASE WHEN {0} = round({0}) THEN format('{{:,}}', {0}::BIGINT) ELSE format('{{:,}}', trunc(round({0}, 2))::BIGINT) || '.' || lpad((round(abs({0}) * 100)::BIGINT % 100)::VARCHAR, 2, '0') END"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_totalprice AS v, o_orderpriority AS c FROM orders),
s AS (SELECT min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sd, count(*) AS n FROM o),
g AS (SELECT c, sum(v) AS s, min(o_orderkey) AS f FROM o GROUP BY c),
x AS (SELECT d, v, row_number() OVER (ORDER BY d, o_orderkey) - 1 AS x FROM o),
t AS (SELECT regr_slope(v, x) * count(*) / avg(v) AS rel, min(d) AS a, max(d) AS b FROM x),
far AS (SELECT count(*) AS n FROM o, s WHERE abs(v - m) > 2 * sd),
i AS (SELECT 1 AS k, '"o_totalprice" ranges from ' || {_SAID.format("lo")} || ' to ' || {_SAID.format("hi")} || ' (average ' || {_SAID.format("m")} || ') across ' || n || ' records.' AS text FROM s WHERE lo <> hi
  UNION ALL SELECT 2, 'By total o_totalprice, "' || (SELECT c FROM g ORDER BY s DESC, f LIMIT 1) || '" leads (' || (SELECT {_SAID.format("max(s)")} FROM g) || ') and "' || (SELECT c FROM g ORDER BY s, f LIMIT 1) || '" trails (' || (SELECT {_SAID.format("min(s)")} FROM g) || ').'
  UNION ALL SELECT 3, '"o_totalprice" ' || CASE WHEN rel > 0 THEN 'increased' ELSE 'decreased' END || ' from ' || a || ' to ' || b || '.' FROM t WHERE abs(rel) > 0.08
  UNION ALL SELECT 4, '"o_totalprice" has ' || n || ' values more than 2 deviations from the mean.' FROM far WHERE n > 0
  UNION ALL SELECT 6, 'orders holds ' || (count(*) - count(DISTINCT (d, v, c))) || ' repeated records.' FROM o HAVING count(*) > count(DISTINCT (d, v, c)))
SELECT row_number() OVER (ORDER BY k)::INTEGER AS insight_no, text FROM i""")
def insights_orders(spark, sf_dir):
    cells, columns = _orders(spark, sf_dir)
    return G.insights(cells, columns, G.dataset_counts(cells)).select("insight_no", "text")


_LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS pairs, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_LINE_MEASURES) for b in _LINE_MEASURES[i + 1 :]))
def correlations_cells(spark, sf_dir):
    """Every two measures of one table as cells, its rows numbered."""
    t = table(spark, sf_dir, "lineitem").withColumn("_row", F.monotonically_increasing_id())
    cells = P.to_cells(t, "lineitem", "_row", _LINE_MEASURES)
    columns = spark.createDataFrame([("lineitem", "lineitem", c, i, "number", None) for i, c in enumerate(_LINE_MEASURES)], "doc_id string, dataset string, column string, position int, semantic_type string, mean double")
    return G.correlations_of_cells(cells, columns).select("a", "b", "pairs", F.round("r", 6).alias("r"))


@query(f"""WITH {_JUMPS}, s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders),
a AS (SELECT 'outlier' AS type, CASE WHEN abs(o_totalprice - m) / sd >= 4 THEN 'high' ELSE 'medium' END AS severity, o_orderkey AS source_row FROM orders, s WHERE abs(o_totalprice - m) / sd > 2.5
  UNION ALL SELECT 'sudden_change', CASE WHEN abs(change) >= 1 THEN 'high' ELSE 'medium' END, o_orderkey FROM j),
r AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, type, source_row) AS n FROM a QUALIFY n <= 40)
SELECT n::INTEGER AS rank, 'anomaly' AS category, severity, CASE WHEN type = 'outlier' THEN '' ELSE '"o_totalprice" moved ' || format('{{:,}}', round_even(change * 100, 0)::BIGINT) || '% from ' || pd || ' to ' || d END AS message FROM r LEFT JOIN j ON j.o_orderkey = r.source_row WHERE n <= 8""")
def what_matters_orders(spark, sf_dir):
    """What matters most of all orders: anomalies before insights, the first eight. A sudden change's message is compared."""
    cells, columns = _orders(spark, sf_dir)
    found = G.what_matters(spark.createDataFrame([], "doc_id string, severity string, message string, rank int"), G.anomalies(cells, columns), G.insights(cells, columns, G.dataset_counts(cells)))
    return found.select("rank", "category", "severity", F.when(F.col("message").contains(" moved "), F.col("message")).otherwise("").alias("message"))


@query("""SELECT c_custkey AS source_row, (c_custkey % 180 - 90)::DOUBLE AS lat, c_nationkey + 0.5::DOUBLE AS lon, c_acctbal AS value FROM customer WHERE c_custkey % 5 <> 0""")
def place_points(spark, sf_dir):
    """Customers with coordinates made from their keys; a fifth of them has no latitude."""
    lat = F.when(F.col("c_custkey") % 5 != 0, (F.col("c_custkey") % 180 - 90).cast("string")).otherwise("unknown")
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row"), lat.alias("Site lat"), (F.col("c_nationkey") + 0.5).alias("Site lng"), F.col("c_acctbal").alias("balance"))
    columns = spark.createDataFrame([("customer", "customer", c, i, k) for i, (c, k) in enumerate([("Site lat", "text"), ("Site lng", "text"), ("balance", "currency")])], "doc_id string, dataset string, column string, position int, semantic_type string")
    return G.place_points(P.to_cells(t, "customer", "_row", ["Site lat", "Site lng", "balance"]), columns).select("source_row", "lat", "lon", "value")


@query("""SELECT 'suppliers' AS "table", s_suppkey::VARCHAR AS key, s_name AS found FROM supplier WHERE contains(lower(s_name), '1')
UNION ALL SELECT 'parts', p_partkey::VARCHAR, CASE WHEN contains(lower(p_name), '1') THEN p_name ELSE p_brand END FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '1')""")
def search_tables(spark, sf_dir):
    """One search over two tables."""
    s = table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey"))
    p = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    return C.search_tables({"suppliers": (s, ["s_name"]), "parts": (p, ["p_name", "p_brand"])}, "1", "id")


# --- records of different shapes


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
c AS (SELECT o_orderkey AS doc_id, 'records' AS dataset, '$[0]' AS json_path, NULL::VARCHAR AS parent_ref, unnest(['status', 'order_id', 'more.priority', 'more.tags'][:CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 2 END]) AS "column",
    unnest([0, 1, 2, 3][:CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 2 END])::INTEGER AS position, unnest([o_orderstatus, o_orderkey::VARCHAR, o_orderpriority, o_orderstatus || '; 1'][:CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 2 END]) AS value FROM o
  UNION ALL SELECT l_orderkey, 'records.lines', '$[0].lines[' || i || ']', l_orderkey::VARCHAR, unnest(['no', 'part']), unnest([0, 1])::INTEGER, unnest([l_linenumber::VARCHAR, l_partkey::VARCHAR]) FROM l
  UNION ALL SELECT l_orderkey, 'records.lines.flags', '$[0].lines[' || i || '].flags[0]', '$[0].lines[' || i || ']', 'flag', 0, l_returnflag FROM l WHERE l_orderkey % 2 = 0)
SELECT * FROM c""")
def json_tables(spark, sf_dir):
    """A JSON document for each order with its lines, of four shapes; every list of objects becomes a table of its own."""
    no = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(no)).alias("l"))
    flags = F.when(F.col("o_orderkey") % 2 == 0, F.transform("l", lambda x: F.struct(x["no"].alias("no"), x["part"].alias("part"), F.array(F.struct(x["flag"].alias("flag"))).alias("flags"))))
    plain = F.transform("l", lambda x: F.struct(x["no"].alias("no"), x["part"].alias("part")))
    more = F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.col("o_orderpriority").alias("priority"), F.array(F.col("o_orderstatus"), F.lit("1")).alias("tags")))
    record = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("order_id"), more.alias("more"), flags.alias("lines")))
    other = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("order_id"), more.alias("more"), plain.alias("lines")))
    text = F.concat(F.lit('{"records": ['), F.when(F.col("o_orderkey") % 2 == 0, record).otherwise(other), F.lit("]}"))
    docs = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return H.json_cells(readers.select_records(docs)).select("doc_id", "dataset", "json_path", "parent_ref", "column", "position", "value")


@query("""WITH r AS (SELECT event_type AS doc_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS source_row, event_id, user_id, value, event_id % 4 AS k FROM events),
c AS (SELECT doc_id, source_row, unnest(CASE k WHEN 0 THEN ['event_id', 'user_id'] WHEN 1 THEN ['user_id', 'event_id', 'half'] WHEN 2 THEN ['event_id', 'kind'] ELSE ['event_id'] END) AS "column",
  unnest(CASE k WHEN 1 THEN [0, 1, 2] WHEN 3 THEN [0] ELSE [0, 1] END) AS turn, unnest(CASE k WHEN 0 THEN [event_id, user_id] WHEN 1 THEN [user_id, event_id, event_id // 2] WHEN 2 THEN [event_id, k] ELSE [event_id] END)::VARCHAR AS value FROM r),
f AS (SELECT doc_id, "column", min(source_row * 10 + turn) AS f FROM c GROUP BY doc_id, "column"),
h AS (SELECT doc_id, "column", row_number() OVER (PARTITION BY doc_id ORDER BY f)::INTEGER - 1 AS position FROM f)
SELECT doc_id, "column", position, source_row, value FROM c JOIN h USING (doc_id, "column")""")
def differing_records(spark, sf_dir):
    """Events of each type as one document of records with differing keys, under the header that the records give in turn."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    pair = lambda n, c: F.struct(F.lit(n).alias("column"), c.cast("string").alias("value"))
    i, u = pair("event_id", F.col("event_id")), pair("user_id", F.col("user_id"))
    fields = F.when(k == 0, F.array(i, u)).when(k == 1, F.array(u, i, pair("half", F.floor(F.col("event_id") / 2)))).when(k == 2, F.array(i, pair("kind", k))).otherwise(F.array(i))
    numbered = R.numbered(e.select(F.col("event_type").alias("doc_id"), "event_id", fields.alias("f")), ["doc_id"], ["event_id"], "n")
    rows = numbered.select("doc_id", F.lit("events").alias("dataset"), (F.col("n") + 1).alias("source_row"), F.posexplode("f").alias("turn", "p")).select("doc_id", "dataset", "source_row", "turn", "p.*")
    return rows.join(H.first_seen_header(rows), ["doc_id", "dataset", "column"]).select("doc_id", "column", "position", "source_row", "value")


@query("""WITH o AS (SELECT o_orderkey AS r, o_orderkey // 50 * 50 AS a, o_orderpriority AS p FROM orders)
SELECT o.r, 1 AS c, a.p AS value FROM o JOIN o a ON a.r = o.a UNION ALL SELECT r, 2, r::VARCHAR FROM o UNION ALL SELECT r, 3, (SELECT p FROM o WHERE r = 0) FROM o""")
def merged_cells(spark, sf_dir):
    """A sheet of all orders: every fifty rows share a merged first cell, and one range spans the third column."""
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("doc_id"), F.lit("sheet").alias("sheet"), F.col("o_orderkey").cast("long").alias("r"), "o_orderpriority")
    first = o.select("doc_id", "sheet", "r", F.lit(1).alias("c"), F.when(F.col("r") % 50 == 0, F.col("o_orderpriority")).alias("value"))
    own = o.select("doc_id", "sheet", "r", F.lit(2).alias("c"), F.col("r").cast("string").alias("value"))
    top = o.filter("r = 0").select("doc_id", "sheet", "r", F.lit(3).alias("c"), F.col("o_orderpriority").alias("value"))
    fifty = o.filter("r % 50 = 0").select("doc_id", "sheet", F.col("r").alias("r1"), F.lit(1).alias("c1"), (F.col("r") + 49).alias("r2"), F.lit(1).alias("c2"))
    last = o.groupBy("doc_id", "sheet").agg(F.max("r").alias("r2")).select("doc_id", "sheet", F.lit(0).cast("long").alias("r1"), F.lit(3).alias("c1"), "r2", F.lit(3).alias("c2"))
    return H.fill_merged(first.unionByName(own).unionByName(top), fifty.unionByName(last)).select("r", "c", "value")


# --- files and the index


@query("SELECT doc_id::VARCHAR AS doc_id, lang, source, md5(text) AS text_md5, len(text) AS n FROM documents WHERE text IS NOT NULL")
def csv_texts(spark, sf_dir):
    """All documents written as delimited files, texts over many lines in quotes, and read again in parallel."""
    out = scratch(spark, "csv")
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "lang", "source", "text")
    # Carriage returns are written as such; the writer would trim nothing.
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n", "emptyValue": '""'}
    d.write.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).csv(out)
    cell = lambda i: F.get("cells", F.lit(i))
    return read_grids(spark, out).filter("row_no > 0").select(cell(0).alias("doc_id"), cell(1).alias("lang"), cell(2).alias("source"), F.md5(cell(3)).alias("text_md5"), F.char_length(cell(3)).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version, len(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0")
def chunk_index(spark, sf_dir):
    """Texts indexed, a third of the documents replaced, a seventh deleted, and the index read."""
    index = ChunkIndex(spark, scratch(spark, "index"))
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.lit(1).alias("version"), F.char_length("text").cast("long").alias("n"))
    index.replace(d)
    index.replace(d.filter("doc_id % 3 = 0").withColumn("version", F.lit(2)))
    index.delete(d.filter("doc_id % 7 = 0"))
    index.compact()
    return index.read()


def _checked(text: str) -> list[str]:
    """Windows of a text; one that begins with a vowel can't be read, for the test's sake."""
    if text[:1].lower() in ("a", "e", "i", "o", "u"):
        raise ValueError("it begins with a vowel")
    return R.windows(text)


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN lower(t[1:1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'failed' WHEN regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') = '' THEN 'empty' ELSE 'indexed' END AS status,
CASE WHEN lower(t[1:1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'ValueError: it begins with a vowel' END AS error FROM d""")
def index_status(spark, sf_dir):
    """All documents indexed; those that can't be read are recorded and stop no other."""
    root = scratch(spark, "indexing")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return index_documents(d, ChunkIndex(spark, f"{root}/index"), f"{root}/status", _checked).select("doc_id", "status", "error")


# --- questions


def _order_rows(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    names = [c for c in t.columns if not c.startswith("_")]
    cells = P.to_cells(t.withColumn("_row", F.col("o_orderkey")), "orders", "_row", names)
    kinds = [("orders", "orders", c, i, "identifier" if c == "o_orderkey" else "text") for i, c in enumerate(names)]
    return R.identifier_rows(cells, spark.createDataFrame(kinds, "doc_id string, dataset string, column string, position int, semantic_type string"))


_ORDER_SAID = "'o_custkey ' || o_custkey || ', o_orderstatus ' || o_orderstatus || ', o_totalprice ' || o_totalprice || ', o_orderdate ' || o_orderdate::VARCHAR || ', o_orderpriority ' || o_orderpriority"


@query(f"""SELECT o_orderkey AS question_id, 'For o_orderkey "' || o_orderkey || '" in "orders": ' || {_ORDER_SAID} || '.' AS answer, 'orders' AS source, CASE WHEN o_orderkey < 10 THEN 0.5 ELSE 1 END::DOUBLE AS score FROM orders WHERE o_orderkey % 20 = 0""")
def order_answers(spark, sf_dir):
    """Every twentieth order is asked for; all facts of orders are searched."""
    q = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("question_id"), F.lit("orders").alias("doc_id"), F.concat(F.lit("What do the orders say of "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"))
    return R.best_facts(q, R.identifier_facts(_order_rows(spark, sf_dir)))


@query(f"""WITH q AS (SELECT o_orderkey AS question_id, 'compare ' || o_orderkey || ' versus ' || (o_orderkey + 1) AS t FROM orders WHERE o_orderkey % 20 = 0),
m AS (SELECT question_id, o.o_orderkey AS k, o.o_orderkey || ' (orders): ' || {_ORDER_SAID} || '.' AS s FROM q JOIN orders o ON contains(q.t, o.o_orderkey::VARCHAR) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY o.o_orderkey) <= 4)
SELECT question_id, string_agg(s, chr(10) ORDER BY k) AS answer FROM m GROUP BY question_id HAVING count(*) >= 2""")
def order_comparisons(spark, sf_dir):
    """Every twentieth order beside its next one: the orders whose keys stand in the question, the first four."""
    q = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("question_id"), F.lit("orders").alias("doc_id"), F.concat(F.lit("compare "), F.col("o_orderkey").cast("string"), F.lit(" versus "), (F.col("o_orderkey") + 1).cast("string")).alias("question"))
    return R.comparisons(q, R.comparables(_order_rows(spark, sf_dir)))


# --- market reports written from the tables


def _reports(spark, sf_dir):
    """A daily report for each part; its figures follow from the part's key and size."""
    n = lambda c: F.format_number(c.cast("double"), 0)
    size, key = F.col("p_size"), F.col("p_partkey")
    equity = F.concat_ws(" ", F.concat(F.lit("RW"), F.lpad(key.cast("string"), 10, "0")), F.concat(F.lit("T"), F.char(key % 26 + 65), F.lit("X")), n(size + 2), n(size), n(size + 1), n(size), F.concat(n(size), F.lit(".5")), n(size), F.lit("0.5"), n(size * 1000), n(size * 2000))
    said = [
        F.lit("RWANDA STOCK EXCHANGE DAILY REPORT 7TH SEPTEMBER 2026"), equity,
        F.concat(F.lit("Shares traded 10,000 "), n(size * 100), F.lit(" 5 1.0")), F.concat(F.lit("Equity Turnover 1,000 "), n(size * 1000), F.lit(" 5 1.0")), F.concat(F.lit("Number of deals 3 "), n(size), F.lit(" 1 33.3")),
        F.concat(F.lit("RSI "), n(size), F.lit(".25 "), n(size + 1), F.lit(".75 1.50 -2.00")), F.concat(F.lit("USD "), n(size + 1002), F.lit(".39 "), n(size + 1001), F.lit(".29 "), n(size + 1000), F.lit(".19")),
        F.concat(F.lit("Market Capitalization (Frw) "), n(key * 1000 + 1)), F.concat(F.lit("turnover of Frw "), n(size * 500), F.lit(" worth of bonds traded in "), n(size), F.lit(" deals")),
        F.concat(F.lit("Repo Market, 3 deals worth Frw "), n(size), F.lit(" million were traded for a 7-day tenor with average rate of 8.75%")),
        F.lit("a. Government bonds"), F.concat(F.lit("RW000A1 Re-opened FXD"), n(size), F.lit("/2020/15Yrs 01/02/2035 12.5% 100.80 100.85 0 0 "), n(size * 1000)),
        F.lit("b. Corporate bonds"), F.lit("RW000B1 EQT1/2021/5Yrs 01/03/2026 11.0% 99.5 99.5 0 0 0"), F.lit("end"),
    ]
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(key.alias("doc_id"), F.concat_ws("\n", *said).alias("text"))


@query("""SELECT p_partkey AS doc_id, 'RW' || lpad(p_partkey::VARCHAR, 10, '0') AS isin, 'T' || chr((65 + p_partkey % 26)::INTEGER) || 'X' AS ticker, (p_size + 2)::DOUBLE AS high_12m, p_size::DOUBLE AS low_12m, p_size + 0.5::DOUBLE AS closing, (p_size * 1000)::BIGINT AS volume, (p_size * 2000)::DOUBLE AS value FROM part""")
def market_equities(spark, sf_dir):
    return M.equities(_reports(spark, sf_dir)).select("doc_id", "isin", "ticker", "high_12m", "low_12m", "closing", "volume", "value")


@query("SELECT p_partkey AS doc_id, 'RSI' AS name, p_size + 0.25::DOUBLE AS previous, p_size + 1.75::DOUBLE AS today, p_size + 1.75::DOUBLE AS closing, 1.5::DOUBLE AS points_change, -2.0::DOUBLE AS percent_change FROM part")
def market_indices(spark, sf_dir):
    return M.indices(_reports(spark, sf_dir)).select("doc_id", "name", "previous", "today", "closing", "points_change", "percent_change")


@query("SELECT p_partkey AS doc_id, 'USD' AS currency, round(p_size + 1001.29::DOUBLE, 2) AS buying, round(p_size + 1002.39::DOUBLE, 2) AS selling, round(p_size + 1000.19::DOUBLE, 2) AS average FROM part UNION ALL SELECT p_partkey, 'RSI', p_size + 1.75, p_size + 0.25, 1.5 FROM part")
def market_rates(spark, sf_dir):
    """Any three capitals before three amounts, an index's, too, as the format has it."""
    return M.exchange_rates(_reports(spark, sf_dir)).select("doc_id", "currency", "buying", "selling", "average")


@query("""SELECT p_partkey AS doc_id, (p_size * 1000)::DOUBLE AS equity_turnover, p_size::BIGINT AS equity_deals, (p_size * 100)::DOUBLE AS shares_traded, (p_size * 500)::DOUBLE AS bond_turnover, p_size::BIGINT AS bond_deals,
(p_partkey * 1000 + 1)::DOUBLE AS market_capitalization, 3::BIGINT AS repo_deals, p_size * 1e6 AS repo_turnover, '7-day' AS repo_tenor, 8.75::DOUBLE AS repo_rate FROM part""")
def market_overviews(spark, sf_dir):
    return M.overview(_reports(spark, sf_dir)).select("doc_id", "equity_turnover", "equity_deals", "shares_traded", "bond_turnover", "bond_deals", "market_capitalization", "repo_deals", "repo_turnover", "repo_tenor", "repo_rate")


@query("""SELECT p_partkey AS doc_id, 'TREASURY' AS category, 'RW000A1' AS isin, 'Re-opened' AS status, 'FXD' || p_size || '/2020/15Yrs' AS security, 'FXD' || p_size || '/2020/15Yrs (Re-opened)' AS label, '2035-02-01' AS maturity_date, 12.5::DOUBLE AS coupon_rate, 100.8::DOUBLE AS closing_price, (p_size * 1000)::DOUBLE AS bond_traded FROM part
UNION ALL SELECT p_partkey, 'CORPORATE', 'RW000B1', NULL, 'EQT1/2021/5Yrs', 'EQT1/2021/5Yrs', '2026-03-01', 11, 99.5, 0 FROM part""")
def market_bonds(spark, sf_dir):
    return M.bonds(_reports(spark, sf_dir)).select("doc_id", "category", "isin", "status", "security", "label", F.col("maturity_date").cast("string").alias("maturity_date"), "coupon_rate", "closing_price", "bond_traded")


@query("""SELECT p_partkey AS doc_id, 'What was the closing price of T' || chr((65 + p_partkey % 26)::INTEGER) || 'X?|How did the index RSI do?|What is the market capitalization?|What was the equity turnover?|What is the exchange rate of USD?|How many bonds are listed (2)?' AS questions FROM part""")
def market_questions(spark, sf_dir):
    d = _reports(spark, sf_dir)
    tables = {"equities": M.equities(d), "indices": M.indices(d), "market_overview": M.overview(d), "exchange_rates": M.exchange_rates(d), "bonds": M.bonds(d)}
    return R.suggested_market_questions(tables).select("doc_id", F.array_join("questions", "|").alias("questions"))


# --- tables over pages, nested exports, owners, routing


@query("""SELECT o_orderkey // 100 AS doc_id, '1' AS table_id, (row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey))::BIGINT AS row_no, o_orderkey::VARCHAR AS first_cell,
'pages 1-' || (max(o_orderkey % 100 // 10) OVER (PARTITION BY o_orderkey // 100) + 1) AS source FROM orders WHERE o_orderkey // 100 * 100 + 10 <= (SELECT max(o_orderkey) FROM orders)""")
def continued_tables(spark, sf_dir):
    """A table of each hundred orders, ten a page under a repeated header, put together again."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("doc_id"), (F.floor(F.col("o_orderkey") % 100 / 10) + 1).cast("int").alias("page_no"), F.lit(1).alias("table_no"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("row_no"), F.array(F.col("o_orderkey").cast("string"), "o_orderpriority").alias("cells"))
    several = o.filter("page_no = 2").select("doc_id").distinct()
    o = o.join(several, "doc_id", "left_semi")
    head = o.select("doc_id", "page_no", "table_no", F.lit(0).alias("row_no"), F.array(F.lit("Order"), F.lit("Priority")).alias("cells")).distinct()
    return H.merge_continued(o.unionByName(head)).filter("row_no > 0").select("doc_id", "table_id", F.col("row_no").cast("long").alias("row_no"), F.get("cells", F.lit(0)).alias("first_cell"), "source")


@query("""SELECT c.c_custkey AS doc_id, count(o.o_orderkey)::BIGINT AS n_orders, coalesce(sum(o.o_orderkey), 0)::BIGINT AS order_keys FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def json_exports(spark, sf_dir):
    """One document a customer with its orders inside, as text and read back."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderstatus")
    text = sinks.json_documents(c, {"orders": o}).select(F.to_json(F.struct("*")).alias("t"))
    r = text.select(F.from_json("t", "doc_id long, c_name string, orders array<struct<o_orderkey: long, o_orderstatus: string>>").alias("r"))
    keys = F.coalesce(F.col("r.orders.o_orderkey"), F.array().cast("array<long>"))
    return r.select("r.doc_id", F.size(keys).cast("long").alias("n_orders"), F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a + x).alias("order_keys"))


@query("SELECT o_orderkey AS doc_id, o_custkey AS owner FROM orders WHERE contains('user' || o_custkey || '@example.org', 'user1') AND o_orderstatus = 'F'")
def owner_filter(spark, sf_dir):
    """Documents of owners whose address holds a text, of one state."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("User"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("owner_email"))
    return C.catalog_filter(d, status="F", owner_email="USER1").select("doc_id", "owner")


@query("""SELECT p_partkey AS doc_id, p_partkey % 4 IN (0, 2) AS is_report FROM part""")
def report_kinds(spark, sf_dir):
    """Market reports among files: by the exchange's name in a pdf, by two known sheets in a workbook."""
    k = F.col("doc_id") % 4
    d = _reports(spark, sf_dir).withColumn("kind", F.when(k < 2, "pdf").otherwise("excel")).withColumn("text", F.when(k == 1, "an other report").otherwise(F.col("text")))
    sheets = F.when(k == 2, F.array(F.lit(" stock "), F.lit("Bonds"), F.lit("x"))).otherwise(F.array(F.lit("stock"), F.lit("x")))
    return d.select("doc_id", M.is_market_report(F.col("kind"), F.col("text"), sheets).alias("is_report"))


@query("""SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN 'passage' WHEN o_orderkey % 7 = 0 THEN 'comparison' WHEN o_orderkey % 3 = 0 THEN 'fact' WHEN o_orderkey % 5 = 0 THEN 'passage' WHEN o_orderkey % 4 = 0 THEN 'section' WHEN o_orderkey % 5 = 1 THEN 'passage' ELSE '-' END AS answer,
CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 THEN 'medium' WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN 'high' WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM orders""")
def routed_answers(spark, sf_dir):
    """A question for each order, odd ones about all documents, with what the engines found for some of them."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.when(F.col("o_orderkey") % 2 == 1, "all").otherwise("document").alias("scope"))
    found = lambda n, what: q.filter(F.col("question_id") % n == 0).select("question_id", F.lit(what).alias("answer"))
    passages = q.filter(F.col("question_id") % 5 < 2).select("question_id", F.lit("passage").alias("answer"), F.when(F.col("question_id") % 5 == 0, "medium").otherwise("low").alias("confidence"))
    got = R.answers(q, found(7, "comparison"), found(3, "fact"), found(4, "section"), passages)
    return got.withColumn("answer", F.when(F.col("answer").isin("comparison", "fact", "section", "passage"), F.col("answer")).otherwise("-"))


@query("""SELECT 'Total l_extendedprice' AS headline_label, round(sum(l_extendedprice), 2) AS headline_value FROM lineitem""")
def headline_lineitem(spark, sf_dir):
    """The figure that stands over a document: its first sum of money."""
    t = table(spark, sf_dir, "lineitem").withColumn("_row", F.monotonically_increasing_id())
    cells = P.to_cells(t, "lineitem", "_row", ["l_quantity", "l_extendedprice", "l_tax"])
    rows = cells.groupBy("doc_id", "dataset").agg(F.count_if(F.col("position") == 0).alias("row_count"))
    return G.headline(G.metrics(P.profile(cells), rows)).select("headline_label", F.round("headline_value", 2).alias("headline_value"))
