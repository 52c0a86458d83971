import collections
import csv
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.functions import words as T
from veritab.operators import catalog as C
from veritab.operators import findings as G
from veritab.operators import market as M
from veritab.operators import profile as P
from veritab.operators import retrieve as R
from veritab.operators import search as Q
from veritab.operators import series as V
from veritab.operators import shape as H
from veritab.plans import registry
from veritab.sources import readers
from veritab.sources.delimited import read_grids
from veritab.sources.index import ChunkIndex, index_documents


def cells_of(spark, columns, name="sales"):
    """Cells of one table given as {column: values}."""
    rows = [("d", name, c, i, r + 2, None if v is None else str(v)) for i, (c, vs) in enumerate(columns.items()) for r, v in enumerate(vs)]
    return spark.createDataFrame(rows, P.CELLS)


@pytest.fixture(scope="module")
def sales(spark):
    n = 12
    cells = cells_of(spark, {
        "Date": [f"2025-{1 + i // 4:02d}-{10 + i}" for i in range(n)], "Region": [["East", "West", "North"][i % 3] for i in range(n)],
        "Revenue": [100 * (i + 1) for i in range(n)], "Units Sold": [2 * i + 5 for i in range(n)], "Discount %": [f"{i % 3 * 5}%" for i in range(n)], "Employee ID": [f"E{i:03d}" for i in range(n)], "Notes": [None] * n,
    })
    return cells, P.profile(cells), G.dataset_counts(cells)


def test_profile(sales):
    kinds = {r.column: (r.semantic_type, r.confidence) for r in sales[1].collect()}
    assert kinds == {"Date": ("date", "high"), "Region": ("category", "medium"), "Revenue": ("currency", "medium"), "Units Sold": ("quantity", "medium"), "Discount %": ("percentage", "high"), "Employee ID": ("identifier", "medium"), "Notes": ("text", "low")}


def test_unparsed_is_not_missing(spark):
    r = P.profile(cells_of(spark, {"Revenue": ["4800000", "N/A", "3400000", "5600000", "2100000", "1900000", None]})).first()
    assert (r.unparsed_count, r.missing_count, r.negative_count, r.semantic_type) == (1, 2, 0, "currency")


def test_free_dates(spark):
    got = P.profile(cells_of(spark, {"When": ["2024 5 March", "1st of x", "5 Mar. 2024", "Tue 5 Mar 2024", "6 Mar 2024"]}), free_dates=True).first()
    assert P.profile(cells_of(spark, {"When": ["2024 5 March"] * 5})).first().semantic_type == "category"
    assert (got.semantic_type, got.unparsed_count, got.non_null_count) == ("date", 1, 5)


def test_metrics_and_headline(sales):
    m = G.metrics(sales[1], sales[2])
    got = {r.label: r.value for r in m.collect()}
    assert got["Total Revenue"] == 7800.0 and got["Average Discount %"] == 5.0 and got["Records in sales"] == 12.0
    assert G.headline(m).first().headline_label == "Total Revenue"


def test_insights(sales):
    texts = [r.text for r in G.insights(*sales).orderBy("insight_no").collect()]
    assert any("ranges from 100 to 1,200" in t for t in texts) and any("increased" in t for t in texts) and any("positively" in t for t in texts) and any("leads" in t for t in texts)


def test_no_insight_on_constants(spark):
    cells = cells_of(spark, {"Value": [5, 5, 5]})
    assert G.insights(cells, P.profile(cells), G.dataset_counts(cells)).filter("kind_no = 1").count() == 0


def test_z_score(spark):
    cells = cells_of(spark, {"Value": [100] * 9 + [1000]})
    r = G.z_outliers(cells, P.profile(cells)).first()
    assert r.value == 1000.0 and abs(r.score - 3.0) < 1e-9 and r.severity == "medium"


def test_totals(spark):
    cells = cells_of(spark, {"Region": ["North", "South", "Total"], "Sales": [100, 100, 500]})
    p = P.profile(cells)
    p = p.withColumn("semantic_type", F.when(F.col("column") == "Region", "category").otherwise(F.col("semantic_type")))
    assert [(r.value, r.score) for r in G.mismatched_totals(cells, p).collect()] == [(500.0, 200.0)]
    assert [(r.claimed, r.computed) for r in G.total_mismatches(cells, p).collect()] == [(500.0, 200.0)]


def test_quality(spark):
    clean = cells_of(spark, {"Amount": [10, 20, 30]})
    scores, issues = G.quality(clean, P.profile(clean), G.dataset_counts(clean))
    assert scores.first().quality_score == 100 and issues.count() == 0
    mixed = cells_of(spark, {"Price": ["$10", "FRW 5000", None]})
    scores, issues = G.quality(mixed, P.profile(mixed), G.dataset_counts(mixed))
    assert scores.first().quality_score < 100 and {r.type for r in issues.collect()} == {"missing_values", "inconsistent_units"}


def test_issues_and_ranking(sales, spark):
    cells = cells_of(spark, {"Employee ID": [f"E{i:03d}" for i in range(1, 11)] + ["E001"], "Revenue": [1, 2, -3] * 3 + [4, 5]})
    p, n = P.profile(cells), G.dataset_counts(cells)
    rules = {r.rule_id for r in G.issues(p, n).collect()}
    assert {"duplicate_identifiers", "negative_values"} <= rules
    _, quality = G.quality(cells, p, n)
    found = spark.createDataFrame([("d", "high", "odd", 1)], "doc_id string, severity string, message string, rank int")
    top = G.what_matters(quality, found, spark.createDataFrame([("d", "seen")], "doc_id string, text string")).orderBy("rank").collect()
    assert top[0].message == "odd" and top[-1].category == "discovery"


def test_alerts(spark):
    rules = spark.createDataFrame([("d", "s", "Revenue", "gt", 250.0), ("d", "s", "None", "lt", 1.0)], "doc_id string, dataset string, column string, operator string, threshold double")
    totals = spark.createDataFrame([("d", "s", "Revenue", 300.0)], "doc_id string, dataset string, column string, total double")
    got = {r.column: (r.value, r.triggered) for r in G.evaluate_alerts(rules, totals, ["doc_id", "dataset", "column"]).collect()}
    assert got == {"Revenue": (300.0, True), "None": (None, False)}


@pytest.mark.parametrize("rows_each", [1, 40])
def test_series_equal_windows(spark, rows_each):
    """One key with two thirds of the rows, a null key and ties: places, rows before and jumps as windows give them."""
    t = spark.range(900).repartition(5).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.floor(F.col("id") / 100).cast("string"))).alias("k"), F.expr("date_add('2020-01-01', cast(id % 300 as int))").alias("d"), (F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")).alias("v"))
    w = W.partitionBy("k").orderBy("d", "id")
    want = {(r.id, r.n, r.p) for r in t.select("id", (F.row_number().over(w) - 1).alias("n"), F.lag("v").over(w).alias("p")).collect()}
    got = V.with_previous(t, ["k"], ["d", "id"], ["v"]).select("id", "place", "previous.v").collect()
    assert {tuple(r) for r in got} == want
    assert {(r.id, r.n) for r in V.numbered(t, ["k"], ["d", "id"], "n").collect()} == {x[:2] for x in want}
    for keys in (["k"], []):
        moved = t.withColumn("p", F.lag("v").over(W.partitionBy(*keys).orderBy("d", "id"))).withColumn("c", F.try_divide(F.col("v") - F.col("p"), F.abs("p"))).filter(F.abs("c") >= 0.5)
        assert {(r.id, r.change) for r in G.jumps(t, keys, "d", "v", "id").collect()} == {(r.id, r.c) for r in moved.collect()}


def test_correlations_of_constant_and_sparse_columns(spark):
    rng = random.Random(4)
    rows = [("d", s, c, p, r, x) for s in ("a", "b") for r in range(40) for p, (c, x) in enumerate([("one", str(r + rng.random())), ("two", str(1e9 - 3 * r)), ("flat", "5.1"), ("few", str(r) if r < 4 else None), ("gaps", str(rng.random()) if r % 3 else "n/a")])]
    cells = spark.createDataFrame(rows, "doc_id string, dataset string, column string, position int, source_row long, value string")
    kinds = spark.createDataFrame([("d", s, c, p, "number", m) for s in ("a", "b") for p, (c, m) in enumerate([("one", 20.0), ("two", 1e9), ("flat", 5.0), ("few", 1.0), ("gaps", None)])], "doc_id string, dataset string, column string, position int, semantic_type string, mean double")
    got = {(r.dataset, r.a, r.b): (r.pairs, r.r) for r in G.correlations_of_cells(cells, kinds).collect()}
    frame = {(s, c): {r: float(x) for _, s2, c2, _, r, x in rows if (s2, c2) == (s, c) and x not in (None, "n/a")} for s in ("a", "b") for c in ("one", "two", "gaps")}
    assert set(got) == {(s, a, b) for s in ("a", "b") for a, b in (("one", "two"), ("one", "gaps"), ("two", "gaps"))}
    for (s, a, b), (n, r) in got.items():
        both = sorted(frame[s, a].keys() & frame[s, b].keys())
        assert n == len(both) and abs(r - np.corrcoef([frame[s, a][i] for i in both], [frame[s, b][i] for i in both])[0, 1]) < 1e-9


def test_grids(spark):
    grid = spark.createDataFrame([("d", "t", 0, ["", ""]), ("d", "t", 1, ["Name", "Name", ""]), ("d", "t", 2, ["Ada", "1"]), ("d", "t", 3, [" ", None]), ("d", "t", 4, ["Bob", "2", "x"])], "doc_id string, table_id string, row_no int, cells array<string>")
    cells, counts = H.grids_to_cells(grid)
    assert {(r.column, r.source_row): r.value for r in cells.collect()} == {("Name", 3): "Ada", ("Name (2)", 3): "1", ("Column 3", 3): None, ("Name", 5): "Bob", ("Name (2)", 5): "2", ("Column 3", 5): "x"}
    assert counts.first()[2:] == (2, 1)


def test_page_breaks(spark):
    rows = [("d", p, t, r, c) for p, t, cs in [(1, 1, [["Name", "Amount"], ["a", "1"]]), (2, 1, [["Name", "Amount"], ["b", "2"]]), (2, 2, [["Name", "Amount"], ["c", "3"]]), (3, 1, [["Other", "X"], ["d", "4"]])] for r, c in enumerate(cs)]
    got = H.merge_continued(spark.createDataFrame(rows, "doc_id string, page_no int, table_no int, row_no int, cells array<string>")).collect()
    assert {(r.table_id, r.source) for r in got} == {("1", "pages 1-2"), ("2", "page 2"), ("3", "page 3")}
    assert sum(r.table_id == "1" for r in got) == 3


def test_merged_cells(spark):
    cells = spark.createDataFrame([("d", "s", 2, 1, "East Africa"), ("d", "s", 3, 1, None), ("d", "s", 3, 2, "South")], "doc_id string, sheet string, r int, c int, value string")
    ranges = spark.createDataFrame([("d", "s", 2, 1, 3, 1)], "doc_id string, sheet string, r1 int, c1 int, r2 int, c2 int")
    assert {(r.r, r.c): r.value for r in H.fill_merged(cells, ranges).collect()} == {(2, 1): "East Africa", (3, 1): "East Africa", (3, 2): "South"}


def test_text_tables_and_sections(spark):
    text = "Fuel Log\n\nWe drove a lot,\nyes.\n\nVehicle,Distance,Cost\nA,10,\"1,5\"\nB,20,6\n\nNotes\n\nAll fine."
    lines = H.text_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    tables, prose = H.table_runs(lines)
    assert [r.cells for r in tables.orderBy("row_no").collect()] == [["Vehicle", "Distance", "Cost"], ["A", "10", "1,5"], ["B", "20", "6"]]
    assert [(r.title, r.content) for r in H.sections(prose).orderBy("section_no").collect()] == [("Fuel Log", "We drove a lot,\nyes."), ("Notes", "All fine.")]


def test_json(spark):
    docs = spark.createDataFrame([("a", '{"meta": {}, "results": [1, 2], "data": [{"x": 1}]}'), ("b", '{"orders": [{}], "customers": [{}]}'), ("c", "[1]"), ("d", '{"x": 1}'), ("e", "{")], "doc_id string, text string")
    got = {}
    for r in readers.select_records(docs).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.table, r.warning is not None))
    assert got == {"a": [("data", False)], "b": [("orders", True), ("customers", True)], "c": [("records", False)], "d": [("records", False)], "e": [(None, True)]}
    rows = spark.createDataFrame([(0, ("o1", "K"), [(1.0,), (2.0,)], ["a", None])], "_index int, head struct<order_id:string,city:string>, line_items array<struct<qty:double>>, tags array<string>")
    assert H.flatten(rows).columns == ["_index", "head.order_id", "head.city", "tags"] and H.flatten(rows).first()["tags"] == "a; "
    child = H.child_tables(rows.select("_index", F.col("head.order_id").alias("order_id"), "line_items"))["line_items"].collect()
    assert [(r.qty, r._json_path, r._parent_ref) for r in child] == [(1.0, "$[0].line_items[0]", "o1"), (2.0, "$[0].line_items[1]", "o1")]


REPORT = """RWANDA STOCK EXCHANGE DAILY REPORT 7TH SEPTEMBER 2026
RW0000000001 BOK 700 500 660 650 660 655 5 21,600 14,256,000
RW0000000002 BLR 200 100 150 150 150 150 0 0 0
Shares traded 10,000 21,700 11,700 117.0
Equity Turnover 1,000 14,307,500 5 1.0
Number of deals 3 4 1 33.3
RSI 210.00 214.08 4.08 1.94
USD 1,476.39 1,466.39 1,471.39
Market Capitalization (Frw) 6,634,919,683,716
turnover of Frw 206,685,500 worth of bonds traded in 5 deals
Repo Market, 3 deals worth Frw 10 billion were traded for a 7-day tenor with average rate of 8.75%
a. Government bonds
RW000A1 Re-opened FXD2/2020/15Yrs 01/02/2035 12.5% 100.80 100.85 0 0 52,000,000
b. Corporate bonds
RW000B1 EQT1/2021/5Yrs 01/03/2026 11.0% 99.5 99.5 0 0 0
"""


def test_market(spark):
    docs = spark.createDataFrame([("d", REPORT), ("e", None)], "doc_id string, text string")
    eq = M.validate_equities(M.equities(docs))
    assert {r.ticker: (r.closing, r.volume, r.value) for r in eq.collect()}["BOK"] == (660.0, 21600, 14256000.0)
    o = M.validate_overview(M.overview(docs)).filter("doc_id = 'd'").first()
    assert (o.equity_turnover, o.equity_deals, o.bond_deals, o.market_capitalization, o.repo_turnover, o.repo_tenor, o.repo_rate) == (14307500.0, 4, 5, 6634919683716.0, 1e10, "7-day", 8.75)
    t = M.titles(docs).filter("doc_id = 'd'").first()
    assert str(t.report_date) == "2026-09-07" and t.report_title.startswith("RWANDA")
    assert [(r.buying, r.selling) for r in M.validate_rates(M.exchange_rates(docs)).filter("currency = 'USD'").collect()] == [(1466.39, 1476.39)]
    b = M.validate_bonds(M.bonds(docs))
    assert {(r.category, r.label) for r in b.collect()} == {("TREASURY", "FXD2/2020/15Yrs (Re-opened)"), ("CORPORATE", "EQT1/2021/5Yrs")}
    trade = M.validate_trades(M.derive_trades(b)).first()
    assert (trade.bond, trade.volume, trade.change) == ("FXD2/2020/15Yrs (Re-opened)", 52000000.0, -0.05)
    idx = M.validate_indices(M.indices(docs))
    assert M.find_index(idx, "rsi").first().closing == 214.08
    assert M.rankings(eq).filter("ranking = 'gainers' AND rank = 1").first().ticker == "BOK"
    assert M.market_insights(eq, idx, b, M.overview(docs)).count() >= 4
    assert {r.doc_id: r.status for r in M.document_status(docs, [eq, idx]).collect()} == {"d": "completed", "e": "failed"}
    cells = M.to_cells({"equities": eq})
    kinds = {r.column: r.semantic_type for r in P.profile(cells).collect()}
    assert kinds["ticker"] == "category" and kinds["isin"] == "identifier"


def test_versions(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v int") for xs in ([100], [100, 300]))
    assert C.version_diff(a, b, ["v"]).first() == (1, 0, False)
    assert C.version_diff(a, a, ["v"]).first() == (0, 0, True)
    m = C.compare_metrics(spark.createDataFrame([("x", 0.0), ("y", 2.0)], "label string, value double"), spark.createDataFrame([("x", 1.0), ("y", 3.0)], "label string, value double"))
    assert {r.label: (r.delta, r.percent) for r in m.collect()} == {"x": (1.0, None), "y": (1.0, 50.0)}


def test_retrieval_keeps_owners_apart(spark):
    docs = [("w", "A", "Warehouse stock levels rose in the Kigali warehouse."), ("p", "A", "Payroll costs fell for the payroll team."), ("s", "B", "Secret warehouse plans.")]
    cat = spark.createDataFrame([(d, u, "completed", f"{d}.txt") for d, u, _ in docs], "doc_id string, user_id string, status string, filename string")
    sections = spark.createDataFrame([(d, 1, "Page 2", t) for d, _, t in docs], "doc_id string, section_no int, title string, content string")
    chunks = R.build_chunks([R.section_chunks(sections)])
    q = spark.createDataFrame([("q1", "A", "warehouse stock levels"), ("q2", "A", "zebra giraffe")], "question_id string, user_id string, question string")
    hits = R.retrieve(q, chunks, cat)
    assert {r.doc_id for r in hits.collect()} == {"w"}
    a = R.extractive_answers(hits).first()
    assert a.question_id == "q1" and a.sources == ["w.txt, page 2"]
    f = spark.createDataFrame([("w", 1, ["bok"], "general", "x"), ("w", 2, ["bok", "closing", "price"], "specific", "x")], "doc_id string, fact_no int, keywords array<string>, answer string, source string")
    fq = spark.createDataFrame([("1", "w", "bok closing price"), ("2", "w", "weather")], "question_id string, doc_id string, question string")
    assert [(r.question_id, r.answer) for r in R.best_facts(fq, f).collect()] == [("1", "specific")]


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    got = spark.createDataFrame([(text,), ("",), (None,), ("short",)], "t string").select(R.split_text(F.col("t")).alias("c")).collect()
    assert got[1].c == [] and got[2].c == [] and got[3].c == ["short"]
    assert all(len(c) <= 1200 and c in text for c in got[0].c) and len(got[0].c) > 4
    for a, b in zip(got[0].c, got[0].c[1:], strict=False):
        assert text.index(b) < text.index(a) + len(a)


def test_embedding_norm(spark):
    e = R.hash_embedding(spark.createDataFrame([(1, "alpha beta gamma beta"), (2, "")], "k int, t string"), ["k"], "t")
    assert abs(e.filter("k = 1").agg(F.sum(F.col("weight") ** 2)).first()[0] - 1) < 1e-9 and e.filter("k = 2").count() == 0


def test_cosine_search_is_whole(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (130, 8)).astype(np.float32)
    v[30:50] = v[20]  # ties
    v[7] = 0
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = collections.defaultdict(list)
    for r in registry.QUERIES["cosine_topk"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    w = v.astype(np.float64)
    norm = np.sqrt((w * w).sum(axis=1))
    assert sorted(got) == list(range(0, 130, 20))
    for q in got:
        s = [float(w[i] @ w[q] / (norm[i] * norm[q])) if norm[i] else 0.0 for i in range(130)]
        want = sorted((i for i in range(130) if i != q), key=lambda i: (-round(s[i], 9), i))[:8]
        assert [i for i, _ in got[q]] == want and all(abs(x - s[i]) < 1e-6 for i, x in got[q])


def brute_embedding(text):
    w = [x for x in re.findall(r"[a-z0-9%]+(?:['.][a-z0-9]+)*", (text or "").lower()) if x not in T.QUESTION_STOPWORDS and len(x) > 1]
    sums = collections.Counter()
    for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]:
        d = hashlib.md5(f.encode()).digest()
        sums[int.from_bytes(d[:4], "little") % 512] += 1 if d[4] % 2 else -1
    norm = sum(x * x for x in sums.values()) ** 0.5
    return {b: x / norm for b, x in sums.items() if x}


def test_hash_embed_texts_is_whole(spark, tmp_path):
    long = " ".join(f"w{i * i % 7919}" for i in range(20_000))
    docs, turns = [(0, "alpha beta"), (1, None), (2, long), (3, "the a")], [(0, 0, "alpha beta gamma"), (0, 1, "beta"), (7, 0, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = collections.defaultdict(dict)
    for r in registry.QUERIES["hash_embed_texts"](spark, str(tmp_path)).collect():
        got[r.source, r.id, r.turn][r.bucket] = r.weight
    want = {("documents", i, None): brute_embedding(t) for i, t in docs} | {("conversations", i, k): brute_embedding(t) for i, k, t in turns}
    assert got.keys() == {k for k, e in want.items() if e}
    for k, e in got.items():
        assert e.keys() == want[k].keys() and all(abs(e[b] - want[k][b]) < 2e-9 for b in e)


def test_facts_of_rows_and_entities(spark, sales):
    cells, columns, _ = sales
    more = cells_of(spark, {"Employee ID": ["E003", "E900", None, "E901"], "Salary": [700, 800, 900, None]}, "pay")
    columns = columns.select(*P.KEY, "column", "position", "semantic_type", "min", "max").unionByName(spark.createDataFrame([("d", "pay", "Employee ID", 0, "identifier", None, None), ("d", "pay", "Salary", 1, "currency", 700.0, 900.0)], "doc_id string, dataset string, column string, position int, semantic_type string, min double, max double"))
    cells = cells.unionByName(more)
    none = lambda s: spark.createDataFrame([], s)
    kind, text = spark.createDataFrame([("d", "HR")], "doc_id string, document_type string"), spark.createDataFrame([("d", "Salary review: salary rose 5% on 3 March; paid January 2025.")], "doc_id string, text string")
    f = R.facts(kind, none("doc_id string, dataset string, row_count long"), columns, none("doc_id string, label string, value double"), none("doc_id string, text string"), cells, R.mentions(text)).cache()
    assert f.select("doc_id", "fact_no").distinct().count() == f.count()
    rows = {r.answer for r in f.filter(F.col("fact_no") >= R.ROW_FACTS).collect()}
    want = {f'For Employee ID "E{i:03d}" in "sales": Date 2025-{1 + i // 4:02d}-{10 + i}, Region {["East", "West", "North"][i % 3]}, Revenue {100 * (i + 1)}, Units Sold {2 * i + 5}, Discount % {i % 3 * 5}%.' for i in range(12)}
    assert rows == want | {'For Employee ID "E003" in "pay": Salary 700.', 'For Employee ID "E900" in "pay": Salary 800.'}
    said = {r.source: r.answer for r in f.filter("source LIKE 'Entities%'").collect()}
    assert said == {"Entities: dates": "Dates mentioned: January 2025.", "Entities: numbers": "Numbers and percentages mentioned: 5%.", "Entities: keywords": "Terms mentioned often: salary."}
    q = spark.createDataFrame([("1", "d", "pay of E900"), ("2", "d", "Compare E001 and E900"), ("3", "d", "topics keywords themes terms")], "question_id string, doc_id string, question string")
    got = {r.question_id: r.answer for r in R.best_facts(q, f).collect()}
    assert got["1"] == 'For Employee ID "E900" in "pay": Salary 800.' and got["3"] == "Terms mentioned often: salary."
    entities = R.comparables(R.identifier_rows(cells, columns))
    assert entities.count() == 13
    assert R.comparisons(q, entities).first().answer.split("\n") == ["E900 (pay): Salary 800.", "E001 (sales): Date 2025-01-11, Region West, Revenue 200, Units Sold 7, Discount % 5%."]


def test_samples_come_from_the_whole_column(spark):
    late = P.profile(cells_of(spark, {"Late": [None] * 60 + ["b", "a", "b", "c", None, "d", "e", "f"], "Blank": [None] * 68}))
    far = P.profile(spark.createDataFrame([("d", "far", "x", 0, 10**6 + r, f"v{r}") for r in range(3)], P.CELLS))
    assert {r.column: r.sample_values for r in late.unionByName(far).collect()} == {"Late": ["b", "a", "c", "d", "e"], "Blank": [], "x": ["v0", "v1", "v2"]}


def test_catalog_page_is_clamped(spark):
    cat = spark.range(45).select(F.col("id").alias("doc_id"))
    rows, n, pages = C.page(cat, [F.col("doc_id")], 9, 20)
    assert (n, pages, rows.count()) == (45, 3, 5)


def test_chunk_index_shows_whole_versions(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"))
    seen = lambda: {(r.doc_id, r.content) for r in index.read().collect()}
    assert index.read() is None
    index.replace(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "yy")], "doc_id string, chunk_no int, content string"))
    index.replace(spark.createDataFrame([("a", 1, "z")], "doc_id string, chunk_no int, content string"))
    assert seen() == {("a", "z"), ("b", "y"), ("b", "yy")}
    # A write that dies in the middle leaves files but no commit: readers see what was there.
    broken = spark.range(100, numPartitions=4).select(F.lit("a").alias("doc_id"), F.col("id").cast("int").alias("chunk_no"), F.when(F.col("id") < 90, "new").otherwise(F.raise_error(F.lit("lost"))).alias("content"))
    with pytest.raises(Exception, match="lost"):
        index.replace(broken)
    assert seen() == {("a", "z"), ("b", "y"), ("b", "yy")} and len(index.commits()) == 2
    index.delete(spark.createDataFrame([("b",)], "doc_id string"))
    assert seen() == {("a", "z")}
    index.compact()
    assert seen() == {("a", "z")} and len(index.commits()) == 1
    index.replace(spark.createDataFrame([("b", 1, "again")], "doc_id string, chunk_no int, content string"))
    assert seen() == {("a", "z"), ("b", "again")}


def test_indexing_records_failures_and_goes_on(spark, tmp_path):
    index, status = ChunkIndex(spark, str(tmp_path / "i")), str(tmp_path / "s")

    def split(text, broken=("bad",)):
        if text in broken:
            raise ValueError("no " + text)
        return R.windows(text)

    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "fine " * 500)], "doc_id long, text string")
    got = {r.doc_id: (r.status, r.error, r.n_chunks) for r in index_documents(docs, index, status, split).collect()}
    assert got == {1: ("indexed", None, 1), 2: ("failed", "ValueError: no bad", 0), 3: ("empty", None, 0), 4: ("indexed", None, 3)}
    assert {r.doc_id for r in index.read().collect()} == {1, 4}
    # The next run takes what failed and what changed only.
    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "now there"), (4, "fine " * 500)], "doc_id long, text string")
    again = {r.doc_id: r.status for r in index_documents(docs, index, status, lambda t: split(t, ())).collect()}
    assert again == {2: "indexed", 3: "indexed"} and {r.doc_id for r in index.read().collect()} == {1, 2, 3, 4}


def test_delimited_files_in_parallel(spark, tmp_path):
    """One file of many splits with line ends in quotes, and files of other delimiters and encodings, as a serial reader gives them."""
    rng, folder = random.Random(3), tmp_path / "in"
    folder.mkdir()
    value = lambda: "".join(rng.choice(["a", "é", ",", ";", '"', "\n", " ", "xyz", "\n\n", '""']) for _ in range(rng.randrange(12)))
    files = {}
    for name, sep, encoding, n in (("large.csv", ",", "utf-8", 3000), ("semi.csv", ";", "iso-8859-1", 50), ("tab.csv", "\t", "utf-8-sig", 5)):
        rows = [["id", "née", "text"]] + [[str(i), "é" if i == 3 else "e", value()] for i in range(n)]
        with open(folder / name, "w", encoding=encoding, newline="") as f:
            csv.writer(f, delimiter=sep, lineterminator="\r\n" if sep == ";" else "\n").writerows(rows)
        files[name] = rows
    (folder / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        grid = read_grids(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(grid, key=lambda r: (r.doc_id, r.row_no)):
        got.setdefault(r.doc_id.rsplit("/", 1)[-1], []).append(list(r.cells))
        assert r.row_no == len(got[r.doc_id.rsplit("/", 1)[-1]]) - 1
    assert got == files
    table = readers.read_csv(spark, str(folder / "large.csv"))
    assert table.columns == ["id", "née", "text"] and table.count() == 3000
    with pytest.raises(ValueError, match="no table"):
        readers.read_csv(spark, str(folder / "empty.csv"))


def test_json_documents_of_different_shapes(spark):
    texts = ['[{"name": "a", "kids": [{"id": 7, "toys": [{"t": 1}, {"t": null}]}, {"x": {}}]}, 5, {"z": [], "name": "b"}]', '{"orders": [{"user": {"user_id": "u1", "tags": ["p", null, 2]}, "lines": [{"q": true}]}]}', "{", '{"only": {"deep": {"er": 1.50}}}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.dataset, r.source_row, r.position, r.column, r.value, r.json_path, r.parent_ref) for r in H.json_cells(readers.select_records(docs)).fillna("-").collect())
    assert got == sorted([
        (0, "records", 1, 0, "name", "a", "$[0]", "-"), (0, "records", 2, 1, "value", "5", "$[1]", "-"), (0, "records", 3, 2, "z", "-", "$[2]", "-"), (0, "records", 3, 0, "name", "b", "$[2]", "-"),
        (0, "records.kids", 1, 0, "id", "7", "$[0].kids[0]", "$[0]"), (0, "records.kids", 2, 1, "x", "-", "$[0].kids[1]", "$[0]"),
        (0, "records.kids.toys", 1, 0, "t", "1", "$[0].kids[0].toys[0]", "7"), (0, "records.kids.toys", 2, 0, "t", "-", "$[0].kids[0].toys[1]", "7"),
        (1, "orders", 1, 0, "user.user_id", "u1", "$[0]", "-"), (1, "orders", 1, 1, "user.tags", "p; ; 2", "$[0]", "-"), (1, "orders.lines", 1, 0, "q", "True", "$[0].lines[0]", "u1"),
        (3, "records", 1, 0, "only.deep.er", "1.5", "$[0]", "-"),
    ])


def test_large_merged_range_meets_rows_only(spark):
    cells = spark.createDataFrame([("d", "s", r, 1, v) for r, v in ((5, "top"), (6, None), (999, "own"), (10_000_004, None), (10_000_005, None))] + [("d", "s", 7, 2, "x"), ("d", "t", 6, 1, None)], "doc_id string, sheet string, r long, c int, value string")
    ranges = spark.createDataFrame([("d", "s", 5, 1, 10_000_004, 1), ("d", "s", 8, 2, 9, 2)], "doc_id string, sheet string, r1 long, c1 int, r2 long, c2 int")
    got = {(r.sheet, r.r, r.c): r.value for r in H.fill_merged(cells, ranges).collect()}
    assert got == {("s", 5, 1): "top", ("s", 6, 1): "top", ("s", 7, 1): "top", ("s", 7, 2): "x", ("s", 999, 1): "own", ("s", 10_000_004, 1): "top", ("s", 10_000_005, 1): None, ("t", 6, 1): None}


@pytest.mark.parametrize(("partitions", "most_bytes"), [(1, Q.MOST_QUERIES), (40, 700)])
def test_passages_equal_brute_force(spark, monkeypatch, partitions, most_bytes):
    """A scope with most of the passages, ties, scopes without passages, single documents and questions without words."""
    monkeypatch.setattr(Q, "BLOCK", 1024 if partitions == 1 else 3)
    rng = random.Random(12)
    vocabulary = ["the"] + [f"w{i}" for i in range(30)]
    said = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([4, 31])]) for _ in range(n))
    passages = [("hot" if i % 4 else f"s{i % 8}", str(i // 5), i, said(rng.randrange(20))) for i in range(160)] + [("hot", "90", 900 + i, "w1 w2 w3") for i in range(9)] + [(None, "1", 999, "w1")]
    questions = [(i, ("hot", "s0", "s4", "none")[i % 4], "3" if i % 5 == 0 else None, said(rng.randrange(8))) for i in range(40)] + [(40, "hot", None, "w1 w2 w3"), (41, "hot", None, ""), (42, None, None, "w1")]
    p = spark.createDataFrame(passages, "scope string, doc string, no long, text string").withColumn("words", T.kept_words(F.col("text")))
    q = spark.createDataFrame(questions, "question_id long, scope string, doc string, text string").withColumn("words", T.kept_words(F.col("text")))
    pw, qw = {r.no: r.words for r in p.collect()}, {r.question_id: r.words for r in q.collect()}
    for weights, by_passage, least, k in (((0.7, 0.3), False, 0.15, 8), ((0.0, 1.0), True, 0.3, 1), ((0.0, 1.0), False, 0.12, 3)):
        want = []
        for i, scope, only, _ in questions:
            found = []
            for s, doc, no, _ in passages:
                if s is None or s != scope or only not in (None, doc) or not qw[i]:
                    continue
                a, b = Q.hash_features(qw[i]), Q.hash_features(pw[no])
                hits = len(set(qw[i]) & set(pw[no]))
                score = weights[1] * hits / (max(1, len(set(pw[no]))) if by_passage else len(set(qw[i])))
                score += weights[0] * (a @ b / np.sqrt((a @ a) * (b @ b)) if (a @ a) * (b @ b) else 0.0)
                if score >= least - 1e-9 and score > 0:
                    found.append((-round(score, 9), -hits if by_passage else 0, no))
            want += [(i, r + 1, no, -s) for r, (s, _, no) in enumerate(sorted(found)[:k])]
        got = Q.best_passages(q, p.drop("text").repartition(partitions), ["no"], k, weights, least, by_passage, most_bytes).collect()
        assert sorted((r.question_id, r["rank"], r.no, round(r.score, 9)) for r in got) == sorted(want)


def test_names_in_texts(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    names = [(s, word(rng.choice([1, 2, 5, 6, 7, 12])), i) for s in ("x", "y") for i in range(60)] + [("x", "", 99), ("x", None, 98), ("x", "customer#000000001", 97), ("x", "customer#000000002", 96)]
    texts = [(i, rng.choice(["x", "y", "z"]), word(rng.randrange(80))) for i in range(50)] + [(50, "x", "of customer#000000002!"), (51, "x", None), (52, "x", "")]
    got = Q.names_in_texts(spark.createDataFrame(texts, "id long, scope string, text string"), spark.createDataFrame(names, "scope string, name string, n long"), "scope", "name", "text").collect()
    assert sorted((r.id, r.n) for r in got) == sorted((i, n) for i, s, t in texts for z, name, n in names if t and name and s == z and name in t)


def test_cosine_in_parts(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (300, 6)))] + [(300 + i, [1.0] + [0.0] * 5) for i in range(20)] + [(400, None), (401, [0.0] * 6), (402, [1.0, 2.0]), (None, [1.0] * 6), (403, [3.0, 5.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    a, b = (sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in Q.cosine_top(v, v.filter("vec_id % 10 = 0 OR vec_id > 400"), 4, most_bytes=m).collect()) for m in (Q.MOST_QUERIES, 500))
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in rows if i is not None and x is not None}
    want = []
    for i in unit:
        if i % 10 == 0 or i > 400:
            near = sorted((-round(float(unit[i] @ y), 9), j) for j, y in unit.items() if j != i and len(y) == len(unit[i]))[:4]
            want += [(i, r + 1, j, round(-s, 6) + 0.0) for r, (s, j) in enumerate(near)]
    assert a == b and [x[:3] for x in a] == [x[:3] for x in sorted(want)]


def test_windows_are_linear_and_whole():
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "end. ", "\n", "x" * 50]) for _ in range(400_000))
    began = time.time()
    pieces = R.windows(text)
    assert time.time() - began < 10 and len(text) > 3_000_000 and all(len(p) <= R.CHUNK for p in pieces)
    at = 0
    for p in pieces:
        at = text.index(p, max(0, at - R.CHUNK)) + len(p)
    assert R.windows(None) == R.windows(" \n") == [] and R.windows("a") == ["a"]


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("notes.zip", b"PK"), ("fake.pdf", b"plain"), ("a.csv", b"x,y\n1,2\n")):
        (tmp_path / "in" / name).write_bytes(data)
    good, bad = readers.read_uploads(spark, str(tmp_path / "in"))
    assert [r.filename for r in good.collect()] == ["a.csv"] and bad.count() == 2
    assert readers.read_csv(spark, str(tmp_path / "in/a.csv")).columns == ["x", "y"]


def test_answers_by_scope(spark):
    q = spark.createDataFrame([(i, "all" if i > 5 else "document") for i in range(12)], "question_id long, scope string")
    hit = lambda ids, name: spark.createDataFrame([(i, f"{name} {i}") for i in ids], "question_id long, answer string")
    passages = spark.createDataFrame([(i, f"p {i}", c) for i, c in ((1, "medium"), (2, "medium"), (3, "low"), (4, "low"), (7, "medium"), (8, "low"), (9, "medium"), (10, "low"))], "question_id long, answer string, confidence string")
    got = {r.question_id: (r.answer, r.confidence) for r in R.answers(q, hit([0, 6], "c"), hit([1, 7, 8], "f"), hit([2, 3, 9, 10], "s"), passages).collect()}
    none = R.S.MISSING
    assert got == {
        0: ("c 0", "high"), 1: ("f 1", "high"), 2: ("p 2", "medium"), 3: ("s 3", "medium"), 4: ("p 4", "low"), 5: (none, "low"),
        6: ("c 6", "high"), 7: ("p 7", "medium"), 8: ("f 8", "high"), 9: ("p 9", "medium"), 10: ("s 10", "medium"), 11: (none, "low"),
    }


def test_facts_of_a_whole_document(sales):
    cells, columns, counts = sales
    spark = cells.sparkSession
    kind = spark.createDataFrame([("d", "Sales")], "doc_id string, document_type string")
    scores, _ = G.quality(cells, columns, counts)
    matters = spark.createDataFrame([("d", 1, "first"), ("d", 2, "second")], "doc_id string, rank int, message string")
    sections = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, section_no int")
    f = R.facts(kind, counts, columns, G.metrics(columns, counts), G.insights(cells, columns, counts), sections=sections, scores=scores, anomaly_rows=matters.limit(0), matters=matters)
    ask = lambda text: R.best_facts(spark.createDataFrame([(1, "d", text)], "question_id long, doc_id string, question string"), f).first()
    assert ask("what kind of document type is it").answer == "This is a document of type Sales with 1 datasets of 12 records and 2 sections of text."
    assert ask("is the data quality clean and reliable").answer == "The data quality score is 86/100: 12 missing values and 0 repeated rows of 12 records."
    assert ask("any unusual or strange outliers, an anomaly").source == "Anomalies"
    assert ask("what matters most, in priority").answer == "What matters most: first; second."


def test_market_questions(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, f"doc_id string, line_no int, {schema}")
    tables = {
        "equities": t([("a", 2, "BLR"), ("a", 1, "BOK")], "ticker string"), "exchange_rates": t([("a", 1, "EUR"), ("a", 3, "usd"), ("b", 1, "KES")], "currency string"),
        "market_overview": t([("a", 1, None, 5.0)], "market_capitalization double, equity_turnover double"), "bond_trades": t([("a", 1)][:0], "bond string"), "bonds": t([("a", 1, "x"), ("a", 2, "y")], "security string"),
    }
    got = {r.doc_id: r.questions for r in R.suggested_market_questions(tables).collect()}
    assert got == {
        "a": ["What was the closing price of BOK?", "What was the equity turnover?", "What is the exchange rate of usd?", "How many bonds are listed (2)?", "What matters most in this report?", "What looks unusual?"],
        "b": ["What is the exchange rate of KES?", "What matters most in this report?", "What looks unusual?"],
    }



def test_names_stay_off_the_driver(spark):
    """Texts and names grow with the input: no join of them broadcasts a side."""
    texts = spark.createDataFrame([(i, "s", f"compare {i} versus {i + 1}") for i in range(50)], "id long, scope string, text string")
    names = spark.createDataFrame([("s", str(i)) for i in range(50)], "scope string, name string")
    found = Q.names_in_texts(texts, names, "scope", "name", "text")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r["name"]) for r in found.collect()} == {(i, str(j)) for i in range(50) for j in range(50) if str(j) in f"compare {i} versus {i + 1}"}



def test_json_rows_leave_in_large_batches(spark, tmp_path):
    """Cells of many small documents, one id on two rows: few batches, and columns numbered over all rows of the id."""
    texts = ['{"items": [{"a": 1}, {"b": 2, "a": 3}]}'] * 500
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, '{"items": [{"c": 1}]}')], "doc_id long, text string")
    rows = readers.select_records(docs).coalesce(1)
    got = H.json_cells(rows).filter("doc_id <> 7")
    assert sorted({(r.column, r.position, r.source_row, r.value) for r in got.collect()}) == [("a", 0, 1, "1"), ("a", 0, 2, "3"), ("b", 1, 2, "2")]
    assert got.count() == 499 * 3
    assert sorted((r.column, r.value) for r in H.json_cells(rows).filter("doc_id = 7").collect()) == [("a", "1"), ("a", "3"), ("b", "2"), ("c", "1")]
    # One job reads the texts once: no union of a branch for each shape.
    assert "Union" not in readers.select_records(docs)._jdf.queryExecution().optimizedPlan().toString()



def test_best_share(spark):
    """The fact with the largest share of its words against brute force, with words common and rare, many ties and repeated facts."""
    rng = random.Random(5)
    letters = [f"w{i}" for i in range(30)]
    facts = [("ab"[rng.randrange(2)], [letters[min(rng.randrange(30), rng.randrange(30))] for _ in range(rng.randrange(7))], n) for n in range(400)]
    asked = [(i, rng.choice(["a", "b", "none"]), [letters[min(rng.randrange(30), rng.randrange(30))] for _ in range(rng.randrange(9))]) for i in range(60)]
    want = []
    for i, scope, w in asked:
        found = []
        for s, own, n in facts:
            hits = len(set(own) & set(w))
            if s == scope and hits and hits / len(set(own)) >= 0.3:
                found.append((-hits / len(set(own)), -hits, n))
        if found:
            want.append((i, scope, -min(found)[1], min(found)[2]))
    q = spark.createDataFrame(asked, "question_id long, scope string, words array<string>")
    p = spark.createDataFrame(facts, "scope string, words array<string>, no long")
    for common in (0, 8, 10_000):
        got = Q.best_by_share(q, p.repartition(5), ["no"], 0.3, common).collect()
        assert sorted((r.question_id, r.scope, r.matched, r.no) for r in got) == sorted(want)



def test_cosine_holds_few_scores():
    """20,000 queries against 4,096 vectors: what a task holds follows its blocks, not queries times vectors."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(1)
    q, v = rng.normal(0, 1, (20_000, 4)), rng.normal(0, 1, (4096, 4))
    sent = SimpleNamespace(value={4: (np.arange(20_000) + 10_000, Q._unit(q))})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])
    tracemalloc.start()
    out = pa.Table.from_batches(list(Q._nearest(sent, 3)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 60_000 and peak < 100 << 20
    want = np.argsort(-(Q._unit(q[:50]) @ Q._unit(v).T), axis=1)[:, :3]
    held = {}
    for i, n in zip(out.column("query_id").to_pylist(), out.column("id").to_pylist()):
        held.setdefault(i - 10_000, []).append(n)
    assert [held[i] for i in range(50)] == want.tolist()



def test_texts_become_objects_in_small_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["a"])
    assert [b.num_rows for b in Q.slices(iter([batch]), 300)] == [300, 300, 300, 100] and next(Q.slices(iter([batch]))).num_rows <= 256



def test_merged_ranges_in_bins_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(H, "MOST_BIN", 3)
    cells = spark.createDataFrame([("d", "s", r, 1, f"v{r}" if r in (0, 40) else None) for r in range(0, 60)], "doc_id string, sheet string, r long, c int, value string")
    ranges = spark.createDataFrame([("d", "s", 0, 1, 37, 2), ("d", "s", 40, 1, 41, 1)], "doc_id string, sheet string, r1 long, c1 int, r2 long, c2 int")
    got = {(r.r, r.c): r.value for r in H.fill_merged(cells, ranges).collect()}
    assert got == {(r, 1): "v0" if r < 38 else "v40" if r in (40, 41) else None for r in range(60)} | {(r, 2): "v0" for r in range(38)}
    assert "least" in H.fill_merged(cells, ranges)._jdf.queryExecution().optimizedPlan().toString()



def test_hits_are_found_once_for_answers(spark):
    hits = spark.createDataFrame([("q", 1, "a", 0.5, "one", "a.txt", 2), ("q", 2, "b", 0.45, "two", "b.txt", None)], "question_id string, rank int, doc_id string, score double, content string, filename string, page_number int")
    out = R.extractive_answers(hits.mapInArrow(lambda batches: batches, hits.schema))
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.answer, r.confidence, r.sources) for r in out.collect()] == [("one\ntwo", "medium", ["a.txt, page 2", "b.txt"])]



def test_reports_are_dealt_over_all_cores(spark):
    from veritab.plans import derived

    one = derived._reports(spark, "/root/testdata/sf0.001")
    assert one.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism



def test_plain_cells_read_as_all_others(spark):
    """The short ways of the scalar functions against their patterns, on odd cells."""
    odd = ["", " ", "a", " a", "a ", "a  b", "a\tb", "a\n", "12", "12\n", "+5", "-5.25", "1,000", "(3)", "5.", ".5", "-", "1e5", "0012", "\xa07", "7 ", "é", "é x", "2024-02-29", "2023-02-29", "2024-2-9", "0999-01-01", "0000-01-01", "2024-01-01\n", "12/11/2024", None, "x" * 300, "\x1f", "a\x85", "9" * 400, "１２"]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i long, v string").repartition(3)
    v = F.col("v")
    any_text = F.nullif(S._strip_any(F.regexp_replace(v, S._SPACE, " ")), F.lit(""))
    iso = S._iso_date(S._rewrite(S._strip_any(v), S._STRICT))
    wide = S._iso_date(S._rewrite(S._strip_any(v), S._STRICT[1:] + S._WIDE + S._STRICT[:1]))
    slow = S._strip_any(v)
    number = F.regexp_replace(F.regexp_replace(slow, "[,+]", ""), r"(?s)^\((.*)\)$", "-$1")
    number = F.when(~slow.isin(*S.NOT_A_NUMBER) & number.rlike(S.NUMBER), number.try_cast("double"))
    pairs = [(S.clean_text(v), any_text), (S.strip(v), slow), (S.parse_date(v), iso), (S.parse_date_builtin(v), F.when(F.year(wide).between(1900, 2100), wide)), (S.parse_number(v), number)]
    got = d.select("v", *[x.eqNullSafe(y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)]).collect()
    assert [(r.v, i) for r in got for i in range(len(pairs)) if not r[f"c{i}"]] == []


def test_hash_counts_equal_hash_features():
    """texts are hashed together, with words and pairs on both sides of MD5's block of 55 bytes."""
    rnd = random.Random(5)
    sizes = [1, 2, 5, 9, 26, 27, 28, 54, 55, 56, 57, 64, 130]
    texts = ["", " ".join(["ok"] * 3)] + [" ".join("".join(rnd.choice("abcdef%0'é漢") for _ in range(rnd.choice(sizes))) for _ in range(rnd.choice([0, 1, 2, 40]))) for _ in range(400)]
    expected = np.array([Q.hash_features(t.split(" ") if t else []) for t in texts])
    assert (Q.hash_counts(texts) == expected).all()
    assert (np.concatenate([Q.hash_counts(texts[a:b]) for a, b in Q.runs(texts, 50)]) == expected).all()
    assert Q.hash_counts([]).shape == (0, Q.DIMENSIONS)


def test_kept_line_and_has_text_equal_expressions(spark):
    texts = [None, "", " ", "\u00a0\u2003\n", "\u200b", "\x00", "The Kelvin \u212a2 and \u0130stanbul \u017ft", "don't 5% a.b of x it's Ünder-way", "漢", "\u2028x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.kept_line(F.col("t")).alias("line"), F.array_join(T.kept_words(F.col("t")), " ").alias("words"), S.has_text(F.col("t")).alias("has"), S.clean_text(F.col("t")).isNotNull().alias("left")).collect()
    for r in got:
        assert (r.line, r.has) == (r.words, r.left), r


def test_chunks_are_made_once(spark):
    """numbering chunks by ranges samples them, which made all of them twice."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(t):
        made.add(1)
        return t

    sections = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("section_no"), F.lit("page 2").alias("title"), said(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("content"))
    assert R.build_chunks([R.section_chunks(sections)]).count() == 50
    assert made.value == 50


def test_keywords_of_repeated_and_missing_ids(spark):
    """Rows of one id are one text, wherever they lie; the words of a row alone are counted in it."""
    rows = [(1, "Bond yield bond the the"), (2, "yield"), (2, "Yield price price"), (None, "one lone"), (None, "lone"), (3, None), (4, "b b don't DON'T aaa AAA aaa")]
    got = T.keywords(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "bond", 2, 1), (2, "price", 2, 2), (2, "yield", 2, 1), (None, "lone", 2, 1), (4, "aaa", 3, 1), (4, "don't", 2, 2)], key=repr)


def test_mentions_grow_with_the_text(spark):
    """a text's patterns were matched again for each mention found."""
    few, many = "paid $5 and usd 7 on 3/4/2020. USD 7,000 KES, £, 5 % 5% 1,000 aQ1 2020 Q2 2021 March 2020 MARCH 2020 May 3rd, 2021 ", " ".join(f"$5 {i % 30}/4/2020" for i in range(20_000))
    got = spark.createDataFrame([(few,), (None,), ("plain",)], "t string").select(T.extract_numbers(F.col("t")), T.extract_dates(F.col("t"))).collect()
    assert tuple(got[0]) == (["$5", "USD 7,000", "KES,", "£,", "5 %", "5%", "7,000", "1,000"], ["May 3rd, 2021", "March 2020", "3/4/2020", "Q2 2021"])
    assert [tuple(r) for r in got[1:]] == [([], [])] * 2
    began = time.time()
    row = spark.createDataFrame([(many,)], "t string").select(T.extract_numbers(F.col("t")).alias("n"), T.extract_dates(F.col("t")).alias("d")).first()
    assert row.n == ["$5"] and len(row.d) == 8 and time.time() - began < 60
