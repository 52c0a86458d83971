"""Raw grids, lines and records to tables, sections and cells."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from veritab.functions import scalars as S
from veritab.plans.staging import stage

TABLE = ["doc_id", "table_id"]


# --- grids: rows (doc_id, table_id, row_no, cells array<string>)


def is_blank_row(cells: Column) -> Column:
    return F.forall(cells, lambda x: S.clean_text(x).isNull())


def header_names(header: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, name) of header (keys, cells): blanks become 'Column i', repeats 'Name (2)', 'Name (3)'."""
    named = header.select(*keys, F.posexplode("cells").alias("position", "raw"))
    named = named.withColumn("base", F.coalesce(S.clean_text(F.col("raw")), F.concat(F.lit("Column "), (F.col("position") + 1).cast("string"))))
    turn = F.row_number().over(W.partitionBy(*keys, "base").orderBy("position"))
    named = named.withColumn("turn", turn)
    return named.select(*keys, "position", F.when(F.col("turn") > 1, F.concat("base", F.lit(" ("), F.col("turn").cast("string"), F.lit(")"))).otherwise(F.col("base")).alias("name"), F.col("raw"))


def grids_to_cells(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, tables) of raw grids: the first row that is not blank names the columns, blank rows are left out and counted.

    A table needs two named columns and one row. source_row is the 1-based place in the grid; short rows end in nulls.
    """
    live = grid.withColumn("blank", is_blank_row(F.col("cells")))
    header = live.filter("NOT blank").groupBy(*TABLE).agg(F.min_by("cells", "row_no").alias("cells"), F.min("row_no").alias("header_row"))
    named = F.size(F.filter("cells", lambda x: S.clean_text(x).isNotNull())) >= 2
    header = header.filter(named)
    rows = live.join(header.select(*TABLE, "header_row"), TABLE).filter(F.col("row_no") > F.col("header_row"))
    counts = rows.groupBy(*TABLE).agg(F.count_if(~F.col("blank")).alias("row_count"), F.count_if("blank").alias("blank_rows_skipped")).filter("row_count > 0")
    names = header_names(header.join(counts, TABLE, "left_semi"), TABLE)
    data = rows.filter("NOT blank").select(*TABLE, (F.col("row_no") + 1).cast("long").alias("source_row"), "cells")
    cells = data.join(names, TABLE).select("doc_id", F.col("table_id").alias("dataset"), F.col("name").alias("column"), "position", "source_row", F.get("cells", F.col("position")).alias("value"))
    return cells, counts.withColumnRenamed("table_id", "dataset")


def merge_continued(grid: DataFrame) -> DataFrame:
    """Tables continued over a page break get the id of the table they continue; the repeated header row goes.

    grid has doc_id, page_no, table_no, row_no, cells. A table continues the last one of the page before if it is the
    first of the very next page and has the same cleaned header of more than one column.
    """
    key = ["doc_id", "page_no", "table_no"]
    header = F.transform(F.min_by("cells", "row_no"), lambda x: F.lower(F.coalesce(S.clean_text(x), F.lit(""))))
    tables = grid.groupBy(*key).agg(header.alias("header"), F.min("row_no").alias("first_row"))
    w = W.partitionBy("doc_id").orderBy("page_no", "table_no")
    tables = tables.withColumn("prev_page", F.lag("page_no").over(w)).withColumn("prev_header", F.lag("header").over(w))
    joins = (F.col("table_no") == 1) & (F.col("page_no") == F.col("prev_page") + 1) & (F.col("header") == F.col("prev_header")) & (F.size("header") > 1)
    tables = tables.withColumn("goes_on", F.coalesce(joins, F.lit(False)))
    tables = tables.withColumn("table_id", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = grid.join(tables.select(*key, "table_id", "goes_on", "first_row"), key).filter("NOT (goes_on AND row_no = first_row)")
    place = F.row_number().over(W.partitionBy("doc_id", "table_id").orderBy("page_no", "table_no", "row_no")) - 1
    pages = W.partitionBy("doc_id", "table_id")
    label = F.when(F.min("page_no").over(pages) == F.max("page_no").over(pages), F.concat(F.lit("page "), F.min("page_no").over(pages).cast("string"))).otherwise(F.concat(F.lit("pages "), F.min("page_no").over(pages).cast("string"), F.lit("-"), F.max("page_no").over(pages).cast("string")))
    return rows.withColumn("row_no", place).withColumn("source", label).select("doc_id", F.col("table_id").cast("string").alias("table_id"), "row_no", "cells", "source")


#: Rows of the largest bin, as a power of two.
MOST_BIN = 16


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """cells (doc_id, sheet, r, c, value) with merged ranges (doc_id, sheet, r1, c1, r2, c2) filled by their first cell's value.

    A cell that holds a value keeps it. Rows of the sheet that have any cell are filled, so a range over ten million rows
    is filled where there are rows. Rows and ranges meet in bins of the smallest power of two that the range's height
    does not exceed, of MOST_BIN rows at most: a range is in one or two bins of its own size, a higher one in as many as
    it takes, a row in one bin of each size that is in use. So no task gets more rows of a sheet than a bin has.
    """
    key = ["doc_id", "sheet"]
    anchor = cells.select(*key, F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("value").alias("anchor"))
    known = ranges.join(anchor, [*key, "r1", "c1"]).withColumn("size", F.least(F.ceil(F.log2((F.col("r2") - F.col("r1") + 1).cast("double"))).cast("int"), F.lit(MOST_BIN)))
    width = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("size"))).cast("long")
    binned = known.withColumn("bin", F.explode(F.sequence(width("r1"), width("r2"))))
    sizes = known.groupBy(*key).agg(F.collect_set("size").alias("sizes"))
    rows = cells.select(*key, "r").distinct().join(sizes, key).withColumn("size", F.explode("sizes")).withColumn("bin", width("r"))
    met = rows.join(binned, [*key, "size", "bin"]).filter("r BETWEEN r1 AND r2")
    filled = met.select(*key, "r", F.explode(F.sequence("c1", "c2")).alias("c"), "anchor")
    return cells.join(filled, [*key, "r", "c"], "full").select(*key, "r", "c", F.coalesce("value", "anchor").alias("value"))


def grid_lines(grid: DataFrame) -> DataFrame:
    """Lines of the cells that are not empty, in order."""
    lines = grid.select("doc_id", "table_id", "row_no", F.posexplode("cells").alias("position", "cell")).select("*", F.posexplode(F.split(F.coalesce("cell", F.lit("")), r"\R")).alias("line_no", "line"))
    return lines.withColumn("line", S.clean_text(F.col("line"))).filter("line IS NOT NULL").drop("cell")


# --- records


def flatten(records: DataFrame) -> DataFrame:
    """Nested structs as dotted names, arrays of scalars as '; '-joined text (null as nothing); arrays of structs are left out."""

    def walk(schema: T.StructType, path: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            at = [*path, f.name]
            c = F.col(".".join(f"`{p}`" for p in at))
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, at)
            elif isinstance(f.dataType, T.ArrayType):
                if not isinstance(f.dataType.elementType, T.StructType):
                    text = F.array_join(F.transform(c, lambda x: x.cast("string")), "; ", "")
                    out.append(F.when(F.size(c) > 0, text).alias(".".join(at)))
            else:
                out.append(c.alias(".".join(at)))
        return out

    return records.select(*walk(records.schema, []))


def child_tables(records: DataFrame, root: str = "$") -> dict[str, DataFrame]:
    """Arrays of structs at any depth as tables by dotted path, each row with _json_path and _parent_ref.

    records needs _index, the record's number. _parent_ref is the first field of the parent named id or ending in _id
    that is not empty, else the parent's path.
    """
    out: dict[str, DataFrame] = {}

    def walk(df: DataFrame, schema: T.StructType, prefix: Column | None, path: Column, name: str) -> None:
        def at(f: str) -> Column:
            return F.col(f"`{f}`") if prefix is None else prefix[f]

        ids = [at(f.name).cast("string") for f in schema.fields if (f.name == "id" or f.name.endswith("_id")) and not isinstance(f.dataType, (T.StructType, T.ArrayType))]
        parent = F.coalesce(*[F.nullif(i, F.lit("")) for i in ids], path)
        for f in schema.fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                child = f"{name}.{f.name}" if name else f.name
                rows = df.select(path.alias("_p"), parent.alias("_parent_ref"), F.posexplode(at(f.name)).alias("_i", "_r"))
                rows = rows.select("_parent_ref", F.concat("_p", F.lit(f".{f.name}["), F.col("_i").cast("string"), F.lit("]")).alias("_json_path"), "_r")
                out[child] = rows.select("_r.*", "_json_path", "_parent_ref")
                walk(rows, f.dataType.elementType, F.col("_r"), F.col("_json_path"), child)

    fields = T.StructType([f for f in records.schema.fields if not f.name.startswith("_")])
    walk(records, fields, None, F.concat(F.lit(f"{root}["), F.col("_index").cast("string"), F.lit("]")), "")
    return out


def union_records(tables: list[DataFrame]) -> DataFrame:
    """Records with differing keys under one header, in first-seen order; missing is null, names starting _ go."""
    from functools import reduce

    own = [t.select(*[c for c in t.columns if not c.startswith("_")]) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def _record_cells(table: str, records: list) -> Iterator[tuple]:
    """(dataset, place, path, parent, column, turn, value) of JSON records and of the lists of objects inside them.

    Objects inside a record become dotted columns, a list of objects a table of its own by dotted name, other lists text.
    A parent is the first column of the record above named id or ending in _id that is not empty, else its path.
    """
    todo = [(table, f"$[{i}]", None, r, i) for i, r in reversed(list(enumerate(records)))]
    places: dict[str, int] = {}
    while todo:
        name, path, parent, record, _ = todo.pop()
        place = places[name] = places.get(name, -1) + 1
        flat: list[tuple[str, object]] = []
        lists: list[tuple[str, list]] = []
        fields = [("", record)] if isinstance(record, dict) else []
        if not fields:
            flat.append(("value", record))
        while fields:
            at, v = fields.pop()
            if isinstance(v, dict) and v:
                fields += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
            elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                lists.append((at, v))
            elif isinstance(v, list):
                flat.append((at, "; ".join("" if x is None else str(x) for x in v) if v else None))
            else:
                flat.append((at, None if isinstance(v, dict) else v))
        values = dict(flat)
        for turn, (column, v) in enumerate(values.items()):
            yield name, place, path, parent, column, turn, None if v is None else str(v)
        named = lambda c: (last := c.rsplit(".", 1)[-1].lower()) == "id" or last.endswith("_id")
        own = next((str(v) for c, v in values.items() if not c.startswith("_") and v not in (None, "") and named(c)), path)
        for field, rows in reversed(lists):
            child = f"{name}.{field}" if name else field
            todo += [(child, f"{path}.{field}[{i}]", own, r, i) for i, r in reversed(list(enumerate(rows)))]


def json_cells(tables: DataFrame) -> DataFrame:
    """cells (doc_id, dataset, column, position, source_row, value, json_path, parent_ref) of select_records() rows.

    Documents of any shapes go through one job: each array of records is walked where it lies. Columns of a dataset come
    in the order in which its records first name them; source_row counts a dataset's records from 1. Rows without records
    have no cells; a text that is no JSON array is an error of select_records(), not of this.

    A document with one row of records is numbered in that row; only those with several meet again by column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "dataset", "source_row", "json_path", "parent_ref", "column", "turn", "value", "position"]
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32())
        for batch in batches:
            ids, rows, kind = [], [], batch.column("doc_id").type

            def packed() -> Iterator[pa.RecordBatch]:
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i : i + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 10_000], kind), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)
                ids.clear()
                rows.clear()

            for doc_id, table, records in zip(batch.column("doc_id").to_pylist(), batch.column("table").to_pylist(), batch.column("records").to_pylist(), strict=True):
                headers: dict[str, dict[str, int]] = {}
                found = list(_record_cells(table or "", json.loads(records)))
                # A dataset's columns by the record, then the place in it, that first names them; records may come out of turn.
                for name, _, column, _ in sorted({(d, (p, turn), c, 0) for d, p, _, _, c, turn, _ in found}):
                    own = headers.setdefault(name, {})
                    own.setdefault(column, len(own))
                rows += [(d, p + 1, path, parent, c, turn, v, headers[d][c]) for d, p, path, parent, c, turn, v in found]
                ids += [doc_id] * len(found)
                if len(rows) >= 10_000:
                    yield from packed()
            yield from packed()

    columns = ["doc_id", "dataset", "column", "position", "source_row", "value", "json_path", "parent_ref"]
    kind = tables.schema["doc_id"].dataType.simpleString()
    walked = lambda t: t.mapInArrow(run, f"doc_id {kind}, dataset string, source_row long, json_path string, parent_ref string, column string, turn long, value string, position int")
    held = stage(tables.filter(F.col("records").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "table", "records"), "records")
    several = stage(held.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    if several.isEmpty():
        return walked(held).select(columns)
    found = walked(held.join(several, "doc_id", "left_semi")).drop("position")
    met = found.join(first_seen_header(found), ["doc_id", "dataset", "column"])
    return walked(held.join(several, "doc_id", "left_anti")).select(columns).unionByName(met.select(columns))


def first_seen_header(rows: DataFrame) -> DataFrame:
    """(doc_id, dataset, column, position) of rows (doc_id, dataset, source_row, column, turn): columns by the row, then the place in it, that first names them."""
    first = rows.groupBy("doc_id", "dataset", "column").agg(F.min(F.struct("source_row", "turn")).alias("first"))
    return first.withColumn("position", F.row_number().over(W.partitionBy("doc_id", "dataset").orderBy("first")) - 1).drop("first")


# --- text lines


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\R")).alias("line_no", "line"))


def _delimiter(line: Column) -> Column:
    """The first of comma, tab, semicolon and bar that is in the line."""
    return F.coalesce(*[F.when(line.contains(d), F.lit(d)) for d in (",", "\t", ";", "|")])


def _fields(line: Column, delimiter: Column) -> Column:
    """Number of fields of a delimited line; quoted ones may hold the delimiter."""
    bare = F.regexp_replace(line, r'"[^"]*"', "q")
    return F.char_length(bare) - F.char_length(F.replace(bare, delimiter, F.lit(""))) + 1


def table_runs(lines: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(table rows, prose lines): runs of three or more lines with one delimiter and one number of fields, two at least."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    d = lines.withColumn("delimiter", F.when(F.trim("line") != "", _delimiter(F.col("line"))))
    d = d.withColumn("fields", F.when(F.col("delimiter").isNotNull(), _fields(F.col("line"), F.col("delimiter"))))
    same = F.col("delimiter").isNotNull() & (F.col("delimiter") == F.lag("delimiter").over(w)) & (F.col("fields") == F.lag("fields").over(w))
    d = d.withColumn("new", F.when(same, 0).otherwise(1))
    d = d.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("length", F.count(F.lit(1)).over(W.partitionBy("doc_id", "run")))
    is_table = F.col("delimiter").isNotNull() & (F.col("length") >= least) & (F.col("fields") >= 2)
    d = d.withColumn("is_table", is_table)
    cut = F.transform(F.split(F.col("line"), F.concat(F.lit(r'[\Q'), F.col("delimiter"), F.lit(r'\E](?=(?:[^"]*"[^"]*")*[^"]*$)'))), lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"(.*)"\s*$', "$1"), '""', '"'))
    tables = d.filter("is_table").select("doc_id", F.col("run").cast("string").alias("table_id"), "line_no", (F.row_number().over(W.partitionBy("doc_id", "run").orderBy("line_no")) - 1).alias("row_no"), cut.alias("cells"))
    return tables, d.filter("NOT is_table").select("doc_id", "line_no", "line")


def sections(lines: DataFrame, longest_heading: int = 80) -> DataFrame:
    """(doc_id, section_no, title, content): paragraphs between blank lines, titled by a short line alone just before.

    A heading stands between blank lines (a file's ends count as blank), is at most 80 characters long and doesn't end
    in . ? ! , : or ;. A heading right before another heading is dropped. Lines here are those left after table_runs().
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    t = S.strip(F.col("line"))
    d = lines.withColumn("t", t).withColumn("blank", t == "")
    prev, nxt = F.coalesce(F.lag("blank").over(w), F.lit(True)), F.coalesce(F.lead("blank").over(w), F.lit(True))
    heading = ~F.col("blank") & prev & nxt & (F.char_length("t") <= longest_heading) & ~F.col("t").rlike(r"[.?!,:;]$")
    d = d.withColumn("prev_blank", prev).withColumn("heading", heading).filter("NOT blank")
    d = d.withColumn("part", F.sum(F.when(F.col("prev_blank"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = d.groupBy("doc_id", "part").agg(
        F.bool_or("heading").alias("heading"), F.min("line_no").alias("line_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), "\n").alias("content"),
    )
    p = W.partitionBy("doc_id").orderBy("part")
    title = F.when(F.lag("heading").over(p), F.lag("content").over(p))
    kept = parts.withColumn("title", title).filter("NOT heading")
    return kept.withColumn("section_no", F.row_number().over(p)).select("doc_id", "section_no", "title", "content")


def page_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, content) of pages (doc_id, page_no, text) with over 40 characters; a short first line is the title."""
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: S.clean_text(x)), lambda x: x.isNotNull())
    d = pages.filter(F.char_length(S.strip(F.col("text"))) > 40).withColumn("lines", lines)
    first = F.get("lines", F.lit(0))
    titled = F.char_length(first) < 90
    title = F.when(titled, first).otherwise(F.concat(F.lit("Page "), F.col("page_no").cast("string")))
    content = F.array_join(F.when(titled, F.slice("lines", 2, 1 << 30)).otherwise(F.col("lines")), "\n")
    return d.select("doc_id", F.col("page_no").alias("section_no"), title.alias("title"), content.alias("content"))


def block_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section_no, title, content) of blocks (doc_id, pos, is_heading, text) under the last heading."""
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = blocks.withColumn("section_no", F.sum(F.when(F.col("is_heading"), 1).otherwise(0)).over(w)).withColumn("t", S.clean_text(F.col("text"))).filter("t IS NOT NULL")
    texts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "t")))), lambda x: x["t"])
    out = d.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("is_heading"), F.col("t"))).alias("title"), F.array_join(texts, "\n").alias("content"))
    return out.filter("content <> ''")


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages in order, joined by form feeds."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    return pages.groupBy("doc_id").agg(F.array_join(ordered, "\f").alias("text"))
