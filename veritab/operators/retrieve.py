"""Passages of documents, their hash embeddings, retrieval for questions, facts and answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritab.functions import scalars as S
from veritab.functions import words as T
from veritab.operators.findings import union
from veritab.operators.profile import KEY
from veritab.operators.search import best_by_share, best_passages, names_in_texts, sparse_vectors
from veritab.operators.series import numbered
from veritab.plans.staging import drop, scratch, stage

# Sizes, caps and weights.
CHUNK, OVERLAP, BLOCK_ROWS, DATASET_ROWS, DOC_CHUNKS = 1200, 150, 20, 2000, 1500
VECTOR_WEIGHT, KEYWORD_WEIGHT, LEAST_SCORE, MOST_HITS = 0.7, 0.3, 0.15, 8
SHOWN_COLUMNS, MOST_LISTED, MOST_TOLD = 5, 12, 5
# Words that facts about a whole document are found by.
KIND_WORDS = ("document", "type", "kind")
QUALITY_WORDS = ("quality", "clean", "reliable", "trustworthy")
UNUSUAL_WORDS = ("unusual", "anomaly", "anomalies", "outlier", "outliers", "strange", "odd", "suspicious")
MATTERS_WORDS = ("matters", "most", "important", "priority")
#: Facts of rows are numbered from here on, after all others; keys over which the rows of one column are dealt.
ROW_FACTS, SPREAD = 1 << 40, 32
COMPARE_WORDS = ("compare", "versus", " vs ", "difference between", "against")


# --- chunks


def windows(text: str | None, most: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Windows of at most so many characters that overlap, cut after a newline or a sentence where that is past the half.

    A window ends after the last newline, or full stop with a space behind it, of its second half, else at its full
    length. Null and blank texts have no window; a text is never cut short. Time grows with the text's length.
    """
    white = " \t\n\x0b\f\r"
    text, out, at = (text or "").strip(white), [], 0
    while at < len(text):
        window = text[at : at + most]
        if len(text) - at > most:
            end = max(window.rfind("\n"), window.rfind(". "))
            window = window[: end + 1] if end > most // 2 else window
        if piece := window.strip(white):
            out.append(piece)
        to = at + len(window)
        at = len(text) if to >= len(text) else max(at + 1, to - overlap)
    return out


def split_text(text: Column, most: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """windows() of whole texts, Arrow batch by batch."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, most, overlap))

    return split(text)


def section_chunks(sections: DataFrame) -> DataFrame:
    """(doc_id, part, seq, content, page_number, section) of sections: 'title' and a piece of its content."""
    pieces = sections.select("doc_id", "section_no", "title", F.posexplode(split_text(F.col("content"))).alias("piece_no", "piece"))
    content = F.concat_ws("\n", "title", "piece")
    return pieces.select("doc_id", F.lit(1).alias("part"), F.struct(F.col("section_no").cast("long").alias("a"), F.col("piece_no").cast("long").alias("b")).alias("seq"), content.alias("content"), S.page_from_label(F.col("title")).alias("page_number"), F.substring("title", 1, 255).alias("section"))


def dataset_chunks(cells: DataFrame, rows_each: int = BLOCK_ROWS, most_rows: int | None = DATASET_ROWS) -> DataFrame:
    """Blocks of rows as 'column: value; ...' lines under a sentence that names the dataset.

    most_rows is the passages' feature limit on rows of one dataset; None takes all.
    """
    said = F.concat("column", F.lit(": "), F.col("v"))
    row = cells.withColumn("v", S.clean_text(F.col("value"))).filter("v IS NOT NULL").groupBy(*KEY, "source_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", said.alias("s")))), lambda x: x["s"]), "; ").alias("line"))
    lines = numbered(row, KEY, ["source_row"], "rn")
    if most_rows is not None:
        lines = lines.filter(F.col("rn") < most_rows)
    blocks = lines.withColumn("block", F.floor(F.col("rn") / rows_each)).groupBy(*KEY, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    content = F.concat(F.lit('Rows of "'), F.col("dataset"), F.lit('":\n'), F.col("text"))
    return blocks.select("doc_id", F.lit(2).alias("part"), F.struct(F.xxhash64("dataset").alias("a"), F.col("block").cast("long").alias("b")).alias("seq"), content.alias("content"), F.lit(None).cast("int").alias("page_number"), F.substring("dataset", 1, 255).alias("section"))


def _listed(rows: DataFrame, part: int, order: str, text: Column, section: str) -> DataFrame:
    own = rows.select("doc_id", F.col(order).alias("o"), text.alias("t")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("content"))
    return own.select("doc_id", F.lit(part).alias("part"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("seq"), "content", F.lit(None).cast("int").alias("page_number"), F.lit(section).alias("section"))


def metric_chunks(metrics: DataFrame) -> DataFrame:
    return _listed(metrics, 3, "metric_no", F.concat("label", F.lit(": "), S.format_number(F.col("value"))), "Metrics")


def insight_chunks(insights: DataFrame) -> DataFrame:
    return _listed(insights, 4, "insight_no", F.col("text"), "Insights")


def market_chunks(tables: dict[str, DataFrame]) -> DataFrame:
    """A sentence for each row of the market tables: 'table - field: value, ...'."""
    out = []
    for i, (name, t) in enumerate(tables.items()):
        fields = [c for c in t.columns if c not in ("doc_id", "line_no", "warnings")]
        parts = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.replace('_', ' ')}: "), F.col(c).cast("string"))) for c in fields])), ", ")
        order = F.row_number().over(W.partitionBy("doc_id").orderBy(*fields))
        out.append(t.select("doc_id", F.lit(5).alias("part"), F.struct(F.lit(i).cast("long").alias("a"), order.cast("long").alias("b")).alias("seq"), F.concat(F.lit(f"{name.replace('_', ' ')} - "), parts).alias("content"), F.lit(None).cast("int").alias("page_number"), F.lit(name).alias("section")))
    return union(out)


def build_chunks(parts: list[DataFrame], most: int | None = DOC_CHUNKS) -> DataFrame:
    """(doc_id, chunk_no, content, page_number, section): the parts' chunks in fixed order, empty ones left out."""
    # Ordering by range reads its rows twice, so chunks are made once before.
    spark = parts[0].sparkSession
    path = scratch(spark, "pieces")
    all_ = stage(union(parts).filter(S.has_text(F.col("content"))), "pieces", path)
    out = numbered(all_.withColumns({"a": F.col("seq.a"), "b": F.col("seq.b")}), ["doc_id"], ["part", "a", "b", "section"], "place").withColumn("chunk_no", (F.col("place") + 1).cast("int"))
    # numbered() has written them in order.
    drop(spark, path)
    if most is not None:
        out = out.filter(F.col("chunk_no") <= most)
    return out.select("doc_id", "chunk_no", "content", "page_number", "section")


# --- embeddings


def hash_embedding(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, bucket, weight): the sparse hash embedding of significant words and neighbouring pairs, of length 1.

    Each row is a text of its own, embedded where it lies; one without significant words has no row.
    """
    found = sparse_vectors(texts, keys, T.kept_words(F.col(text_col)))
    return found.select(*keys, F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("weights").alias("weight"))))


def retrieve(questions: DataFrame, chunks: DataFrame, catalog: DataFrame, most: int = MOST_HITS, least: float = LEAST_SCORE) -> DataFrame:
    """(question_id, rank, doc_id, chunk_no, score, ...): passages for questions (question_id, user_id, question[, doc_id]).

    Only completed documents of the asking user are searched, and only the one document if a question names it. The
    score is 0.7 times the cosine of hash embeddings and 0.3 times the share of the question's words found; see
    best_passages() for how the user's passages are read in blocks. At most `most` rows a question are made.
    """
    docs = catalog.filter("status = 'completed'").select("doc_id", F.col("user_id").alias("scope"), "filename")
    words = chunks.select("doc_id", "chunk_no", T.kept_line(F.col("content")).alias("words"))
    own = words.join(docs.select("doc_id", "scope"), "doc_id").select("scope", F.col("doc_id").cast("string").alias("doc"), F.split("words", " ").alias("words"), "doc_id", "chunk_no")
    only = F.col("doc_id").cast("string") if "doc_id" in questions.columns else F.lit(None).cast("string")
    asked = questions.select("question_id", F.col("user_id").alias("scope"), only.alias("doc"), T.kept_words(F.col("question")).alias("words"))
    found = best_passages(asked, own, ["doc_id", "chunk_no"], most, (VECTOR_WEIGHT, KEYWORD_WEIGHT), least).drop("scope", "matched")
    return found.join(chunks.select("doc_id", "chunk_no", "content", "page_number", "section"), ["doc_id", "chunk_no"]).join(docs.drop("scope"), "doc_id")


def extractive_answers(hits: DataFrame) -> DataFrame:
    """(question_id, answer, confidence, sources): the best passage's excerpt, with the best of another document if nearly as good."""
    # Hits are read twice; making them is nearly all of the work.
    hits = stage(hits.select("question_id", "rank", "doc_id", "score", "content", "filename", "page_number"), "hits")
    best = hits.filter("rank = 1").select("question_id", F.col("doc_id").alias("b_doc"), F.col("score").alias("b_score"), "content", "filename", "page_number")
    other = hits.join(best.select("question_id", "b_doc", "b_score"), "question_id").filter("doc_id <> b_doc AND score >= 0.85 * b_score").groupBy("question_id").agg(F.min_by(F.struct("content", "filename", "page_number"), "rank").alias("o"))

    def source(name: Column, page: Column) -> Column:
        return F.concat(name, F.when(page.isNotNull(), F.concat(F.lit(", page "), page.cast("string"))).otherwise(F.lit("")))

    j = best.join(other, "question_id", "left")
    answer = F.concat(S.excerpt(F.col("content")), F.when(F.col("o").isNotNull(), F.concat(F.lit("\n"), S.excerpt(F.col("o.content")))).otherwise(F.lit("")))
    sources = F.array_distinct(F.array_compact(F.array(source(F.col("filename"), F.col("page_number")), source(F.col("o.filename"), F.col("o.page_number")))))
    return j.select("question_id", answer.alias("answer"), F.when(F.col("b_score") >= 0.25, "medium").otherwise("low").alias("confidence"), sources.alias("sources"))


# --- facts and answers

ENTITY_FACTS = (
    ("dates", ("dates", "date", "when"), "Dates mentioned: ", "No dates were found."),
    ("numbers", ("numbers", "percentages", "percent", "figures", "amounts"), "Numbers and percentages mentioned: ", "No numbers or percentages were found in the text."),
    ("keywords", ("keywords", "topics", "themes", "terms"), "Terms mentioned often: ", "No terms are repeated often."),
)


def identifier_rows(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, dataset, fact_no, column, v, said): one row for each row of a table and each of its identifiers.

    said lists what is there of the table's first five columns that are no identifiers; rows with none of it are left
    out. fact_no goes up by source_row, then by the document's identifier columns.
    """
    ids = columns.filter("semantic_type = 'identifier'").select(*KEY, "column", F.row_number().over(W.partitionBy("doc_id").orderBy("dataset", "position")).alias("id_no"))
    ids = ids.join(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_ids")), "doc_id")
    shown = columns.filter("semantic_type <> 'identifier'").withColumn("rn", F.row_number().over(W.partitionBy(*KEY).orderBy("position"))).filter(F.col("rn") <= SHOWN_COLUMNS)
    none = F.lit(None).cast("int")
    roles = ids.select(*KEY, "column", "id_no", F.col("n_ids").cast("int").alias("n_ids"), none.alias("rn")).unionByName(shown.join(ids.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "column", none.alias("id_no"), none.alias("n_ids"), "rn"))
    # A column of a large table has many rows: they are dealt by source_row.
    roles = roles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    kept = cells.withColumn("v", S.clean_text(F.col("value"))).filter("v IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("source_row"), F.lit(SPREAD)).cast("int"))
    met = kept.join(roles, [*KEY, "column", "part"])
    said = F.array_sort(F.collect_list(F.when(F.col("rn").isNotNull(), F.struct("rn", F.concat("column", F.lit(" "), F.col("v")).alias("s")))))
    of_id = F.collect_list(F.when(F.col("id_no").isNotNull(), F.struct("id_no", "n_ids", "column", "v")))
    rows = met.groupBy(*KEY, "source_row").agg(F.array_join(F.transform(said, lambda x: x["s"]), ", ").alias("said"), of_id.alias("ids")).filter("said <> ''")
    number = F.lit(ROW_FACTS) + F.col("source_row") * F.col("i.n_ids") + F.col("i.id_no") - 1
    return rows.withColumn("i", F.explode("ids")).select(*KEY, number.alias("fact_no"), "i.column", "i.v", "said")


def identifier_facts(rows: DataFrame) -> DataFrame:
    """facts of identifier_rows(): the identifier's words and the dataset's find the row's other values."""
    words = F.array_distinct(F.concat(T.tokenize(F.col("v")), T.tokenize(F.col("dataset"))))
    answer = F.concat(F.lit("For "), F.col("column"), F.lit(' "'), F.col("v"), F.lit('" in "'), F.col("dataset"), F.lit('": '), F.col("said"), F.lit("."))
    return rows.filter(F.size(T.tokenize(F.col("v"))) > 0).select("doc_id", "fact_no", words.alias("keywords"), answer.alias("answer"), F.col("dataset").alias("source"))


def comparables(rows: DataFrame) -> DataFrame:
    """entities (doc_id, entity_no, key, summary) for comparisons(): each identifier of identifier_rows(), its last row for a repeated one."""
    summary = F.concat("v", F.lit(" ("), F.col("dataset"), F.lit("): "), F.col("said"), F.lit("."))
    own = rows.filter(F.size(T.tokenize(F.col("v"))) > 0).select("doc_id", "fact_no", F.lower("v").alias("key"), summary.alias("summary"))
    return own.groupBy("doc_id", "key").agg(F.min("fact_no").alias("entity_no"), F.max_by("summary", "fact_no").alias("summary")).select("doc_id", "entity_no", "key", "summary")


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, dates, numbers, keywords) of documents (doc_id, text): what entity facts list."""
    said = T.keywords(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    own = docs.select("doc_id", T.extract_dates(F.col("text")).alias("dates"), T.extract_numbers(F.col("text")).alias("numbers"))
    return own.join(said, "doc_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def facts(doc_kind: DataFrame, counts: DataFrame, columns: DataFrame, metrics: DataFrame, insights: DataFrame, cells: DataFrame | None = None, mentioned: DataFrame | None = None, sections: DataFrame | None = None, scores: DataFrame | None = None, anomaly_rows: DataFrame | None = None, matters: DataFrame | None = None) -> DataFrame:
    """facts (doc_id, fact_no, keywords, answer, source) of general documents.

    doc_kind is (doc_id, document_type). Facts: what it is and how much it holds, record counts, columns, extremes, metrics
    and insights; with cells those of each row that has an identifier, with rows of mentions() dates, numbers and
    keywords, with sections their number. scores are those of quality(); anomaly_rows those of anomalies(), where a
    document without any says so; matters those of what_matters(): each a fact of its own.
    """

    def fact(rows: DataFrame, kind: int, words: Column, answer: Column, source: Column) -> DataFrame:
        return rows.select("doc_id", F.lit(kind).alias("kind"), F.array_distinct(F.filter(words, lambda w: w != "")).alias("keywords"), answer.alias("answer"), source.alias("source"))

    def with_words(c: str, *more: str) -> Column:
        return F.concat(T.significant_words(F.col(c)), F.array(*[F.lit(m) for m in more]))

    def listing(c: str, label: str, without: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, MOST_LISTED), ", "), F.lit("."))).otherwise(F.lit(without))

    def first_messages(rows: DataFrame, most: int = MOST_TOLD) -> DataFrame:
        return rows.filter(F.col("rank") <= most).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]), "; ").alias("told"))

    n = S.format_number
    held = counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("datasets"), F.sum("row_count").alias("records"))
    kinds = doc_kind.join(held, "doc_id", "left")
    kinds = kinds.withColumn("sections", F.lit(0)) if sections is None else kinds.join(sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections")), "doc_id", "left")
    kinds = kinds.fillna(0, ["datasets", "records", "sections"])
    size = F.concat(F.lit(" with "), F.col("datasets").cast("string"), F.lit(" datasets of "), F.col("records").cast("string"), F.lit(" records and "), F.col("sections").cast("string"), F.lit(" sections of text."))
    known = [] if scores is None else [fact(scores, 9, F.array(*map(F.lit, QUALITY_WORDS)), F.concat(F.lit("The data quality score is "), F.col("quality_score").cast("string"), F.lit("/100: "), F.col("missing_cells").cast("string"), F.lit(" missing values and "), F.col("duplicate_rows").cast("string"), F.lit(" repeated rows of "), F.col("total_rows").cast("string"), F.lit(" records.")), F.lit("Data quality"))]
    if anomaly_rows is not None:
        odd = doc_kind.select("doc_id").join(first_messages(anomaly_rows), "doc_id", "left")
        known.append(fact(odd, 10, F.array(*map(F.lit, UNUSUAL_WORDS)), F.coalesce(F.concat(F.lit("Unusual values: "), F.col("told"), F.lit(".")), F.lit("No unusual values were found in the numbers.")), F.lit("Anomalies")))
    if matters is not None:
        known.append(fact(first_messages(matters), 11, F.array(*map(F.lit, MATTERS_WORDS)), F.concat(F.lit("What matters most: "), F.col("told"), F.lit(".")), F.lit("What matters most")))
    listed = columns.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]), ", ").alias("names"))
    numeric = columns.filter("max IS NOT NULL")
    found = union([
        fact(kinds, 1, F.array(*map(F.lit, KIND_WORDS)), F.concat(F.lit("This is a document of type "), F.col("document_type"), size), F.lit("Overview")),
        fact(counts, 2, with_words("dataset", "records"), F.concat("dataset", F.lit(" has "), F.col("row_count").cast("string"), F.lit(" records.")), F.col("dataset")),
        fact(listed, 3, with_words("dataset", "columns"), F.concat("dataset", F.lit(" has the columns "), F.col("names"), F.lit(".")), F.col("dataset")),
        fact(numeric, 4, with_words("column", "highest", "maximum"), F.concat(F.lit("The highest "), F.col("column"), F.lit(" is "), n(F.col("max")), F.lit(".")), F.col("dataset")),
        fact(numeric, 5, with_words("column", "lowest", "minimum"), F.concat(F.lit("The lowest "), F.col("column"), F.lit(" is "), n(F.col("min")), F.lit(".")), F.col("dataset")),
        fact(metrics, 6, T.significant_words(F.col("label")), F.concat("label", F.lit(": "), n(F.col("value")), F.lit(".")), F.lit("Metrics")),
        fact(insights, 7, with_words("text"), F.col("text"), F.lit("Insights")),
        *([] if mentioned is None else [fact(mentioned, 8, F.array(*map(F.lit, words)), listing(c, label, without), F.lit(f"Entities: {c}")) for c, words, label, without in ENTITY_FACTS]),
        *known,
    ])
    found = found.filter(F.size("keywords") > 0).withColumn("fact_no", F.row_number().over(W.partitionBy("doc_id").orderBy("kind", "source", "answer")).cast("long")).drop("kind")
    return found if cells is None else found.unionByName(identifier_facts(identifier_rows(cells, columns)))


def market_facts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Facts of market reports: for each named row of each table (table, name column) and each of its figures."""
    out = []
    for name, (t, key) in tables.items():
        for c in [c for c, k in t.dtypes if k in ("double", "bigint", "int") and c != "line_no"]:
            words = F.concat(F.array(F.lower(F.col(key))), F.array(*[F.lit(w) for w in c.split("_")]))
            answer = F.concat(F.col(key), F.lit(f": {c.replace('_', ' ')} "), S.format_number(F.col(c).cast("double")), F.lit("."))
            out.append(t.filter(F.col(c).isNotNull() & F.col(key).isNotNull()).select("doc_id", F.array_distinct(words).alias("keywords"), answer.alias("answer"), F.lit(name).alias("source")))
    return union(out).withColumn("fact_no", F.row_number().over(W.partitionBy("doc_id").orderBy("source", "answer")))


def _asked(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.col("doc_id").alias("scope"), F.lit(None).cast("string").alias("doc"), T.significant_words(F.col("question")).alias("words"))


def best_facts(questions: DataFrame, fact_rows: DataFrame, least: float = 0.3) -> DataFrame:
    """(question_id, answer, source, score): the fact with the largest share of its words in the question; ties to more words, then the first.

    questions has question_id, doc_id and question. A question meets the facts of its document that share one of its rarer
    words, and one fact of each kind by its common words; see best_by_share().
    """
    fact_rows = stage(fact_rows.select("doc_id", "fact_no", "keywords", "answer", "source"), "facts")
    rows = fact_rows.select(F.col("doc_id").alias("scope"), F.col("keywords").alias("words"), "fact_no")
    found = best_by_share(_asked(questions), rows, ["fact_no"], least).withColumnRenamed("scope", "doc_id")
    return fact_rows.select("doc_id", "fact_no", "answer", "source").join(found.hint("merge"), ["doc_id", "fact_no"]).select("question_id", "answer", "source", "score")


def best_sections(questions: DataFrame, sections: DataFrame, least: float = 0.12) -> DataFrame:
    """(question_id, answer, source, score): the section with the largest share of the question's words; the first wins."""
    words = T.significant_words(F.concat_ws(" ", "title", "content"))
    rows = sections.select(F.col("doc_id").alias("scope"), F.lit(None).cast("string").alias("doc"), words.alias("words"), "section_no")
    found = best_passages(_asked(questions), rows, ["section_no"], 1, (0.0, 1.0), least).withColumnRenamed("scope", "doc_id")
    found = found.join(sections.select("doc_id", "section_no", "title", "content"), ["doc_id", "section_no"])
    return found.select("question_id", S.excerpt(F.col("content"), 320, collapse=False).alias("answer"), F.coalesce("title", F.lit("Text")).alias("source"), "score")


def comparisons(questions: DataFrame, entities: DataFrame, most: int = 4) -> DataFrame:
    """(question_id, answer): questions with a comparing word that name two entities or more; the first four of them.

    entities is (doc_id, entity_no, key, summary); a key is met as a part of the lower-case question of its document.
    """
    low = F.concat(F.lit(" "), F.lower("question"), F.lit(" "))
    trigger = F.lit(False)
    for w in COMPARE_WORDS:
        trigger = trigger | low.contains(w)
    asked = questions.filter(trigger).select("question_id", "doc_id", F.lower("question").alias("asked"))
    met = names_in_texts(asked, entities.select("doc_id", "entity_no", F.lower("key").alias("name"), "summary"), "doc_id", "name", "asked")
    ranked = met.withColumn("rn", F.row_number().over(W.partitionBy("question_id").orderBy("entity_no"))).filter(F.col("rn") <= most)
    out = ranked.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "summary"))), lambda x: x["summary"]), "\n").alias("answer"))
    return out.filter("n >= 2").drop("n")


def answers(questions: DataFrame, compared: DataFrame, fact_hits: DataFrame, section_hits: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """(question_id, answer, confidence): the answer of the document's own data, or of passages.

    A comparison or the best fact of the document is sure. Without one a passage that is no weak match goes before a
    section of the text, as it is found in the same text and names its place; a weak one goes after it. Questions whose
    column scope is 'all' (as against 'document', the default) ask all documents of the user: there a passage that is no
    weak match goes first, then what the document says.
    """
    everywhere = F.col("scope") == "all" if "scope" in questions.columns else F.lit(False)
    j = questions.select("question_id", F.coalesce(everywhere, F.lit(False)).alias("everywhere"))
    j = j.join(compared.select("question_id", F.col("answer").alias("a1")), "question_id", "left")
    j = j.join(fact_hits.select("question_id", F.col("answer").alias("a2")), "question_id", "left")
    j = j.join(section_hits.select("question_id", F.col("answer").alias("a3")), "question_id", "left")
    a4, c4 = F.lit(None).cast("string"), F.lit(None).cast("string")
    if retrieved is not None:
        j = j.join(retrieved.select("question_id", F.col("answer").alias("a4"), F.col("confidence").alias("c4")), "question_id", "left")
        a4, c4 = F.col("a4"), F.col("c4")
    own = F.coalesce("a1", "a2")
    better = F.when(c4 != "low", a4)
    first = F.when(F.col("everywhere"), better)
    answer = F.coalesce(first, own, better, "a3", a4, F.lit(S.MISSING))
    confidence = F.when(first.isNotNull(), c4).when(own.isNotNull(), "high").when(better.isNotNull(), c4).when(F.col("a3").isNotNull(), "medium").otherwise("low")
    return j.select("question_id", answer.alias("answer"), confidence.alias("confidence"))


def first_confident(engines: list[DataFrame]) -> DataFrame:
    """(question_id, answer, confidence): the first answer of the engines, in order, that is not of low confidence; else the first."""
    all_ = union([e.select("question_id", "answer", "confidence").withColumn("engine", F.lit(i)) for i, e in enumerate(engines)])
    order = F.struct((F.col("confidence") == "low").cast("int"), "engine")
    return all_.groupBy("question_id").agg(F.min_by("answer", order).alias("answer"), F.min_by("confidence", order).alias("confidence"))


def recent_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", most: int = 8, longest: int = 1200) -> DataFrame:
    """The last eight user and assistant turns with content of each conversation, oldest first, cut to 1,200 characters."""
    own = messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    last = own.withColumn("_b", F.row_number().over(W.partitionBy(conv).orderBy(F.desc(turn), F.desc("text")))).filter(F.col("_b") <= most)
    place = F.row_number().over(W.partitionBy(conv).orderBy(F.desc("_b")))
    return last.select(conv, place.alias("place"), turn, "role", F.substring("text", 1, longest).alias("text"))


def suggested_questions(columns: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, questions): up to six questions that the document's columns can answer."""
    c = F.col("column")
    asked = F.when(F.col("semantic_type").isin("currency", "number", "quantity"), F.concat(F.lit("What is the total "), c, F.lit("?"))).when(F.col("semantic_type") == "percentage", F.concat(F.lit("What is the average "), c, F.lit("?"))).when(F.col("semantic_type") == "category", F.concat(F.lit("Which "), c, F.lit(" leads?"))).when(F.col("semantic_type") == "date", F.concat(F.lit("What period does "), c, F.lit(" cover?")))
    ordered = F.array_sort(F.collect_list(F.when(asked.isNotNull(), F.struct("dataset", "position", asked.alias("q")))))
    return columns.groupBy("doc_id").agg(F.slice(F.transform(ordered, lambda x: x["q"]), 1, most).alias("questions"))


def suggested_market_questions(tables: dict[str, DataFrame], most: int = 6) -> DataFrame:
    """(doc_id, questions): up to six questions that a market report's tables can answer, in a fixed order.

    tables may hold equities, indices, market_overview, exchange_rates, bond_trades and bonds, each with doc_id.
    """

    def asked(name: str, place: int, text: Column, order: list | None = None) -> list[DataFrame]:
        if name not in tables:
            return []
        t = tables[name]
        rows = t.groupBy("doc_id").agg(F.min_by(text, F.struct(*order)).alias("q") if order else F.max(text).alias("q"))
        return [rows.filter("q IS NOT NULL").select("doc_id", F.lit(place).alias("place"), "q")]

    usd = (F.upper("currency") != "USD").cast("int")
    found = [
        *asked("equities", 1, F.concat(F.lit("What was the closing price of "), F.col("ticker"), F.lit("?")), ["line_no"]),
        *asked("indices", 2, F.concat(F.lit("How did the index "), F.col("name"), F.lit(" do?")), ["line_no"]),
        *asked("market_overview", 3, F.when(F.col("market_capitalization").isNotNull(), F.lit("What is the market capitalization?"))),
        *asked("market_overview", 4, F.when(F.col("equity_turnover").isNotNull(), F.lit("What was the equity turnover?"))),
        *asked("exchange_rates", 5, F.concat(F.lit("What is the exchange rate of "), F.col("currency"), F.lit("?")), [usd, F.col("line_no")]),
        *asked("bond_trades", 6, F.lit("Which bonds were traded?")),
    ]
    if "bonds" in tables:
        n = tables["bonds"].groupBy("doc_id").agg(F.concat(F.lit("How many bonds are listed ("), F.count(F.lit(1)).cast("string"), F.lit(")?")).alias("q"))
        traded = tables["bond_trades"].select("doc_id").distinct() if "bond_trades" in tables else None
        found.append((n if traded is None else n.join(traded, "doc_id", "left_anti")).select("doc_id", F.lit(6).alias("place"), "q"))
    each = union(found)
    always = each.select("doc_id").distinct().select("doc_id", F.posexplode(F.array(F.lit("What matters most in this report?"), F.lit("What looks unusual?"))).alias("p", "q")).select("doc_id", (F.col("p") + 7).alias("place"), "q")
    ordered = F.array_sort(F.collect_list(F.struct("place", "q")))
    return each.unionByName(always).groupBy("doc_id").agg(F.slice(F.transform(ordered, lambda x: x["q"]), 1, most).alias("questions"))


def suggest_visualization(requests: DataFrame, columns: DataFrame, axis_counts: DataFrame) -> DataFrame:
    """(request_id, dataset, x, y, chart_type): the measure and axis that a chart request (request_id, doc_id, query) names best.

    Words shared with the dataset's name count one, with the measure's two; a named axis goes before the first date or
    category; up to six values make a pie, a date a line, else bars.
    """
    q = requests.select("request_id", "doc_id", T.significant_words(F.col("query")).alias("qw"))

    def shared(c: str) -> Column:
        return F.size(F.array_intersect("qw", T.significant_words(F.col(c))))

    own = q.join(columns, "doc_id")
    measures = own.filter(F.col("semantic_type").isin("currency", "number", "quantity")).withColumn("s", shared("dataset") + 2 * shared("column"))
    y = measures.groupBy("request_id", "doc_id").agg(F.min_by(F.struct("dataset", F.col("column").alias("y")), F.struct(-F.col("s"), "dataset", "position")).alias("m")).select("request_id", "doc_id", "m.dataset", "m.y")
    axes = own.filter(F.col("semantic_type").isin("date", "category")).join(axis_counts, [*KEY, "column"], "left").withColumn("named", shared("column") > 0)
    axes = axes.filter((F.col("semantic_type") == "date") | F.col("named") | F.col("axis_values").between(2, 12))
    best = F.min_by(F.struct("column", "semantic_type", "axis_values"), F.struct((~F.col("named")).cast("int"), (F.col("semantic_type") != "date").cast("int"), "position"))
    x = axes.groupBy("request_id", *KEY).agg(best.alias("a"))
    kind = F.when(F.col("a.semantic_type") == "date", "line").when(F.col("a.axis_values") <= 6, "pie").otherwise("bar")
    return y.join(x, ["request_id", *KEY]).select("request_id", "dataset", F.col("a.column").alias("x"), "y", kind.alias("chart_type"))
