"""Words, mentions and keywords in prose, as built-in expressions and one grouping."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Months, stop words of prose and of questions, and document classes with their words.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
PROSE_STOPWORDS = (
    "the a an and or but of in on at to for with by from as is was were are be been this that these those it its their there which "
    "has have had will would could should than over into about across during per each all also not more most such other between both "
    "while after before up down out if so no yes they we"
).split()
QUESTION_STOPWORDS = (
    "a an the is are was were be been being of in on at to for and or but with this that it its as by from what which who whom how do "
    "does did has have had i you me my we our please tell show give about can"
).split()
CLASS_WORDS = {
    "Financial": ("revenue", "expense", "profit", "margin", "income", "balance", "asset", "liability", "equity", "cash flow", "turnover", "budget"),
    "Market data": ("isin", "ticker", "bond", "coupon", "exchange rate", "index", "equity", "stock", "yield", "closing price", "trading"),
    "Sales": ("product", "region", "customer", "order", "units sold", "sales", "discount"),
    "HR": ("employee", "department", "salary", "hire date", "headcount", "payroll", "staff"),
    "Operations": ("inventory", "warehouse", "shipment", "supplier", "sku", "stock level"),
    "Education": ("student", "grade", "course", "enrollment", "gpa", "semester"),
    "Government": ("budget allocation", "ministry", "district", "census", "public"),
}
CURRENCY_MENTION = (
    r"(?:[$€£¥]\s?[\d,]+(?:\.\d+)?(?:\s?(?:million|billion|thousand))?)"
    r"|(?:\b(?:USD|EUR|GBP|Frw|FRW|RWF|KES|Ksh)\s?[\d,]+(?:\.\d+)?(?:\s?(?:million|billion|thousand))?)"
)
PERCENT_MENTION = r"\b\d+(?:\.\d+)?\s?%"
LARGE_NUMBER = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"
FULL_DATE = rf"\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"
MONTH_YEAR = rf"\b(?:{MONTHS})\s+\d{{4}}\b"
NUMERIC_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
QUARTER = r"\bQ[1-4]\s+\d{4}\b"
KEYWORD = r"[A-Za-z][A-Za-z'-]{2,}"
TOKEN = r"[a-z0-9%]+(?:['.][a-z0-9]+)*"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once: a lambda's argument, where an expression inside a lambda is made for each element."""
    return F.transform(F.array(value), body)[0]


def _mentions(text: Column, patterns: tuple[tuple[str, str, str], ...], most: int) -> Column:
    """Matches of the patterns (pattern, head, sign) in turn, the first of each by lower case, at most so many.

    Head is the class of a match's first character, sign a cheaper pattern that every text with a match holds: they pass
    the places and texts without one and decide nothing else.
    """
    empty = F.array().cast("array<string>")

    def matches(t: Column, pattern: str, head: str, sign: str) -> Column:
        return F.when(t.rlike(sign), F.regexp_extract_all(t, F.lit(f"(?={head})(?:{pattern})"), F.lit(0))).otherwise(empty)

    def firsts(found: Column) -> Column:
        start = F.struct(empty.alias("kept"), empty.alias("low"))

        def add(acc: Column, m: Column) -> Column:
            low = F.lower(m)
            more = F.struct(F.concat(acc["kept"], F.array(m)).alias("kept"), F.concat(acc["low"], F.array(low)).alias("low"))
            return F.when((F.size(acc["kept"]) >= most) | F.array_contains(acc["low"], low), acc).otherwise(more)

        return F.aggregate(F.transform(found, lambda x: F.trim(x)), start, add, lambda acc: acc["kept"])

    found = F.concat(*[matches(F.coalesce(text, F.lit("")), *p) for p in patterns])
    return _bound(found, firsts)


def extract_numbers(text: Column) -> Column:
    """Amounts of money, then percentages, then numbers with thousands; the first 12."""
    money = ("[$€£¥UEGFRK]", r"[$€£¥]|[UEGFRK](?:SD|UR|BP|rw|RW|WF|ES|sh)\s?[\d,]")
    return _mentions(text, ((CURRENCY_MENTION, *money), (PERCENT_MENTION, r"\d", r"\d\s?%"), (LARGE_NUMBER, r"\d", r"\d,\d")), 12)


def extract_dates(text: Column) -> Column:
    """Full dates, then months with a year, numeric dates and quarters; the first 8."""
    month = ("[JFMASOND]", rf"[JFMASOND](?:{'|'.join(m[1:] for m in MONTHS.split('|'))})\s+\d")
    return _mentions(text, ((FULL_DATE, *month), (MONTH_YEAR, *month), (NUMERIC_DATE, r"\d", r"\d[/-]\d"), (QUARTER, "Q", r"Q[1-4]\s")), 8)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def kept_words(text: Column) -> Column:
    """Tokens in order without stop words and single characters, repeats included."""
    return F.filter(tokenize(text), lambda w: ~w.isin(*QUESTION_STOPWORDS) & (F.char_length(w) > 1))


def kept_line(text: Column) -> Column:
    """kept_words() with a space between them, Arrow batch by batch; for passages of bounded length."""
    token, stop = re.compile(TOKEN), frozenset(QUESTION_STOPWORDS)

    @F.pandas_udf("string")
    def line(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join([w for w in token.findall(t.lower()) if len(w) > 1 and w not in stop]) if t else "")

    return line(text)


def significant_words(text: Column) -> Column:
    return F.array_distinct(kept_words(text))


def overlap_score(question: Column, candidate: Column) -> Column:
    """Share of the question's words among the candidate's; both are arrays of distinct words."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(question, candidate)).cast("double"), F.size(question).cast("double")), F.lit(0.0))


def keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 10) -> DataFrame:
    """(id, keyword, count, rank): words said more than once, by count and then first place, the first ten a document."""
    # An id of one row is counted in its row; rows that repeat an id, or have none, are counted together.
    docs = docs.select(id_col, text_col)
    repeated = docs.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("__id"))
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    alone = docs.join(repeated, same, "left_anti").select(id_col, F.posexplode(top_words(F.col(text_col), most)).alias("place", "w"))
    words = docs.join(repeated, same, "left_semi").select(id_col, F.posexplode(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(KEYWORD), F.lit(0))).alias("pos", "word"))
    counts = (
        words.select(id_col, "pos", F.lower("word").alias("keyword"))
        .filter(~F.col("keyword").isin(*PROSE_STOPWORDS))
        .groupBy(id_col, "keyword")
        .agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first_pos"))
        .filter("count > 1")
    )
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("count"), "first_pos"))
    together = counts.withColumn("rank", rank).filter(F.col("rank") <= most).select(id_col, "keyword", "count", "rank")
    return alone.select(id_col, "w.keyword", "w.count", (F.col("place") + 1).alias("rank")).unionByName(together)


def top_words(text: Column, most: int) -> Column:
    """array of (keyword, count): a text's keywords said more than once, by count and then first place, the first `most`."""
    word, stop = re.compile(KEYWORD), frozenset(PROSE_STOPWORDS)

    @F.udf("array<struct<keyword:string,count:bigint>>", useArrow=True)
    def top(t: str | None):
        counts = Counter(map(str.lower, word.findall(t or "")))
        # Counter keeps first places; sorting is stable.
        said = [(w, n) for w, n in counts.items() if n > 1 and w not in stop]
        return sorted(said, key=lambda x: -x[1])[:most]

    return top(text)


def classify(text: Column) -> tuple[Column, Column]:
    """(document type, confidence) from the class words that a text, column names included, contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {k: sum((low.contains(w).cast("int") for w in ws), F.lit(0)) for k, ws in CLASS_WORDS.items()}
    scores = F.array(*[F.struct(h.alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, (k, h) in enumerate(hits.items())])
    ranked = F.sort_array(scores, asc=False)
    best, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    tie = (best["n"] >= 2) & (best["n"] == second["n"])
    label = F.when(best["n"] == 0, "General dataset").when(tie, "General business").otherwise(best["label"])
    confidence = F.when(best["n"] == 0, "low").when(tie | (best["n"] < 2), "medium").otherwise("high")
    return label, confidence
