"""Scalar column functions: cleaning, parsing, testing and formatting of cells. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and marks with a meaning in cells and column names.
NOT_A_NUMBER = ("-", "—", "N/A", "n/a", "NA")
CURRENCY_WORDS = r"(?i)\b(frw|rwf|usd)\b"
CURRENCY_MARKS = "[$€£¥]"
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"
BOOLEANS = ("true", "false", "yes", "no", "y", "n", "0", "1", "active", "inactive")
DATE_LIKE = r"(?i)[/\-]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
CURRENCY_HINTS = ("price", "cost", "revenue", "expense", "salary", "income", "amount", "turnover", "value", "total", "budget", "fee", "payment", "profit", "margin")
PERCENT_HINTS = ("percent", "pct", "%", "rate", "growth", "margin", "ratio")
IDENTIFIER_HINTS = ("id", "isin", "code", "sku", "ref", "number", "no.")
QUANTITY_HINTS = ("quantity", "qty", "volume", "units", "count", "stock", "headcount")
DATE_HINTS = ("date", "year", "month", "period", "day", "time")
MISSING = "not available in this document"

_SPACE = r"(?U)[\s ]+"
_EDGES = r"(?U)^[\s ]+|[\s ]+$"


# Nearly all cells are plain: these tests pass them by what the Unicode patterns cost, and decide nothing else.
_LOOSE_ENDS = r"^[^!-~]|[^!-~]\z"
_LOOSE = r"^ | \z|  |[^ -~]"
_ISO_DAY = r"^[1-9]\d{3}-\d\d-\d\d\z"


def _strip_any(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), _EDGES, "")


def strip(c: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    t = c.cast("string")
    return F.when(t.rlike(_LOOSE_ENDS), _strip_any(t)).otherwise(t)


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; nothing left is null."""
    t = c.cast("string")
    return F.when(t.rlike(_LOOSE), F.nullif(_strip_any(F.regexp_replace(t, _SPACE, " ")), F.lit(""))).when(t != "", t)


def has_text(c: Column) -> Column:
    """Whether clean_text() leaves anything: some character is no white space. The test ends at the first one."""
    t = c.cast("string")
    return F.coalesce(t.rlike("[!-~]") | t.rlike(r"(?U)[^\s\u00a0]"), F.lit(False))


def parse_number(c: Column) -> Column:
    """A cell as double: percent signs, currency words and marks, commas and pluses go; (x) is -x; other text is null."""
    plain = c.cast("string")
    raw = _strip_any(c)
    t = _strip_any(F.regexp_replace(F.regexp_replace(raw, "%", ""), CURRENCY_WORDS, ""))
    t = F.regexp_replace(_strip_any(F.regexp_replace(t, CURRENCY_MARKS, "")), "[,+]", "")
    t = F.regexp_replace(t, r"(?s)^\((.*)\)$", "-$1")
    return F.when(plain.rlike(NUMBER), plain.try_cast("double")).when(~raw.isin(*NOT_A_NUMBER) & t.rlike(NUMBER), t.try_cast("double"))


def parse_percent(c: Column) -> Column:
    return parse_number(F.regexp_replace(c.cast("string"), "%", ""))


def parse_int(c: Column) -> Column:
    """Rounded half to even."""
    return F.bround(parse_number(c), 0).cast("long")


def _rewrite(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def _iso_date(c: Column) -> Column:
    """A date from year-month-day text, in which #Name may stand for the month and yNN for a two-digit year."""
    c = _rewrite(c, ((r"^y(69|[7-9]\d)-", "19$1-"), (r"^y(\d\d)-", "20$1-")))
    place = (F.position(F.lower(F.regexp_extract(c, "#([A-Za-z]{3})", 1)), F.lit(MONTH_STARTS)) + 2) / 3
    iso = F.regexp_replace(c, F.lit("#[A-Za-z]+"), place.cast("int").cast("string"))
    return F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(iso, F.lit("yyyy-M-d")).cast("date"))


MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_STRICT = (
    (r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", "$4-$3-$1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "y$3-$2-$1"),
    (rf"(?i)^(\d{{1,2}})\s+({MONTH_NAME})\s+(\d{{4}})$", "$3-#$2-$1"),
)
_WIDE = (
    (r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}.*$", "$1"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    (r"^(0?[1-9]|1[0-2])([/-])(1[3-9]|2\d|3[01])\2(\d{4})$", "$4-$1-$3"),
    (rf"(?i)^({MONTH_NAME})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})$", "$3-#$1-$2"),
    (rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+({MONTH_NAME})\.?,?[\s-]+(\d{{4}})$", "$3-#$2-$1"),
    (rf"(?i)^({MONTH_NAME})\.?,?\s+(\d{{4}})$", "$2-#$1-1"),
)


def parse_date(c: Column) -> Column:
    """Strict formats, day before month; two-digit years from 69 on are of the 1900s."""
    t = c.cast("string")
    return F.when(t.rlike(_ISO_DAY), t.try_cast("date")).otherwise(_iso_date(_rewrite(_strip_any(t), _STRICT)))


def parse_date_builtin(c: Column) -> Column:
    """parse_date and the usual other spellings: month first in words, year first with slashes, ISO with a time."""
    t = c.cast("string")
    day = F.when(t.rlike(_ISO_DAY), t.try_cast("date")).otherwise(_iso_date(_rewrite(_strip_any(t), _STRICT[1:] + _WIDE + _STRICT[:1])))
    return F.when(F.year(day).between(1900, 2100), day)


def could_be_date(c: Column) -> Column:
    return c.cast("string").rlike(DATE_LIKE)


def is_ambiguous_date(c: Column) -> Column:
    """A numeric date whose first two parts could each be the month, and differ."""
    t, form = strip(c), r"^(\d{1,2})[/\-](\d{1,2})[/\-]\d{2,4}$"
    a, b = (F.regexp_extract(t, form, k).try_cast("int") for k in (1, 2))
    return F.coalesce(t.rlike(form) & (a <= 12) & (b <= 12) & (a != b), F.lit(False))


def looks_percent(c: Column) -> Column:
    return F.coalesce(strip(c).endswith("%"), F.lit(False))


def looks_currency(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(CURRENCY_MARKS), F.lit(False))


def looks_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin(*BOOLEANS), F.lit(False))


def name_has(c: Column, hints: tuple[str, ...]) -> Column:
    """The lower-case name contains one of the hints, anywhere."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(h) for h in hints])


def format_number(c: Column, digits: int = 2) -> Column:
    """Thousands separated, whole numbers without decimals; null reads as MISSING."""
    whole = F.format_number(c, 0)
    return F.coalesce(F.when(c == F.bround(c, 0), whole).otherwise(F.format_number(F.bround(c, digits), digits)), F.lit(MISSING))


def format_currency(c: Column, code: str = "FRW") -> Column:
    return F.coalesce(F.concat(F.lit(f"{code} "), F.when(c.isNotNull(), format_number(c))), F.lit(MISSING))


def format_percent(c: Column, digits: int = 2) -> Column:
    return F.coalesce(F.concat(F.format_number(F.bround(c, digits), digits), F.lit("%")), F.lit(MISSING))


def compact_number(c: Column) -> Column:
    """1.2K, 3.4M, 5.6B; smaller numbers as they are."""
    a = F.abs(c)
    cases = F.when(a >= 1e9, F.concat(F.format_number(c / 1e9, 1), F.lit("B"))).when(a >= 1e6, F.concat(F.format_number(c / 1e6, 1), F.lit("M")))
    return cases.when(a >= 1e3, F.concat(F.format_number(c / 1e3, 1), F.lit("K"))).otherwise(format_number(c))


def trend_direction(c: Column) -> Column:
    return F.when(c > 0, "up").when(c < 0, "down").otherwise("flat")


def sanitize_filename(c: Column) -> Column:
    """The last path part, printable characters only; nothing left reads 'upload'."""
    base = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^.*/", "")
    return F.coalesce(F.nullif(strip(F.regexp_replace(base, r"\p{C}", "")), F.lit("")), F.lit("upload"))


def page_from_label(c: Column) -> Column:
    """The first page number of a label such as 'page 3' or 'pages 2-4'."""
    return F.regexp_extract(F.lower(c), r"pages?\s+(\d+)", 1).try_cast("int")


def excerpt(c: Column, most: int = 420, collapse: bool = True) -> Column:
    """At most so many characters, cut at a word, with an ellipsis if cut."""
    t = clean_text(c) if collapse else strip(c)
    cut = F.regexp_replace(F.substring(t, 1, most), r"\s+\S*$", "")
    return F.when(F.char_length(t) > most, F.concat(cut, F.lit("…"))).otherwise(t)


def source_type(name: Column) -> Column:
    """Kind of a file by its extension; null for any that is not read."""
    # Extensions by kind.
    kinds = {"pdf": ("pdf",), "excel": ("xlsx", "xls", "xlsm"), "csv": ("csv",), "docx": ("docx",), "txt": ("txt",), "json": ("json", "jsonl", "ndjson")}
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(*[F.when(ext.isin(*e), F.lit(k)) for k, e in kinds.items()])


def signature_matches(kind: Column, content: Column) -> Column:
    """The first bytes agree with the kind; kinds of plain text always do."""
    # Leading bytes in hexadecimal.
    head = F.hex(F.substring(content, 1, 8))
    zip_, ole = head.startswith("504B0304"), head.startswith("D0CF11E0A1B11AE1")
    return F.when(kind == "pdf", head.startswith("255044462D")).when(kind == "docx", zip_).when(kind == "excel", zip_ | ole).otherwise(kind.isNotNull())


def looks_formula(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(r"^[=+\-@]"), F.lit(False))


def neutral_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula, marked as text."""
    return F.when(looks_formula(c), F.concat(F.lit("'"), c)).otherwise(c)


def classify_figure(caption: Column, width: Column, height: Column) -> Column:
    """'chart-like' by a caption word or a moderate aspect ratio, else 'image'."""
    hint = name_has(F.coalesce(caption, F.lit("")), ("chart", "graph", "figure", "plot"))
    aspect = F.try_divide(width.cast("double"), height.cast("double"))
    return F.when(hint | aspect.between(0.6, 1.8), "chart-like").otherwise("image")
