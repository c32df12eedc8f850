"""Scalar text functions as Column expressions.

White space, letters and digits are Unicode's, as in the record formats that the engine reads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1c-\x1f]+"
#: What ``WS`` matches, one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = "\r\n|[\n\r\x0b\f\x1c-\x1e\u0085  ]"

# Word lists and patterns of the domain, in their order.
ADMINISTRATIVE = ("CIN", "PAN", "TAN", "DIN", "UDIN", "GST", "ISBN")
MAJOR_SECTION = r"(?iuU)^SECTION\s+([IVXLC]+)\s*[:\-–—]\s*(.+?)$"
NESTED_SECTION = r"(?iuU)^Section\s+\d+\s*[:\-–—]\s*(.+?)$"
HEADING_EDGES = " \t\r\n-–—•·:;,."
NUMBER = r"(?U)^\(?[-–—]?[₹$]?\d[\d,]*(?:\.\d+)?\)?%?$"
MONTH_DATE = r"(?iuU)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+(?:19|20)\d{2}\b"
HEADER_WORDS = r"(?iuU)^(particulars|notes?|as at|as of|for the (?:year|period|six|nine|three)|year ended|period ended|(?:six|nine|three) months?|fiscal(?:\s+\d{4})?|fy\s?\d{2,4})\b"
#: Characters of a header at most.
HEADER_CHARS = 120
UNIT = r"(?iuU)^\(.*(?:₹|rs\.?|inr|million|crore|lakh|thousand).*\)$|^(?:₹|rs\.?|inr)\s*(?:in\s+)?(?:million|crore|lakh|thousand)"
YEAR = r"(?iuU)^(?:FY|Fiscal)?\s?(?:19|20)\d{2}(?:[-–/](?:\d{2}|\d{4}))?$"
BOILERPLATE = r"(?iuU)intentionally left blank|^\s*page\s+\d+\s+of\s+\d+\s*$"
PAGE_NUMBER = r"(?iuU)^(?:page\s*)?[-–—]?\s*(\d{1,4}|[ivxl]{1,6})\s*[-–—]?$"
INTRO = r"(?iuU)\b(following|below|table|set out|presents?|summary|summari[sz]es?|as under|as follows)\b"
OUTRO = r"(?iuU)read in conjunction|should be read|to be read together|^notes?\b|^source\s*:|^\*"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "did", "do", "does", "for", "from", "has", "have", "how", "in", "is", "it", "may", "of",
    "on", "or", "the", "this", "that", "these", "those", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will", "with", "would",
)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def tokens(c: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(c, WS), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def meaningful_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, WS, ""))


def replacement_ratio(c: Column) -> Column:
    marks = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return marks / F.greatest(meaningful_chars(c), F.lit(1))


def native_quality(text: Column, images: Column) -> Column:
    """The flag of extracted text: the first rule that holds decides."""
    chars, n = meaningful_chars(text), word_count(text)
    suspicious = (chars == 0) | (replacement_ratio(text) > 0.005) | ((images > 0) & (chars < 100) & (n < 20)) | ((chars < 30) & (n < 5))
    return F.when(suspicious, "suspicious").otherwise("normal")


def ocr_quality(text: Column) -> Column:
    chars = meaningful_chars(text)
    return F.when((chars == 0) | ((chars < 30) & (word_count(text) < 5)), "suspicious").otherwise("normal")


def ocr_wins(ocr_flag: Column, ocr_text: Column, native_text: Column) -> Column:
    return (ocr_flag == "normal") & (meaningful_chars(ocr_text) > meaningful_chars(native_text))


def detector_lines(text: Column) -> Column:
    """Cleaned lines of a page without the empty ones."""
    return F.filter(F.transform(F.split(text, LINE_ENDS), collapse), lambda x: x != "")


def chunker_lines(text: Column) -> Column:
    """Stripped lines, blank ones kept."""
    return F.transform(raw_lines(text), strip)


def raw_lines(text: Column) -> Column:
    """The same lines as they stand."""
    for end in ("\r\n", "\r", "\f"):
        text = F.replace(text, F.lit(end), F.lit("\n"))
    return F.split(text, "\n")


def is_contents_page(lines: Column) -> Column:
    """Whether one of the first twenty lines is the title of a table of contents."""
    return F.exists(F.slice(lines, 1, 20), lambda x: F.trim(F.regexp_replace(F.upper(x), "[^A-Z ]", "")).isin("TABLE OF CONTENTS", "CONTENTS"))


def heading(c: Column) -> Column:
    return strip(F.btrim(c, F.lit(HEADING_EDGES)))


def major_section(line: Column) -> Column:
    return F.when(line.rlike(MAJOR_SECTION), heading(F.regexp_extract(line, MAJOR_SECTION, 2)))


def nested_section(line: Column) -> Column:
    return F.when(line.rlike(NESTED_SECTION), heading(F.regexp_extract(line, NESTED_SECTION, 1)))


def _only(c: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(c, outside, ""))


def is_upper_heading(line: Column) -> Column:
    x = heading(line)
    letters = _only(x, r"\P{L}")
    ok = F.length(x).between(3, 100) & ~x.rlike(r"(?U)^\d+[.)]\s+") & ~F.upper(x).isin(*ADMINISTRATIVE) & ~x.rlike("[.,;]")
    share = (letters >= 3) & (_only(x, r"\P{IsUppercase}") >= 0.9 * letters) & (_only(x, r"(?U)\D") <= 0.4 * F.length(x))
    return ok & share & ((word_count(x) > 1) | (F.length(x) >= 6))


def norm_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def shape(c: Column) -> Column:
    return F.regexp_replace(F.lower(collapse(c)), r"(?U)\d+", "#")


def is_unit_line(c: Column) -> Column:
    return (F.length(c) <= 100) & strip(c).rlike(UNIT)


def is_header_line(c: Column, words: Column | None = None) -> Column:
    """``words``, where they are a column already, are those of a line that is stripped."""
    x, words = (strip(c), tokens(strip(c))) if words is None else (c, words)
    year = x.contains("19") | x.contains("20")  # a search for dates is dear
    dated = ~x.endswith(".") & (x.rlike(HEADER_WORDS) | year & x.rlike(MONTH_DATE)) & (F.size(words) <= 12)
    unit = (F.length(x) <= 100) & x.rlike(UNIT)
    return (x != "") & (F.length(x) <= HEADER_CHARS) & (unit | F.forall(words, lambda w: w.rlike(YEAR)) | dated)


def is_value(token: Column) -> Column:
    return token.rlike(NUMBER) | token.isin("-", "–", "—")


def ends_as_value(line: Column) -> Column:
    """Whether the last word of a stripped line may be a value, by its last character."""
    return F.right(line, F.lit(1)).rlike(r"(?U)^[\d,)%\-–—]")


def line_kind(c: Column, words: Column | None = None, values: Column | None = None) -> Column:
    """blank, hdr, num (values alone), row (a label, then two values or more) or text.  Of a stripped line, ``words`` and
    whether each is one of ``values`` are best columns that are computed already; values are looked at only where the
    line ``ends_as_value``, words there and in lines of ``HEADER_CHARS`` at most."""
    x = strip(c) if words is None else c
    header = is_header_line(c, words)
    words = tokens(c) if words is None else words
    values = F.transform(words, is_value) if values is None else values
    run = F.coalesce(F.nullif(F.array_position(F.reverse(values), False), F.lit(0)) - 1, F.size(values)).cast("int")  # values at the end
    label = F.concat_ws(" ", F.slice(words, 1, F.greatest(F.size(words) - run, F.lit(0))))
    return (
        F.when(x == "", "blank").when(header, "hdr").when(~ends_as_value(x), "text").when(F.forall(values, lambda v: v), "num")
        .when((run >= 2) & label.rlike(r"\p{L}"), "row").otherwise("text")
    )


def is_short(c: Column) -> Column:
    x = strip(c)
    return (F.length(x) <= 90) & ~x.endswith(".") & (word_count(x) <= 12)


def is_chunk_heading(line: Column, kind: Column, section: Column, subsection: Column) -> Column:
    """What reads whole lines stands in branches: a condition's repeated parts would be computed ahead for every line."""
    x = strip(line)
    key, letters, labels = norm_key(x), _only(x, r"\P{L}"), (norm_key(section), norm_key(subsection))
    begin = norm_key(F.substring(x, 1, 16))  # of few lines the whole key is needed
    named = F.when(F.startswith(labels[0], begin) | F.startswith(labels[1], begin), (key != "") & ((key == labels[0]) | (key == labels[1]))).otherwise(False)
    upper = F.when((F.length(x) <= 100) & (kind == "text") & ~x.rlike("[.,;]$"), (letters >= 4) & (_only(x, r"\P{IsUppercase}") >= 0.9 * letters)).otherwise(False)
    return named | upper


def is_intro(c: Column, most: int = 600) -> Column:
    x = strip(c)
    return (F.length(x) <= most) & (x.endswith(":") | x.rlike(INTRO))


def is_outro(c: Column, most: int = 600) -> Column:
    x = strip(c)
    return (F.length(x) <= most) & x.rlike(OUTRO)


def page_number_candidate(c: Column) -> Column:
    """The number or numeral that the whole line is, or null."""
    x = strip(c)
    return F.when(x.rlike(PAGE_NUMBER), F.regexp_extract(x, PAGE_NUMBER, 1))


def is_boilerplate(c: Column) -> Column:
    return c.rlike(BOILERPLATE)


def with_headings(body: Column, section: Column, subsection: Column) -> Column:
    """The body under its headings, those left out that its start or the other heading says already."""
    head = norm_key(F.substring(body, 1, 400))
    first = (F.coalesce(section, F.lit("")) != "") & ~F.contains(head, norm_key(section))
    second = (F.coalesce(subsection, F.lit("")) != "") & ~F.contains(head, norm_key(subsection)) & ~(F.coalesce(first, F.lit(False)) & (norm_key(section) == norm_key(subsection)))
    return F.concat_ws("\n", F.when(first, strip(section)), F.when(second, strip(subsection)), body)


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", document_id, index)


def search_words(text: Column) -> Column:
    """Lower-case words without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(*STOPWORDS))


def with_pairs(words: Column) -> Column:
    """The words, then the pairs of neighbours among them.  ``words`` is best a column that is computed already."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat(a, F.lit("__"), b)))


def search_terms(text: Column) -> Column:
    return with_pairs(search_words(text))


def searchable(section: Column, subsection: Column, content: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (section, subsection, content)])


def keyword_positions(text: Column, keywords: list[str]) -> Column:
    """Keyword to the place (from 0) where the lower-case text first has it; keywords that it lacks are left out."""
    found = F.create_map(*[x for k in keywords for x in (F.lit(k), F.instr(F.lower(text), k) - 1)])
    return F.map_filter(found, lambda _, at: at >= 0)


def evidence_snippet(text: Column, at: Column, before: int = 350, after: int = 700) -> Column:
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at + after - start)


def preview(text: Column, most: int = 500) -> Column:
    return F.substring(F.translate(text, "\n", " "), 1, most)
