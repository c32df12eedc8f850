"""DuckDB's SQL for the queries that SQL can express, written from the operators' definitions."""

from __future__ import annotations

from docengine.functions.text import STOPWORDS
from docengine.plans.tables import HEADED_SQL, NOISY_SQL, PAGES_SQL, SHEETS_SQL

NL = "chr(10)"
EDGES = "' ' || chr(9) || chr(13) || chr(10) || '-–—•·:;,.'"
MAJOR = r"(?i)^SECTION\s+([IVXLC]+)\s*[:\-–—]\s*(.+?)$"
NESTED = r"(?i)^Section\s+\d+\s*[:\-–—]\s*(.+?)$"
VALUE = r"^\(?[-–—]?[₹$]?\d[\d,]*(?:\.\d+)?\)?%?$|^[-–—]$"
DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+(?:19|20)\d{2}\b"
HEADER = r"(?i)^(particulars|notes?|as at|as of|for the (?:year|period|six|nine|three)|year ended|period ended|(?:six|nine|three) months?|fiscal(?:\s+\d{4})?|fy\s?\d{2,4})\b"
UNIT = r"(?i)^\(.*(?:₹|rs\.?|inr|million|crore|lakh|thousand).*\)$|^(?:₹|rs\.?|inr)\s*(?:in\s+)?(?:million|crore|lakh|thousand)"
YEAR = r"(?i)^(?:FY|Fiscal)?\s?(?:19|20)\d{2}(?:[-–/](?:\d{2}|\d{4}))?$"
NUMBER = r"(?i)^(?:page\s*)?[-–—]?\s*(\d{1,4}|[ivxl]{1,6})\s*[-–—]?$"
INTRO = r"(?i)\b(following|below|table|set out|presents?|summary|summari[sz]es?|as under|as follows)\b"
OUTRO = r"(?i)read in conjunction|should be read|to be read together|^notes?\b|^source\s*:|^\*"
BOILERPLATE = r"(?i)intentionally left blank|^\s*page\s+\d+\s+of\s+\d+\s*$"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def words(x: str) -> str:
    return f"len({tokens(x)})"


def chars(x: str) -> str:
    return rf"length(regexp_replace({x}, '\s+', '', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def heading(x: str) -> str:
    return strip(f"trim({x}, {EDGES})")


def key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"


def shape(x: str) -> str:
    return rf"regexp_replace(lower({collapse(x)}), '\d+', '#', 'g')"


def ratio(x: str) -> str:
    return f"((length({x}) - length(replace({x}, chr(65533), ''))) / greatest({chars(x)}, 1))"


def flag(x: str, images: str) -> str:
    c, w = chars(x), words(x)
    return f"CASE WHEN {c} = 0 OR {ratio(x)} > 0.005 OR ({images} > 0 AND {c} < 100 AND {w} < 20) OR ({c} < 30 AND {w} < 5) THEN 'suspicious' ELSE 'normal' END"


def ocr_flag(x: str) -> str:
    return f"CASE WHEN {chars(x)} = 0 OR ({chars(x)} < 30 AND {words(x)} < 5) THEN 'suspicious' ELSE 'normal' END"


def major(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{MAJOR}') THEN {heading(f"regexp_extract({x}, '{MAJOR}', 2)")} END"


def nested(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NESTED}') THEN {heading(f"regexp_extract({x}, '{NESTED}', 1)")} END"


def upper_heading(x: str) -> str:
    h = heading(x)
    letters, upper, digits = (f"length(regexp_replace({h}, '{p}', '', 'g'))" for p in (r"[^\p{L}]", r"[^\p{Lu}]", r"[^\d]"))
    return (
        rf"(length({h}) BETWEEN 3 AND 100 AND NOT regexp_matches({h}, '^\d+[.)]\s+') AND upper({h}) NOT IN ('CIN','PAN','TAN','DIN','UDIN','GST','ISBN')"
        f" AND NOT regexp_matches({h}, '[.,;]') AND {letters} >= 3 AND {upper} >= 0.9 * {letters} AND {digits} <= 0.4 * length({h}) AND ({words(h)} > 1 OR length({h}) >= 6))"
    )


def is_contents(lines: str) -> str:
    return f"len(list_filter({lines}[1:20], lambda x: trim(regexp_replace(upper(x), '[^A-Z ]', '', 'g')) IN ('TABLE OF CONTENTS', 'CONTENTS'))) > 0"


def terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN ({stop}))"


MEASURED = f"{PAGES_SQL}, measured AS (SELECT *, length(text) AS character_count, {words('text')} AS word_count, {flag('text', 'image_count')} AS quality_flag FROM pages_in)"

MERGED = f"""{MEASURED}, pairs AS (
  SELECT m.*, n.text AS other, coalesce(m.quality_flag = 'suspicious' AND {ocr_flag('n.text')} = 'normal' AND {chars('n.text')} > {chars('m.text')}, false) AS wins
  FROM measured m LEFT JOIN measured n ON n.document_id = m.document_id AND n.page_number = m.page_number + 1
), merged AS (
  SELECT document_id, page_number, CASE WHEN wins THEN other ELSE text END AS text, CASE WHEN wins THEN 'ocr' ELSE 'pymupdf' END AS extraction_method,
    CASE WHEN wins THEN length(other) ELSE character_count END AS character_count, CASE WHEN wins THEN {words('other')} ELSE word_count END AS word_count,
    CASE WHEN wins THEN {ocr_flag('other')} ELSE quality_flag END AS quality_flag, lang AS section
  FROM pairs)"""

SHOWN = f"""{HEADED_SQL}, lined AS (
  SELECT document_id, page_number, list_filter(list_transform(string_split(text, {NL}), lambda x: {collapse('x')}), lambda x: x <> '') AS lines FROM headed
), shown AS (
  SELECT document_id, page_number, {is_contents('lines')} AS is_contents,
    CASE WHEN NOT ({is_contents('lines')}) THEN list_filter(list_transform(lines, lambda x: {major('x')}), lambda x: x IS NOT NULL)[1] END AS major,
    CASE WHEN NOT ({is_contents('lines')}) THEN list_filter(list_transform(lines, lambda x: CASE WHEN {major('x')} IS NULL THEN coalesce({nested('x')}, CASE WHEN {upper_heading('x')} THEN {heading('x')} END) END), lambda x: x IS NOT NULL)[1] END AS minor
  FROM lined)"""

FILLED = f"""{SHOWN}, segments AS (
  SELECT *, count(major) OVER w AS segment, last_value(major IGNORE NULLS) OVER w AS section FROM shown
  WINDOW w AS (PARTITION BY document_id ORDER BY page_number ROWS UNBOUNDED PRECEDING)
), filled AS (
  SELECT document_id, page_number, section, last_value(CASE WHEN segment > 0 THEN minor END IGNORE NULLS) OVER (PARTITION BY document_id, segment ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS subsection
  FROM segments)"""

LINES = f"""{NOISY_SQL}, split AS (SELECT document_id, page_number, section, list_transform(string_split(text, {NL}), lambda x: {strip('x')}) AS ls FROM noisy),
lines AS (SELECT document_id, page_number, section, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM split)"""

EDGED = f"""{LINES}, full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS rank_down, row_number() OVER (PARTITION BY document_id, page_number ORDER BY line_no DESC) AS rank_up
  FROM lines WHERE line <> ''
), edged AS (SELECT *, rank_down <= 3 OR rank_up <= 3 AS is_edge FROM full_lines)"""

SHAPES = f"{EDGED}, shapes AS (SELECT DISTINCT document_id, page_number, section, {shape('line')} AS shape FROM edged WHERE is_edge AND length(line) <= 100 AND {shape('line')} NOT IN ('', '#'))"

REPEATED = f"""{SHAPES}, own AS (SELECT document_id, section, shape, count(*) AS n FROM shapes GROUP BY ALL),
counted AS (SELECT *, sum(n) OVER (PARTITION BY document_id, shape) AS n_all FROM own),
sections AS (SELECT document_id, section, count(DISTINCT page_number) AS pages FROM full_lines GROUP BY ALL),
totals AS (SELECT *, sum(pages) OVER (PARTITION BY document_id) AS all_pages FROM sections),
judged AS (SELECT c.document_id, c.section, c.shape, n_all >= greatest(3, ceil(0.10 * all_pages)) AS everywhere, n >= greatest(3, ceil(0.25 * pages)) AS here
  FROM counted c JOIN totals t ON c.document_id = t.document_id AND c.section IS NOT DISTINCT FROM t.section),
repeated AS (SELECT document_id, section, shape, everywhere FROM judged WHERE everywhere OR here)"""

LABELS = f"""labels_in AS (SELECT DISTINCT document_id, page_number, {key('section')} AS key FROM noisy WHERE {key('section')} <> ''),
running AS (SELECT document_id, key, count(*) AS label_pages, min(page_number) AS first_page FROM labels_in GROUP BY ALL)"""

NUMBERS = rf"""ends AS (
  SELECT document_id, page_number, line_no, line, 'first' AS place FROM full_lines WHERE rank_down = 1 UNION ALL
  SELECT document_id, page_number, line_no, line, 'last' AS place FROM full_lines WHERE rank_up = 1
), numbered AS (SELECT *, regexp_extract(line, '{NUMBER}', 1) AS number FROM ends WHERE regexp_matches(line, '{NUMBER}')),
valued AS (SELECT *, CASE WHEN regexp_matches(number, '^\d+$') THEN CAST(number AS BIGINT) END AS value FROM numbered),
dropped AS (SELECT DISTINCT document_id, page_number, line_no FROM valued v WHERE value IS NULL OR regexp_matches(line, '(?i)^page') OR EXISTS (
  SELECT 1 FROM valued o WHERE o.document_id = v.document_id AND o.place = v.place AND abs(o.page_number - v.page_number) = 1 AND o.value - v.value = o.page_number - v.page_number))"""


def kind(x: str) -> str:
    ts = tokens(x)
    is_value = f"lambda w: regexp_matches(w, '{VALUE}')"
    run = f"coalesce(nullif(list_position(list_reverse(list_transform({ts}, {is_value})), false), 0) - 1, len({ts}))"
    header = f"(length({x}) <= 120 AND ((length({x}) <= 100 AND regexp_matches({x}, '{UNIT}')) OR len(list_filter({ts}, lambda w: NOT regexp_matches(w, '{YEAR}'))) = 0 OR (len({ts}) <= 12 AND NOT ends_with({x}, '.') AND (regexp_matches({x}, '{DATE}') OR regexp_matches({x}, '{HEADER}')))))"
    return (
        f"CASE WHEN len({ts}) = 0 THEN 'blank' WHEN {header} THEN 'hdr' WHEN {run} = len({ts}) THEN 'num'"
        rf" WHEN {run} >= 2 AND regexp_matches(array_to_string({ts}[1:len({ts}) - {run}], ' '), '\p{{L}}') THEN 'row' ELSE 'text' END"
    )


CLEAN = f"""{REPEATED}, {LABELS}, {NUMBERS}, kinds AS (SELECT l.*, e.is_edge, {kind('l.line')} AS kind FROM lines l LEFT JOIN edged e USING (document_id, page_number, line_no)),
marked AS (
  SELECT k.*, coalesce(is_edge, false) AND kind NOT IN ('num', 'row', 'hdr') AND length(line) <= 100 AND (
      EXISTS (SELECT 1 FROM repeated r WHERE r.document_id = k.document_id AND r.shape = {shape('k.line')} AND (r.everywhere OR r.section IS NOT DISTINCT FROM k.section))
      OR regexp_matches(line, '{BOILERPLATE}')) AS noise,
    coalesce(is_edge, false) AND {key('k.line')} <> '' AND {key('k.line')} = {key('k.section')} AND EXISTS (
      SELECT 1 FROM running g WHERE g.document_id = k.document_id AND g.key = {key('k.line')} AND label_pages >= 3 AND first_page <> k.page_number) AS label
  FROM kinds k
)"""

RUNS = f"""{LINES}, c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND section IS DISTINCT FROM lag(section) OVER w THEN 1 ELSE 0 END AS new FROM lines WINDOW w AS (PARTITION BY document_id ORDER BY page_number, line_no)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY document_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)"""


def short(x: str) -> str:
    return f"(length({x}) <= 90 AND {words(x)} <= 12 AND NOT ends_with({x}, '.'))"


#: Lines of the sheets by letters, the automaton over them line by line, and the stretches inside tables.
REGIONS = rf"""{SHEETS_SQL}, changes AS (SELECT document_id, page_number, section, CASE WHEN lag(section) OVER w IS DISTINCT FROM section AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new
    FROM (SELECT DISTINCT document_id, page_number, section FROM sheets) WINDOW w AS (PARTITION BY document_id ORDER BY page_number)),
sheet_runs AS (SELECT document_id, page_number, CAST(sum(new) OVER (PARTITION BY document_id ORDER BY page_number) AS BIGINT) AS run FROM changes),
sheet_kinds AS (SELECT s.*, run, {kind('line')} AS kind FROM sheets s JOIN sheet_runs USING (document_id, page_number)),
lettered AS (SELECT *, row_number() OVER (PARTITION BY document_id, run ORDER BY page_number, line_no) - 1 AS ord, CASE kind WHEN 'blank' THEN 'b' WHEN 'hdr' THEN 'h' WHEN 'num' THEN 'n' WHEN 'row' THEN 'r' ELSE CASE WHEN {short('line')} THEN 'c' ELSE 't' END END AS l,
    CASE WHEN line = '' THEN 'b' WHEN kind = 'text' AND length(line) <= 100 AND regexp_matches(line, '^[\p{{Lu}}\d]') AND NOT regexp_matches(line, '[.:;,]$') THEN 'T' ELSE 'x' END AS tl FROM sheet_kinds),
ahead AS (SELECT document_id, run, ord, lead(l, 1) OVER w AS n1, lead(l, 2) OVER w AS n2 FROM lettered WHERE l <> 'b' WINDOW w AS (PARTITION BY document_id, run ORDER BY ord)),
told AS (SELECT t.document_id, t.run, t.ord, t.page_number, t.l, t.tl, coalesce(n1, '') AS n1, coalesce(n2, '') AS n2 FROM lettered t LEFT JOIN ahead USING (document_id, run, ord)),
walked AS (
  SELECT document_id, run, ord, CASE WHEN l IN ('h', 'n', 'r') THEN 1 WHEN l = 'c' AND n1 IN ('n', 'r') THEN 2 ELSE 0 END AS state FROM told WHERE ord = 0
  UNION ALL SELECT t.document_id, t.run, t.ord, CASE WHEN l IN ('h', 'n', 'r') THEN 1 WHEN l = 'b' THEN state WHEN l <> 'c' THEN 0 WHEN state = 1 OR n1 IN ('n', 'r') THEN 2
    WHEN state = 2 AND n1 IN ('h', 'c', 't') AND n2 IN ('n', 'r') THEN 2 ELSE 0 END FROM walked w JOIN told t ON t.document_id = w.document_id AND t.run = w.run AND t.ord = w.ord + 1),
inside AS (SELECT t.*, state, CASE WHEN state > 0 AND coalesce(lag(state) OVER w, 0) = 0 THEN 1 ELSE 0 END AS begins FROM told t JOIN walked USING (document_id, run, ord) WINDOW w AS (PARTITION BY document_id, run ORDER BY ord)),
numbered_in AS (SELECT *, sum(begins) OVER (PARTITION BY document_id, run ORDER BY ord) AS region FROM inside),
spans AS (SELECT document_id, run, region, min(ord) AS start, max(CASE WHEN l IN ('n', 'r') THEN ord + 1 END) AS stop, count(*) FILTER (WHERE l IN ('n', 'r')) AS data FROM numbered_in WHERE state > 0 GROUP BY ALL),
good AS (SELECT s.document_id, s.run, s.start, s.stop FROM spans s JOIN numbered_in n ON n.document_id = s.document_id AND n.run = s.run AND n.ord >= s.start AND n.ord < s.stop
  GROUP BY s.document_id, s.run, s.start, s.stop, s.data HAVING s.data >= 3 AND s.data >= 0.35 * count(*) FILTER (WHERE l <> 'b')),
floored AS (SELECT *, greatest(start - 3, coalesce(lag(stop) OVER (PARTITION BY document_id, run ORDER BY start), 0)) AS floor FROM good),
titled AS (SELECT f.document_id, f.run, f.start, f.stop, coalesce(string_agg(t.tl, '' ORDER BY t.ord), '') AS above FROM floored f LEFT JOIN told t ON t.document_id = f.document_id AND t.run = f.run AND t.ord >= f.floor AND t.ord < f.start GROUP BY ALL)"""


def chunk_heading(line: str, section: str, kind: str) -> str:
    letters, upper = (f"length(regexp_replace({line}, '{p}', '', 'g'))" for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    return f"(({key(line)} <> '' AND {key(line)} = {key(section)}) OR ({letters} >= 4 AND {upper} >= 0.9 * {letters} AND length({line}) <= 100 AND NOT regexp_matches({line}, '[.,;]$') AND {kind} = 'text'))"


#: What cleaning leaves, in runs of equal section, with the place of each line in its run.
KEPT = f"""{CLEAN}, kept AS (SELECT * FROM marked WHERE NOT noise AND NOT label AND (document_id, page_number, line_no) NOT IN (SELECT document_id, page_number, line_no FROM dropped)),
kept_new AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND section IS DISTINCT FROM lag(section) OVER w THEN 1 ELSE 0 END AS new FROM kept WINDOW w AS (PARTITION BY document_id ORDER BY page_number, line_no)),
kept_run AS (SELECT *, CAST(sum(new) OVER (PARTITION BY document_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM kept_new),
kept_runs AS (SELECT *, {chunk_heading('line', 'section', 'kind')} AS heading, row_number() OVER (PARTITION BY document_id, run ORDER BY page_number, line_no) AS ord FROM kept_run)"""

TERMS = f"words_in AS (SELECT doc_id, {terms('text')} AS w FROM documents), terms_in AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '__' || w[i + 1])) AS terms FROM words_in)"

BM25 = f"""{TERMS}, queries_in AS (SELECT item_id AS query_id, {terms('text')} AS w FROM benchmark),
asked AS (SELECT query_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '__' || w[i + 1]))) AS term FROM queries_in),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
posted AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM terms_in),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM posted WHERE term IN (SELECT term FROM qtf) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM terms_in),
bm25 AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qtf JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY ALL)"""


def lexical(k: int) -> str:
    return f"lexical AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM bm25 WHERE score > 0) WHERE rank <= {k})"


def dense(k: int) -> str:
    return f"""dense AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 5) AS score
    FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN embeddings v)) WHERE rank <= {k})"""


HYBRID = f"""{BM25}, {lexical(50)}, {dense(50)}, fused AS (
  SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best FROM (SELECT query_id, rank, chunk_id FROM dense UNION ALL SELECT query_id, rank, chunk_id FROM lexical) GROUP BY ALL
), hybrid AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM fused) WHERE rank <= 10)"""

GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def first(name: str, ranked: str) -> str:
    return f"{name} AS (SELECT c.query_id AS case_id, min(r.rank) AS first_rank FROM (SELECT DISTINCT query_id FROM gold) c LEFT JOIN (SELECT * FROM {ranked} WHERE rank <= 10 AND (query_id, chunk_id) IN (SELECT query_id, chunk_id FROM gold)) r ON r.query_id = c.query_id GROUP BY ALL)"


def metrics(source: str) -> str:
    parts = [f"SELECT 'Recall@{k}' AS metric, round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS value FROM {source}" for k in (1, 3, 5, 10)]
    return " UNION ALL ".join([*parts, f"SELECT 'MRR' AS metric, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS value FROM {source}"])


SQL: dict[str, str] = {
    "page_metrics": f"SELECT doc_id, {words('text')} AS words, {chars('text')} AS chars, round({ratio('text')}, 6) AS ratio FROM documents",
    "page_quality_flags": f"WITH {MEASURED} SELECT doc_id, character_count, word_count, quality_flag FROM measured",
    "quality_flag_vs_labels": f"WITH {MEASURED} SELECT quality_flag, quality, count(*) AS n FROM measured JOIN labels USING (doc_id) GROUP BY ALL",
    "ocr_merge": f"WITH {MERGED} SELECT document_id, page_number, text, extraction_method, character_count, word_count, quality_flag FROM merged",
    "suspicious_pages": f"WITH {MEASURED} SELECT document_id, page_number, substring({collapse('text')}, 1, 200) AS preview FROM measured WHERE quality_flag = 'suspicious'",
    "ingestion_summary": f"""WITH {MERGED} SELECT document_id, count(*) AS page_count, count(*) FILTER (WHERE extraction_method <> 'ocr') AS native_pages, count(*) FILTER (WHERE extraction_method = 'ocr') AS ocr_pages,
        count(section) AS sectioned_pages, count(*) FILTER (WHERE quality_flag = 'suspicious') AS suspicious_pages FROM merged GROUP BY document_id""",
    "integrity_violations": "SELECT source AS document_id, count(*) + 1 AS page_count, count(*) AS pages FROM documents WHERE right(source, 1) = '3' GROUP BY source",
    "schema_violations": f"""WITH {MEASURED} SELECT doc_id, 'page_number' AS rule FROM measured WHERE doc_id % 7 = 0 AND page_number - 1 < 1 UNION ALL SELECT doc_id, 'quality_flag' FROM measured WHERE doc_id % 11 = 0""",
    "contents_pages": f"WITH {SHOWN} SELECT document_id, page_number FROM shown WHERE is_contents",
    "page_headings": f"WITH {SHOWN} SELECT * FROM shown",
    "section_fill": f"WITH {FILLED} SELECT * FROM filled",
    "section_transitions": f"WITH {FILLED}, b AS (SELECT *, lag(section) OVER (PARTITION BY document_id ORDER BY page_number) AS before FROM filled) SELECT document_id, page_number, section FROM b WHERE section IS DISTINCT FROM before",
    "page_lines": f"WITH {LINES} SELECT document_id, page_number, line_no, line FROM lines",
    "edge_lines": f"WITH {EDGED} SELECT document_id, page_number, line_no, rank_down, rank_up FROM edged WHERE is_edge",
    "edge_shapes": f"WITH {SHAPES} SELECT document_id, shape, count(*) AS n_pages FROM shapes GROUP BY ALL",
    "repeated_edges": f"WITH {REPEATED} SELECT * FROM repeated",
    "running_labels": f"WITH {NOISY_SQL}, {LABELS} SELECT * FROM running",
    "page_number_drops": f"WITH {EDGED}, {NUMBERS} SELECT * FROM dropped",
    "cleaned_lines": f"WITH {CLEAN} SELECT document_id, page_number, line_no, line FROM marked WHERE NOT noise AND NOT label AND (document_id, page_number, line_no) NOT IN (SELECT document_id, page_number, line_no FROM dropped)",
    "line_kinds": f"""WITH l AS (SELECT unnest(['Item ' || l_returnflag || ' ' || CAST(l_quantity AS INTEGER) || ' (' || l_linenumber || ')', CAST(l_quantity AS INTEGER) || ' - ' || l_linenumber || '%', 'Particulars of ' || l_linestatus,
        'FY' || (1990 + l_linenumber), 'As sold ' || l_linenumber || ' in all.', '(₹ in million)', 'Mar 31, 2024 and later', '  ']) AS line FROM lineitem)
        SELECT {kind('line')} AS kind, length({strip('line')}) <= 90 AND {words('line')} <= 12 AND NOT ends_with({strip('line')}, '.') AS short, count(*) AS n FROM l GROUP BY ALL""",
    "section_runs": f"""WITH {RUNS} SELECT document_id, run, count(*) AS n_lines, min(page_number) AS first_page, max(page_number) AS last_page FROM r GROUP BY ALL""",
    "table_regions": f"""WITH RECURSIVE {REGIONS} SELECT r.document_id, r.run, r.start - length(regexp_extract(above, '(?:T(?:Tb?|bT)|Tb?)$')) AS title, r.start, r.stop, t.page_number
        FROM titled r JOIN told t ON t.document_id = r.document_id AND t.run = r.run AND t.ord = r.start""",
    "paragraph_units": f"""WITH {KEPT},
        b AS (SELECT *, lag(heading) OVER w AS last_heading, lag(ord) OVER w AS last_ord FROM kept_runs WHERE line <> '' WINDOW w AS (PARTITION BY document_id, run ORDER BY ord)),
        s AS (SELECT *, CAST(heading OR last_ord IS NULL OR last_ord <> ord - 1 OR last_heading AS INTEGER) AS begins FROM b),
        u AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY document_id, run ORDER BY ord ROWS UNBOUNDED PRECEDING) AS INTEGER) AS unit FROM s)
        SELECT document_id, run, unit, CASE WHEN bool_or(heading) THEN 'heading' ELSE 'para' END AS kind, CAST(count(*) AS INTEGER) AS n_lines, CAST(sum(length(line) + 1) - 1 AS INTEGER) AS n_chars FROM u GROUP BY document_id, run, unit""",
    "chunk_invariants": f"""WITH {KEPT}, last_text AS (SELECT document_id, run, max(ord) AS last_ord FROM kept_runs WHERE line <> '' AND NOT heading GROUP BY ALL)
        SELECT document_id, CAST(sum({chars('line')}) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS broken FROM kept_runs JOIN last_text USING (document_id, run) WHERE ord <= last_ord GROUP BY document_id""",
    "context_lines": f"""WITH {NOISY_SQL}, {SHEETS_SQL}, both_lines AS (SELECT unnest(string_split(text, {NL})) AS line FROM noisy UNION ALL SELECT line FROM sheets), l AS (SELECT {strip('line')} AS line FROM both_lines),
        said AS (SELECT unnest([line, line || ':', 'Source: ' || line]) AS line FROM l)
        SELECT length({strip('line')}) <= 600 AND (ends_with({strip('line')}, ':') OR regexp_matches({strip('line')}, '{INTRO}')) AS intro, length({strip('line')}) <= 600 AND regexp_matches({strip('line')}, '{OUTRO}') AS outro, count(*) AS n FROM said GROUP BY ALL""",
    "table_chunks": f"""WITH q AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity FROM lineitem),
        t AS (SELECT 'order' || l_orderkey AS document_id, count(*) AS n, string_agg('Part sold | ' || quantity || ' | ' || l_linenumber, {NL} ORDER BY l_linenumber, quantity) AS rows,
            string_agg('Part sold ' || quantity || ' ' || l_linenumber, {NL} ORDER BY l_linenumber, quantity) AS lines FROM q GROUP BY l_orderkey)
        SELECT document_id || '_chunk_0000' AS chunk_id, document_id, 'ORDERS' || {NL} || CASE WHEN n >= 3 THEN 'Table title: Parts Of The Order' || {NL} || 'Columns: Particulars' || {NL} || rows
            ELSE 'Parts Of The Order' || {NL} || 'Particulars' || {NL} || lines END AS content, CAST(1 AS INTEGER) AS page_start, CAST(1 AS INTEGER) AS page_end, '1' AS pages,
            'ORDERS' AS section, CAST(NULL AS VARCHAR) AS subsection, CAST(0 AS INTEGER) AS chunk_index FROM t""",
    "sentence_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]\s+[A-Z(\x22“0-9]')) + 1 AS INTEGER) AS n_sentences FROM documents",
    "chunk_ids": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
        SELECT 'conv' || conv_id || '_chunk_' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, 'conv' || conv_id AS document_id, CAST(i AS INTEGER) AS chunk_index, CAST(turn + 1 AS INTEGER) AS page_start,
        CASE WHEN contains(regexp_replace(lower(substring(text, 1, 400)), '[^a-z0-9]+', '', 'g'), role) THEN text ELSE role || chr(10) || text END AS content FROM c""",
    "term_frequencies": f"WITH {TERMS}, u AS (SELECT doc_id, unnest(terms) AS term FROM terms_in) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM u GROUP BY term",
    "bm25_idf": f"WITH {TERMS}, u AS (SELECT doc_id, unnest(list_distinct(terms)) AS term FROM terms_in), d AS (SELECT term, count(*) AS df FROM u GROUP BY term), c AS (SELECT count(*) AS n FROM documents) SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM d, c",
    "doc_stats": f"WITH {TERMS} SELECT doc_id AS chunk_id, len(terms) AS dl FROM terms_in",
    "corpus_stats": f"WITH {TERMS} SELECT count(*) AS n, round(avg(len(terms)), 6) AS avgdl FROM terms_in",
    "bm25_topk": f"WITH {BM25}, {lexical(10)} SELECT * FROM lexical",
    "lexical_index_search": f"WITH {BM25}, {lexical(10)} SELECT * FROM lexical",
    "keyword_positions": "WITH k AS (SELECT unnest(['the', 'and', 'que', 'der']) AS keyword) SELECT doc_id, keyword, CAST(instr(lower(text), keyword) - 1 AS INTEGER) AS \"at\" FROM documents, k WHERE contains(lower(text), keyword)",
    "evidence_snippets": f"WITH p AS (SELECT doc_id, text, instr(lower(text), 'the') - 1 AS a FROM documents) SELECT doc_id, substring(text, greatest(a - 350, 0) + 1, a + 700 - greatest(a - 350, 0)) AS snippet, substring(replace(text, {NL}, ' '), 1, 500) AS preview FROM p WHERE a >= 0",
    "dense_topk": f"WITH {dense(10)} SELECT * FROM dense",
    "vector_index_search": f"WITH {dense(10)} SELECT * FROM dense",
    "hybrid_rrf_topk": f"WITH {HYBRID} SELECT * FROM hybrid",
    "first_relevant_rank": f"WITH {BM25}, {lexical(10)}, {GOLD}, {first('f', 'lexical')} SELECT case_id, first_rank, {', '.join(f'coalesce(first_rank <= {k}, false) AS recall_at_{k}' for k in (1, 3, 5, 10))}, round(coalesce(1.0 / first_rank, 0.0), 6) AS reciprocal_rank FROM f",
    "eval_metrics": f"WITH {BM25}, {lexical(10)}, {GOLD}, {first('f', 'lexical')} {metrics('f')}",
    "dense_vs_hybrid": f"WITH {HYBRID}, {GOLD}, {first('d', 'dense')}, {first('h', 'hybrid')}, dm AS ({metrics('d')}), hm AS ({metrics('h')}) SELECT metric, dm.value AS dense, hm.value AS hybrid, round(100 * (hm.value - dm.value), 4) AS change FROM dm JOIN hm USING (metric)",
    "truncation_audit": f"""WITH {GOLD}, ids AS (SELECT DISTINCT chunk_id FROM gold UNION SELECT doc_id FROM documents WHERE doc_id % 50 = 0)
        SELECT doc_id AS chunk_id, CAST(1 AS INTEGER) AS page_start, CAST(1 AS INTEGER) AS page_end, CAST(length(text) AS INTEGER) AS chars, CAST({words('text')} AS INTEGER) AS tokens,
        concat_ws(',', CASE WHEN contains(lower(text), 'que') THEN 'que:' || (instr(lower(text), 'que') - 1) END, CASE WHEN contains(lower(text), 'the') THEN 'the:' || (instr(lower(text), 'the') - 1) END) AS keywords
        FROM documents JOIN ids ON ids.chunk_id = documents.doc_id""",
    "label_retrieval_eval": f"""WITH {dense(10)}, r AS (SELECT d.*, e.label AS l, q.label AS ql FROM dense d JOIN embeddings e ON e.vec_id = d.chunk_id JOIN embeddings q ON q.vec_id = d.query_id),
        f AS (SELECT query_id AS case_id, min(CASE WHEN l = ql AND chunk_id <> query_id THEN rank END) AS first_rank FROM r GROUP BY query_id) {metrics('f')}""",
    "gold_unknown_ids": "SELECT doc_id % 7 AS case_id, doc_id * 3 AS chunk_id FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents)",
}
