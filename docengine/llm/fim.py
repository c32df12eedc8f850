"""Fill-in-middle: documents cut in three at random places, and their parts put in an order a left-to-right model learns from.

Places are counted in units: lines, words or characters.  While a text's units are counted, a sparse index records the byte
and code-point offset after every few of them; a cut is found by binary search among these checkpoints and a short rescan
of at most that many units.  Nothing but the index is held beside the text, and texts are not decoded.

What happens to a document depends on the seed and its id alone, so a task that runs again does the same.

Defined cases: a null text counts as empty; an empty text, and one that contains a mark, stays plain; a null id is hashed
as nothing; rows that share an id are cut by the same numbers, each in its own text; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import slices, texts_as_bytes

#: One unit of each kind in UTF-8.  A word takes the white space before it along; white space at the end is one more.
UNITS = {"line": rb"(?:[^\n]+\n?|\n)", "word": rb"(?:[\t-\r ]*+[^\t-\r ]+|[\t-\r ]+)", "character": rb"(?:[^\x80-\xbf][\x80-\xbf]*+)"}
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units between checkpoints.
EVERY = 32
#: The bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def points(text: bytes) -> int:
    return len(text.translate(None, INNER))


class Index:
    """Checkpoints of a text: how many units lie before each, and its offset in bytes and in code points."""

    def __init__(self, text: bytes, unit: str = "line", every: int = EVERY):
        self.text, self.one = text, re.compile(UNITS[unit])
        self.units, self.bytes, self.points = [0], [0], [0]
        several = re.compile(b"%b{%d}+" % (UNITS[unit], every))
        while m := several.match(text, self.bytes[-1]):
            self.points.append(self.points[-1] + points(m[0]))
            self.bytes.append(m.end())
            self.units.append(self.units[-1] + every)
        self.n = self.units[-1] + sum(1 for _ in self.one.finditer(text, self.bytes[-1]))

    def cut(self, unit: int) -> tuple[int, int]:
        """The offset after so many units, in bytes and in code points."""
        k = bisect_right(self.units, unit) - 1
        at = self.bytes[k]
        for _ in range(unit - self.units[k]):
            at = self.one.match(self.text, at).end()
        return at, self.points[k] + points(self.text[self.bytes[k] : at])


def numbers(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the hash that decides about a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transform(docs: DataFrame, *, unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7, marks: tuple[str, str, str] = MARKS, every: int = EVERY) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document (``doc_id``, ``text``).  Of ``percent`` in a
    hundred the prefix ends after the smaller of two random numbers of the ``n`` units and the middle after the larger;
    ``spm_percent`` of these put the suffix first (``spm``), the others the prefix (``psm``).  The rest is ``plain``."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    if every < 1:
        raise ValueError("every must be at least 1")
    p, s, m = (x.encode() for x in marks)

    def one(doc_id: int | None, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        index, h = Index(text, unit, every), numbers(seed, doc_id)
        if not text or p in text or s in text or m in text or h[2] % 100 >= percent:
            return index.n, "plain", None, None, text
        (a, before), (b, upto) = map(index.cut, sorted(x % (index.n + 1) for x in h[:2]))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_percent:
            return index.n, "spm", before, upto - before, b"".join([s, suffix, p, prefix, m, middle])
        return index.n, "psm", before, upto - before, b"".join([p, prefix, s, suffix, m, middle])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in slices(batches):
            rows = map(one, batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:-1], columns[-1].cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of.  No part contains a mark, so the marks found are the ones put there."""
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """The transform's rows with hashes in place of the output and of the text rebuilt from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = ", ".join(f"CAST('0x' || substring(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))

SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls, {_H} FROM d),
k AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b FROM c),
p AS (SELECT *, array_to_string(ls[1:a], '') AS prefix, array_to_string(ls[a + 1:b], '') AS middle, array_to_string(ls[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
