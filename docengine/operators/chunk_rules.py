"""The sequential part of chunking, on one section run whose lines have their kinds and marks.

A run is read as a string with one letter a line, so what tables, titles, rows and paragraphs look like is said by regular
expressions over letters, and a span of letters is a span of lines.  Text is measured in code points; chunks are filled
by running totals.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import accumulate, groupby, pairwise

from docengine.schemas import ChunkConfig

VALUE = re.compile(r"^\(?[-–—]?[₹$]?\d[\d,]*(?:\.\d+)?\)?%?$|^[-–—]$")
SENTENCE_START = re.compile(r"(?<=[.!?])\s+(?=[A-Z(\"“0-9])")

#: Letters of kinds: blank, header, number, row, a text short enough for a caption, other text.
LETTERS = {"blank": "b", "hdr": "h", "num": "n", "row": "r", "text": "t"}
#: A table begins with structure, or a caption before data; a caption inside follows structure, or has data within two lines.
REGION = re.compile(r"(?:[hnr](?:b*c)?|c(?=b*[nr]))(?:[hnr](?:b*c)?|b|c(?=b*(?:[hct]b*)?[nr]))*")
#: Up to two lines of a title (T) above a table, and a blank among them or below.
TITLE = re.compile(r"(?:T(?:Tb?|bT)|Tb?)\Z")
#: Entries of a table: a row, a label (l) with the values (v) after it, or values alone; repeated headers (h) lie between.
ENTRY = re.compile(r"r|l(?:h*v)*|v(?:h*v)*")


@dataclass
class Lines:
    """A section run as columns; the marks come from Column expressions."""

    text: list[str]
    page: list[int]
    subsection: list[str | None]
    kind: list[str]
    short: list[bool]
    unit: list[bool]
    heading: list[bool]
    key: list[str]
    intro: re.Pattern
    outro: re.Pattern


@dataclass(frozen=True)
class Part:
    """Some text and the pages that it is from."""

    text: str
    pages: frozenset[int] = frozenset()

    def __bool__(self) -> bool:
        return bool(self.text)


NOTHING = Part("")


def joined(parts: list[Part], by: str) -> Part:
    if len(parts) == 1:
        return parts[0]
    return Part(by.join([p.text for p in parts]), frozenset().union(*[p.pages for p in parts]))


@dataclass(frozen=True)
class Entry:
    """A line of a rendered table; ``closing`` where a table may be cut after it, ``opening`` before it."""

    part: Part
    opening: bool = False
    closing: bool = False


@dataclass(frozen=True)
class Unit:
    kind: str  # para, heading or table
    part: Part  # a table's head
    subsection: str | None
    line: int = 0
    entries: tuple[Entry, ...] = ()
    before: Part = NOTHING
    after: Part = NOTHING


@dataclass(frozen=True)
class Chunk:
    kind: str
    subsection: str | None
    body: str
    pages: frozenset[int]


def said(x: Lines, at: list[int] | range) -> Part:
    return Part("\n".join(x.text[i] for i in at), frozenset(x.page[i] for i in at))


def tables(x: Lines, config: ChunkConfig) -> list[tuple[int, int, int]]:
    """``(title, start, stop)`` of each table: where its title begins, its first line, and the one after its last data."""
    letters = "".join(["c" if k == "text" and s else LETTERS[k] for k, s in zip(x.kind, x.short)])
    found, at, floor = [], 0, 0
    while m := REGION.search(letters, at):
        at = m.end()
        body = m[0].rstrip("bhct")
        data, full = body.count("n") + body.count("r"), len(body) - body.count("b")
        if data >= max(1, config.min_table_data_lines) and data >= 0.35 * full:
            start, at = m.start(), m.start() + len(body)
            low = max(floor, start - 3)  # no title is longer
            above = TITLE.search("".join(map(title_letter, x.text[low:start], x.kind[low:start])))
            found.append((low + above.start() if above else start, start, at))
            floor = at
    return found


def title_letter(line: str, kind: str) -> str:
    t = line.strip()
    fits = kind == "text" and len(t) <= 100 and (t[:1].isupper() or t[:1].isdigit()) and t[-1] not in ".:;,"
    return "T" if t and fits else "x" if t else "b"


def values_at_end(words: list[str]) -> int:
    return next((k for k, w in enumerate(reversed(words)) if not VALUE.match(w)), len(words))


def row_of(words: list[str], n: int) -> tuple[list[str], list[str]]:
    """The label of a row, if it has one, and its ``n`` values."""
    return [" ".join(words[:-n])] if words[:-n] else [], words[-n:]


def entry(label: list[str], values: list[str], pages: frozenset[int]) -> Entry:
    total = bool(label) and label[0].lower().startswith("total")
    return Entry(Part(" | ".join(label + values), pages), opening=bool(label) and not values, closing=total)


@lru_cache(1 << 12)
def short_row(line: str, page: int) -> Entry:
    """The entry of a line of the kind row; tables say many lines again."""
    words = line.split()
    return entry(*row_of(words, values_at_end(words)), frozenset([page]))


#: Characters of a row that is remembered, at most.
SHORT = 120


def table(x: Lines, title: int, start: int, stop: int, config: ChunkConfig) -> Unit:
    """The head of a table and its entries."""
    body = [i for i in range(start, stop) if x.kind[i] != "blank"]
    many = next((k for k, i in enumerate(body) if x.kind[i] != "hdr"), len(body))
    heads, body = body[:many], body[many:]
    above = [i for i in range(title, start) if x.text[i].strip()]
    caption = " ".join(x.text[i] for i in [*above, *(i for i in heads if x.unit[i])]).strip()
    columns = " | ".join(x.text[i] for i in heads if not x.unit[i])
    head = "\n".join(f"{name}: {t}" for name, t in (("Table title", caption), ("Columns", columns)) if t)

    texts = "".join(["t" if x.kind[i] == "text" else " " for i in body]).split()
    if max(map(len, texts), default=0) >= config.column_major_label_run:  # labels stand apart from their values: lines stay
        entries = [Entry(Part(x.text[i].strip(), frozenset([x.page[i]]))) for i in body]
    else:
        entries = entries_of(x, body, {x.key[i] for i in heads})
    return Unit("table", Part(head, frozenset(x.page[i] for i in [*above, *heads])), x.subsection[title], title, tuple(entries))


def entries_of(x: Lines, body: list[int], known: set[str]) -> list[Entry]:
    """A header that says again what one of the ``known`` says is no entry; its pages are those of the entry after it, or
    else of the last."""
    if all([x.kind[i] == "row" and len(x.text[i]) <= SHORT for i in body]):
        return [short_row(x.text[i], x.page[i]) for i in body]
    words = [x.text[i].split() for i in body]
    tail = list(map(values_at_end, words))

    def letter(i: int, w: list[str], n: int) -> str:
        if x.kind[i] == "row":
            return "r"
        if x.kind[i] == "hdr" and x.key[i] in known:
            return "h"
        return "v" if x.kind[i] == "num" or x.kind[i] == "hdr" and n == len(w) else "l"

    letters = "".join(map(letter, body, words, tail))
    spans = [m.span() for m in ENTRY.finditer(letters)]
    again = [k for k, c in enumerate(letters) if c == "h"]
    out, free = [], 0
    for number, (a, b) in enumerate(spans):
        own = [k for k in range(a, b) if letters[k] != "h"]
        last = number + 1 == len(spans)
        repeated = [k for k in again if free <= k < a or last and k > a]
        label, values = [x.text[body[a]].strip()] if letters[a] == "l" else [], [w for k in own if letters[k] == "v" for w in words[k]]
        if letters[a] == "r":
            label, values = row_of(words[a], tail[a])
        out.append(entry(label, values, frozenset(x.page[body[k]] for k in own + repeated)))
        free = a
    return out


def paragraphs(x: Lines, start: int, stop: int) -> list[Unit]:
    """Headings, and the runs of lines between blank lines, headings and changes of the subsection."""
    full = [i for i in range(start, stop) if x.text[i].strip()]
    if not full:
        return []
    breaks = [1] + [int(j > i + 1 or x.heading[i] or x.heading[j] or x.subsection[i] != x.subsection[j]) for i, j in pairwise(full)]
    runs = groupby(zip(accumulate(breaks), full), key=lambda r: r[0])
    own = [[i for _, i in run] for _, run in runs]
    return [Unit("heading" if x.heading[at[0]] else "para", said(x, at), x.subsection[at[0]], at[0]) for at in own]


def units(x: Lines, config: ChunkConfig) -> list[Unit]:
    """All units in order; a table takes along the paragraph that introduces it and the one that comments on it."""
    edges = tables(x, config)
    gaps = zip([0, *(stop for *_, stop in edges)], [*(title for title, *_ in edges), len(x.text)])
    texts = [paragraphs(x, a, b) for a, b in gaps]
    out = list(texts[0])
    for (title, start, stop), after in zip(edges, texts[1:]):
        found, after = table(x, title, start, stop, config), list(after)
        fits = lambda u: u.kind == "para" and len(u.part.text.strip()) <= config.max_context_chars
        if out and fits(out[-1]) and (out[-1].part.text.strip().endswith(":") or x.intro.search(out[-1].part.text.strip())):
            found = replace(found, before=out.pop().part)
        if after and fits(after[0]) and x.outro.search(after[0].part.text.strip()):
            found = replace(found, after=after.pop(0).part)
        out += [found, *after]
    return out


def sentences(x: Lines, u: Unit, budget: int) -> list[Part]:
    """The paragraph, or as many whole sentences at a time as the budget holds; a longer sentence is cut at blanks."""
    text = u.part.text
    if len(text) <= budget:
        return [u.part]
    starts = list(accumulate((len(t) + 1 for t in text.split("\n")), initial=0))
    piece = re.compile(rf".{{1,{budget}}}\Z|.{{1,{max(1, budget - 1)}}}(?= )|.{{1,{budget}}}", re.S)
    ends = [0, *(m.end() for m in SENTENCE_START.finditer(text)), len(text)]
    cuts = [0, *(a + m.end() for a, b in pairwise(ends) for m in piece.finditer(text[a:b]))]
    spans, a = [], 0
    while a + 1 < len(cuts):
        b = max(a + 1, bisect_right(cuts, cuts[a] + budget) - 1)
        spans.append((cuts[a], cuts[b]))
        a = b

    def pages(a: int, b: int) -> frozenset[int]:
        first = u.line + bisect_right(starts, a) - 1
        lines = [i for i in range(first, u.line + bisect_right(starts, b - 1)) if starts[i - u.line] < b and starts[i - u.line + 1] - 1 > a]
        return frozenset(x.page[i] for i in lines) or frozenset([x.page[u.line]])

    return [Part(text[a:b].strip(), pages(a, b)) for a, b in spans if text[a:b].strip()]


def table_chunks(u: Unit, lead: Part, config: ChunkConfig) -> list[Chunk]:
    """The table in one chunk if it is near enough the limit, else groups of entries under the same head."""
    n, rows = len(u.entries), [e.part for e in u.entries]

    def chunk(a: int, b: int) -> Chunk:
        body = joined([p for p in (Part(u.part.text),) if p] + rows[a:b], "\n")
        around = [p for p in (lead, u.before) if p and not a], [p for p in (u.after,) if p and b == n]
        whole = joined([*around[0], body, *around[1]], "\n\n")
        first = (u.part.pages | lead.pages | u.before.pages) if not a else frozenset()
        return Chunk("table", u.subsection, whole.text, whole.pages | first)

    all_of_it = chunk(0, n)
    if len(all_of_it.body) <= config.max_chars * config.table_slack:
        return [all_of_it]
    room = max(config.max_chars - len(u.part.text) - 1, config.max_chars // 3)
    first = max(room - len(lead.text) - len(u.before.text) - 4, room // 2)
    upto = list(accumulate((len(r.text) + 1 for r in rows), initial=0))
    good = [k for k in range(1, n) if u.entries[k].opening or u.entries[k - 1].closing]
    edges = [0]
    while (full := max(edges[-1] + 1, bisect_right(upto, upto[edges[-1]] + (room if edges[-1] else first)) - 1)) < n:
        best = good[: bisect_right(good, full - 1)][-1:]
        edges.append(best[0] if best and best[0] > edges[-1] else full)
    return [chunk(a, b) for a, b in pairwise([*edges, n])]


def chunks(x: Lines, section: str | None, config: ChunkConfig) -> list[Chunk]:
    """All chunks of a section run.  Headings travel with what follows; those with nothing after them are dropped."""
    # pieces of text, each with the room that a chunk of it has and what it must not share a chunk with
    out: list[Chunk | tuple[Part, str | None, int, str]] = []
    waiting: list[Part] = []
    for u in units(x, config):
        if u.kind == "heading":
            waiting.append(u.part)
            continue
        lead, waiting = joined(waiting, "\n") if waiting else NOTHING, []
        if u.kind == "table":
            out += table_chunks(u, lead, config)
            continue
        above = "\n".join(h for h in (section, u.subsection) if h)
        room = max(config.max_chars - len(above) - 1, config.max_chars // 2)
        first, *rest = sentences(x, u, room)
        out.append((joined([lead, first], "\n") if lead else first, u.subsection, room, "heading" if lead else ""))
        out += [(p, u.subsection, room, "") for p in rest]

    filled: list[Chunk] = []
    size = 0  # of the text chunk that is being filled, with two for the gap after each piece
    for item in out:
        if isinstance(item, Chunk):
            filled.append(item)
            size = 0
            continue
        part, subsection, room, mark = item
        last = filled[-1] if size else None
        if last and last.subsection == subsection and not (mark and size >= max(1, config.min_chars)) and size + len(part.text) + 2 <= room:
            filled[-1] = replace(last, body=f"{last.body}\n\n{part.text}", pages=last.pages | part.pages)
        else:
            filled.append(Chunk("text", subsection, part.text, part.pages))
            size = 0
        size += len(part.text) + 2

    merged: list[Chunk] = []
    for c in filled:
        last = merged[-1] if merged else None
        small = c.kind == "text" and len(c.body) < config.min_chars
        if small and last and last.kind == "text" and last.subsection == c.subsection and len(last.body) + len(c.body) + 2 <= 1.25 * config.max_chars:
            merged[-1] = replace(last, body=f"{last.body}\n\n{c.body}", pages=last.pages | c.pages)
        else:
            merged.append(c)
    return merged
