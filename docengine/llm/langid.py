"""Language identification by cross-parsing entropy.

Of each language a suffix automaton recognises all that occurs in a sample of its labelled text.  A document is parsed
against it greedily into the longest phrases that the sample has; a text in the sample's language needs few.  With the
logarithm of the sample's length the number of phrases is an estimate of bits a byte, so samples of different lengths
compare, and the language that needs fewest wins.

Texts are lower-cased, all ASCII but letters become single blanks, and the automaton reads UTF-8 bytes, so alphabets stay
small in any script.  A parse never follows a suffix link: it ends a phrase and begins one at the byte that failed.  That
makes it a table of states and bytes, which many stretches of text walk together in numpy.  Stretches of ``STRETCH`` bytes
are parsed on their own, for which a document pays a phrase each, in every language alike; no text is left out.

The sample: lines of labelled texts of the lowest hashes, each counting once, until they have ``sample`` bytes or the
tables of all languages together would exceed ``TABLES``, whichever is less.  Passages in another language than the label
says (licenses, quotations) would match themselves in full, so drawn lines are judged first, each half by automata of the
other; those that are not of their label's language are left out, unless that leaves nothing of it.  A line is in the same
half under all labels.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; with one language alone the score is 1; a
null id is carried along and learned from; equal rows are judged alike; nothing labelled, as in an empty table, leaves
every text ``und``; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.store import Store
from docengine.llm.words import slices

#: Characters of a line that are drawn together for the sample, and bytes that are parsed at a time.
DRAWN, STRETCH = 1000, 4096
SAMPLE = 48 << 10
#: Bytes of the tables of all languages.
TABLES = 64 << 20
#: How many times the sample's length is drawn before it is cut to it.
MARGIN = 3
UNKNOWN = "und"
ROWS = 4096

_BLANKS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile("[A-Za-z]")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass
class Language:
    """The transitions of a suffix automaton: ``state, class, next`` rows, 0 the first state; ``alphabet[class]`` is a byte."""

    name: str
    size: int
    alphabet: bytes
    states: int
    edges: np.ndarray

    def classes(self) -> np.ndarray:
        """Byte to class; the last one is for bytes that the sample lacks."""
        out = np.full(256, len(self.alphabet), np.int32)
        out[np.frombuffer(self.alphabet, np.uint8)] = np.arange(len(self.alphabet))
        return out

    def table(self) -> np.ndarray:
        """For each state and class the next state times four plus the phrases that end.  Where the automaton fails, a phrase
        ends and the byte begins one; a byte that the sample lacks is a phrase of its own."""
        width = len(self.alphabet) + 1
        start = np.zeros(width, np.int64)
        first = self.edges[self.edges[:, 0] == 0]
        start[first[:, 1]] = first[:, 2]
        out = np.tile((4 * start + 1).astype(np.int32), (self.states, 1))
        out[:, -1] = 2
        out[0, -1] = 1
        out[self.edges[:, 0], self.edges[:, 1]] = 4 * self.edges[:, 2]
        return out.ravel()

    def bits(self, phrases: np.ndarray, size: np.ndarray) -> np.ndarray:
        return phrases * np.log2(self.size + 1) / np.maximum(size, 1)


def automaton(name: str, text: bytes) -> Language:
    """The suffix automaton of a text, built byte by byte."""
    alphabet = bytes(sorted(set(text)))
    code = {b: k for k, b in enumerate(alphabet)}
    moves, link, longest, last = [{}], [-1], [0], 0
    for c in map(code.__getitem__, text):
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(moves[q].copy())
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    edges = np.array([(s, c, t) for s, m in enumerate(moves) for c, t in m.items()], np.int32).reshape(-1, 3)
    return Language(name, len(text), alphabet, len(moves), edges)


def _built(lines: DataFrame, sample: int, room: int, *keys: str) -> dict[tuple, list[Language]]:
    """Automata of ``lang, line, h`` rows, in tasks, one for each language and value of the keys, by these values."""

    def build(group: pa.Table) -> pa.Table:
        text = b" ".join(map(plain, group.sort_by([("h", "ascending"), ("line", "ascending")])["line"].to_pylist()))[:sample]
        # an automaton has at most two states a byte, each with a cell of four bytes for each byte value
        made = automaton(group["lang"][0].as_py(), text[: max(1, room // (8 * (len(set(text)) + 1)))])
        at = [group[k][:1] for k in keys]
        return pa.table([*at, *map(pa.array, ([made.name], [made.size], [made.alphabet], [made.states], [made.edges.tobytes()]))], names=[*keys, "lang", "size", "alphabet", "states", "edges"])

    kinds = "".join(f"{k} int, " for k in keys)
    out: dict[tuple, list[Language]] = {}
    for r in lines.groupBy(*keys, "lang").applyInArrow(build, kinds + "lang string, size long, alphabet binary, states long, edges binary").collect():
        if r["size"]:
            made = Language(r["lang"], r["size"], bytes(r["alphabet"]), r["states"], np.frombuffer(bytes(r["edges"]), np.int32).reshape(-1, 3))
            out.setdefault(tuple(r[k] for k in keys), []).append(made)
    return {k: sorted(v, key=lambda x: x.name) for k, v in out.items()}


def fit(labelled: DataFrame, *, sample: int = SAMPLE, tables: int = TABLES) -> list[Language]:
    """The automata of all values of ``lang``, in their order, from ``text`` and ``lang`` of labelled rows.  Each is built in
    a task; a row for each language comes to the driver."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("n")).collect()}
    if not totals:
        return []
    share = F.create_map(*[F.lit(v) for name, n in totals.items() for v in (name, MARGIN * sample / max(n, 1))])
    pieces = F.regexp_extract_all("text", F.lit(rf"[^\n]{{1,{DRAWN}}}"), F.lit(0))
    chosen = F.filter(pieces, lambda x: F.shiftrightunsigned(F.xxhash64(x), 11) / float(1 << 53) < F.col("share"))
    drawn = rows.withColumn("share", F.element_at(share, F.col("lang"))).select("lang", F.explode(chosen).alias("line"))
    lines = drawn.where("trim(line) <> ''").distinct().withColumn("h", F.xxhash64("line"))
    store, room = Store(labelled.sparkSession, "langid"), tables // len(totals)
    lines = store.put(lines.withColumn("half", F.pmod(F.xxhash64("h"), F.lit(2)).cast("int")), "lines")
    halves = _built(lines, sample, room, "half")
    other = {k: halves.get((1 - k,), []) for k in (0, 1)}
    judged = store.put(lines.mapInArrow(_judging(other), "lang string, line string, h long, own boolean"), "judged")
    left = {r["lang"] for r in judged.where("own").select("lang").distinct().collect()}
    found = _built(judged.where(F.col("own") | ~F.col("lang").isin(*left)), sample, room).get((), [])
    store.drop("lines", "judged")
    return found


def _judging(automata: dict[int, list[Language]]):
    """Marks lines (``lang, line, h, half``) that the automata of the other half take for their label's language, or whose
    language these don't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: [x.table() for x in v] for k, v in automata.items()}
        for batch in slices(batches, ROWS):
            own = []
            for half in (0, 1):
                part = batch.filter(pc.equal(batch.column(3), half))
                names, known = part.column(0).to_pylist(), {x.name for x in automata[half]}
                best = judge([plain(t) for t in part.column(1).to_pylist()], automata[half], tables[half])[0]
                own.append(pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([n not in known or n == b for n, b in zip(names, best)], pa.bool_())], names=["lang", "line", "h", "own"]))
            yield from own

    return run


def phrases(texts: list[bytes], languages: list[Language], tables: list[np.ndarray]) -> np.ndarray:
    """For each text and language the number of phrases; all stretches take each step together, the longest first."""
    size = np.array([len(t) for t in texts], np.int64)
    many = -(-size // STRETCH)
    owner = np.repeat(np.arange(len(texts)), many)
    pieces = [t[at : at + STRETCH] for t in texts for at in range(0, len(t), STRETCH)]
    length = np.array([len(p) for p in pieces], np.int64)
    order = np.argsort(-length, kind="stable")
    out = np.zeros((len(texts), len(languages)), np.int64)
    if not len(pieces):
        return out
    steps = int(length.max())
    block = np.zeros((len(pieces), steps), np.uint8)
    for row, k in enumerate(order):
        block[row, : length[k]] = np.frombuffer(pieces[k], np.uint8)
    block = np.ascontiguousarray(block.T)
    active = len(pieces) - np.searchsorted(np.sort(length), np.arange(steps), "right")
    for at, (language, table) in enumerate(zip(languages, tables)):
        classes, width = language.classes(), len(language.alphabet) + 1
        state, ended = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for t in range(steps):
            n = active[t]
            move = table.take(state[:n] * width + classes.take(block[t, :n]))
            ended[:n] += move & 3
            state[:n] = move >> 2
        out[:, at] = np.bincount(owner[order], ended + (state > 0), len(texts))
    return out


def judge(data: list[bytes], languages: list[Language], tables: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For each plain text its language, the score, and the bits a byte that it needs there."""
    size = np.array([len(d) for d in data], np.int64)
    if not languages:
        return [UNKNOWN] * len(data), np.zeros(len(data)), np.full(len(data), np.nan)
    bits = np.stack([x.bits(n, size) for x, n in zip(languages, phrases(data, languages, tables).T)], 1)
    best, ranked = bits.argmin(1), np.sort(bits, 1)
    gain = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if len(languages) > 1 else np.ones(len(data))
    return [languages[k].name if n else UNKNOWN for k, n in zip(best, size)], np.where(size > 0, gain, 0.0), np.where(size > 0, ranked[:, 0], np.nan)


def predict(docs: DataFrame, languages: list[Language]) -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` of every document (``doc_id``, ``text``).  The score is the share by which
    the best language's bits are fewer than the second's; of equal ones the first by name wins."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # the transitions: at most three a byte of the samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = [x.table() for x in own]
        for batch in slices(batches, ROWS):
            data = [plain(t) if t is not None and has_letter(t) else b"" for t in batch.column(1).to_pylist()]
            name, score, least = judge(data, own, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(np.round(score, 6)), pa.array(np.round(least, 6), mask=np.isnan(least))], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
