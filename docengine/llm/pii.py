"""Personal data: generators propose spans, boosted trees select among them.

Four base kinds (email, ip, card, phone) are found by pattern and check, and always stand.  On top of them, generators
of high recall propose further spans, which may overlap; gradient-boosted trees see each one's format and context, and
a threshold calibrated on held-out rows selects those to redact.  Of overlapping selected spans the likeliest stands,
and none overlaps a base span.

The trees are trained when the operator is called, on spans written by seeded templates: no table labels spans, and
so the model is the same at every size of input.

Defined cases: a null or empty text has no spans; a null id is carried along; equal rows give equal results; an empty
table gives no rows; further columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import random
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.boosting import Booster
from docengine.llm.words import mapped, slices

#: Fixed order of kinds at one start: the base kinds, then those of the generators.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "address", "iban", "street", "birth", "name")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = "0123456789"
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, place in KINDS, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time that grows with the text: around each @, the run before it and the names after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        width = 64
        while True:
            before = text[max(free, at - width) : at]
            start = at - len(before) + len(before.rstrip(LOCAL))
            if start > at - len(before) or at - width <= free:
                break
            width *= 8
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += ((a, 0, b) for a, b in emails(text))
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


#: Runs of the characters of keys; those with a digit are proposed where a quote, a bracket, a mark or a blank is before.
RUN = re.compile(r"[A-Za-z0-9_+/=.-]{16,}+")
BEFORE = " \t\n\x0b\f\r\"'=:,;(<>"
#: Generators: kind, pattern (its group 1 is the span), and texts of which one must be present.
GENERATORS = (
    (4, re.compile(r"[=:][ \t]{0,4}[\"']?([^\s\"'<>]{6,}+)"), "=:"),
    (4, re.compile(r"\b(?:password|passphrase|passwd|pwd|token|secret|api[_ -]?key)[ \t]{1,4}is[ \t]{1,4}[\"']?([^\s\"'<>]{6,}+)", re.I), ("password", "passphrase", "passwd", "pwd", "token", "secret", "key")),
    (5, re.compile(r"(?<![0-9A-Za-z])(\(?[0-9](?:[ ().-]{0,2}[0-9]){6,24})(?![0-9A-Za-z])"), DIGITS),
    (6, re.compile(r"(?<![0-9A-Fa-f:])((?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"), ":"),
    (7, re.compile(r"(?<![0-9A-Za-z])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"), DIGITS),
    (8, re.compile(r"(?<![0-9A-Za-z])([0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Place|Square))(?![A-Za-z])"), DIGITS),
    (9, re.compile(r"(?:\bborn|\bbirth|\bdob\b|d\.o\.b)[^0-9\n]{0,12}([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})(?![0-9])", re.I), DIGITS),
    (10, re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.? |\b[Mm]y name is |\b[Nn]ame: )([A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){0,2})(?![A-Za-z])"), ("Mr", "Ms", "Dr", "Prof", "ame")),
)

#: Words of context, a fixed value each.
SECRET_WORDS = re.compile(r"token|secret|passw|pwd|api[_ -]?key|\bkey\b|auth|bearer|credential", re.I)
CONTACT_WORDS = re.compile(r"phone|tel|call|mobile|fax|contact|ssn|social|passport|account|iban|card", re.I)
COUNT_WORDS = re.compile(r"order|item|page|isbn|version|price|total|year|no\.|id\b|ref|\$|€|£", re.I)


def candidates(text: str) -> list[Span]:
    found = {}
    for kind, pattern, needs in GENERATORS:
        if any(c in text for c in needs):
            for m in pattern.finditer(text):
                found[m.start(1), kind, m.end(1)] = None
    for m in RUN.finditer(text) if DIGIT.search(text) else ():
        if (not m.start() or text[m.start() - 1] in BEFORE) and DIGIT.search(text, *m.span()):
            found[m.start(), 4, m.end()] = None
    return list(found)


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    n = len(s)
    digits, letters = sum(map(str.isdigit, s)), sum(map(str.isalpha, s))
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c for c in s]
    counts = Counter(s)
    entropy = -sum(v / n * log2(v / n) for v in counts.values())
    return [
        n, digits, digits / n, letters / n, sum(map(str.isupper, s)) / n, (n - digits - letters) / n,
        sum(a != b for a, b in zip(classes, classes[1:])) / n, entropy, len(counts) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)), len(re.findall(r"[^0-9]+", s)),
        float(bool(SECRET_WORDS.search(left))), float(bool(CONTACT_WORDS.search(left))), float(bool(COUNT_WORDS.search(left[-12:]))),
        float(left.rstrip(" \"'")[-1:] in ("=", ":") if left.rstrip(" \"'") else 0), float(right[:1] in ('"', "'")),
        float(kind), float(digits == n), float(s.count(".") / n), float(luhn(d) if 8 <= len(d := re.sub("[^0-9]", "", s)) <= 24 else 0),
    ]


def examples(seed: int = 7, each: int = 350) -> tuple[np.ndarray, np.ndarray]:
    """Spans of known nature in made-up sentences: what generators propose overlapping a planted value is a positive
    if the value is private."""
    r = random.Random(seed)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexa, dec, low = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = low + low.upper() + dec
    word = lambda: some(low, r.randint(2, 9))
    name = lambda: r.choice(["token", "secret", "api_key", "password", "auth", "key", "pwd"])
    contact = lambda: r.choice(["phone", "tel", "call", "mobile", "contact", "fax"])
    quoted = lambda v: r.choice(['"%s"', "'%s'", "%s"]) % v
    title = lambda k: "".join(word().title() for _ in range(k))
    private = [
        lambda: (f"{name()} {r.choice('=:')} ", quoted(some(hexa, r.choice([24, 32, 40, 64])))),
        lambda: (f"{name()}{r.choice('=:')}", quoted(some(mixed, r.randint(12, 44)))),
        lambda: (f"{name()}: ", some(mixed + "!?#%", r.randint(8, 16)) + some(dec, 2)),
        lambda: ("", some(hexa, r.choice([32, 40, 64]))),
        lambda: ("", r.choice(["sk-", "ghp_", "AKIA", "xox-"]) + some(mixed, r.randint(16, 36)) + some(dec, 2)),
        lambda: (f"{contact()} ", f"({some(dec, 3)}) {some(dec, 3)}-{some(dec, 4)}"),
        lambda: (f"{contact()}: ", f"{some(dec, 3)}{(s := r.choice('-. '))}{some(dec, 3)}{s}{some(dec, 4)}"),
        lambda: (r.choice(["ssn ", "social security ", ""]), f"{some(dec, 3)}-{some(dec, 2)}-{some(dec, 4)}"),
        lambda: (r.choice(["iban ", "account ", ""]), some(low.upper(), 2) + some(dec, 2) + " " + " ".join(some(dec, 4) for _ in range(r.randint(3, 6)))),
        lambda: ("", ":".join(some(hexa, 4) for _ in range(r.choice([6, 8])))),
        lambda: (f"{name()}{r.choice(['=', ': '])}", quoted(title(r.randint(2, 4)) + r.choice(["", "!", "?", "#"]))),
        lambda: (f"{name()}{r.choice(['=', ': '])}", quoted(some(low + low.upper() + "!?#%", r.randint(12, 44)))),
        lambda: (f"{name()}{r.choice(['=', ': '])}", quoted(some(r.choice([mixed + "+/", hexa]), r.randint(129, 900)))),
        lambda: ("", some(r.choice([mixed, hexa]), r.randint(129, 900)) + some(dec, 2)),
        lambda: (f"{name()}{r.choice(['=', ': ', ' = '])}", quoted(some(low, r.randint(12, 30)))),
        lambda: (f"{name()} is ", quoted(some(low, r.randint(5, 9)) + some(dec, r.randint(1, 4)) + r.choice(["", "!"]))),
        lambda: (r.choice(["lives at ", "address: ", ""]), f"{some(dec, r.randint(1, 4)).lstrip('0') or 7} {' '.join(word().title() + 'er' for _ in range(r.randint(1, 2)))} {r.choice(['Street', 'Road', 'Avenue', 'Lane'])}"),
        lambda: (r.choice(["born ", "born on ", "date of birth: ", "DOB: "]), r.choice([f"{r.randint(1930, 2015)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1930, 2015)}"])),
        lambda: (r.choice(["my name is ", "Name: ", "Mr ", "Mrs. ", "Dr. "]), " ".join(word().title() + "n" for _ in range(2))),
    ]
    harmless = [
        lambda: (r.choice(["order ", "item ", "ref ", "no. "]), some(dec, r.randint(7, 13))),
        lambda: (r.choice(["isbn ", "page ", "id "]), f"{some(dec, 3)}-{some(dec, 1)}-{some(dec, 4)}-{some(dec, 4)}-{some(dec, 1)}"),
        lambda: ("", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
        lambda: ("", f"{r.randint(1900, 2030)} {r.randint(1900, 2030)} {r.randint(1900, 2030)}"),
        lambda: ("version ", f"{some(dec, 2)}.{some(dec, 3)}.{some(dec, 4)}"),
        lambda: (r.choice(["$", "total ", "price "]), f"{some(dec, 4)}.{some(dec, 4)}"),
        lambda: (f"{word()}: ", word() + word()),
        lambda: (f"{word()} = ", some(dec, r.randint(6, 9))),
        lambda: ("", f"{word()}-{word()}-{word()}-{some(dec, r.randint(1, 3))}"),
        lambda: ("", "/".join(word() for _ in range(4)) + some(dec, 1)),
        lambda: ("", r.choice(dec) * r.randint(8, 24)),
        lambda: (f"{word()}:", f"//{word()}.example/{word()}/{some(dec, 4)}"),
        lambda: ("", " ".join(some(dec, r.randint(1, 3)) for _ in range(r.randint(4, 9)))),
        lambda: ("", word() + "." + word() + "." + word() + some(dec, 2)),
        lambda: (f"{word()}: ", quoted(title(r.randint(2, 4)) + r.choice(["", "!", "?"]))),
        lambda: (f"{name()}: ", some(low, r.randint(6, 9)) + r.choice(["", ".", ","])),
        lambda: (f"{word()}:", "//" + word() + ".example/" + "/".join(word() for _ in range(r.randint(1, 40)))),
        lambda: (r.choice(["", f"{word()}: "]), r.choice("/-._").join(word() for _ in range(r.randint(24, 120))) + some(dec, 1)),
        lambda: (f"{word()}: ", r.choice(low + "-=_.") * r.randint(8, 600)),
        lambda: (f"{name()} is ", some(low, r.randint(6, 12)) + r.choice(["", ".", ","])),
        lambda: (f"{word()}: ", some(low, r.randint(12, 30))),
    ]
    rows, labels = [], []
    for _ in range(each):
        for label, makers in ((1, private), (0, harmless)):
            for make in makers:
                before, value = make()
                head = " ".join(word() for _ in range(r.randint(0, 5))) + " "
                text = f"{head}{before}{value} " + " ".join(word() for _ in range(r.randint(1, 4)))
                a = len(head) + len(before)
                for span in candidates(text):
                    if span[0] < a + len(value) and span[2] > a:
                        rows.append(features(text, span))
                        labels.append(label)
    return np.array(rows), np.array(labels, float)


@cache
def model(precision: float = 0.97) -> tuple[Booster, float]:
    x, y = examples()
    booster = Booster().fit(x, y)
    return booster, max(0.5, booster.threshold(precision))


def _merged(spans: list[tuple]) -> list[tuple[int, int]]:
    """What sorted spans cover, as spans that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, _, b, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def spans_of(texts: list[str], booster: Booster, threshold: float) -> list[list[tuple[int, int, int, float]]]:
    """For each text its spans (start, place of the kind, end, probability), sorted."""
    found = [[(*s, 1.0) for s in base_spans(t)] for t in texts]
    proposed = [(k, s) for k, t in enumerate(texts) for s in candidates(t)]
    if proposed:
        scores = booster.probability(np.array([features(texts[k], s) for k, s in proposed]))
        likely = sorted((-p, k, s) for p, (k, s) in zip(scores.tolist(), proposed) if p >= threshold)
        taken: dict[int, list] = {}
        for p, k, (a, kind, b) in likely:
            own = taken.setdefault(k, _merged(found[k]))
            at = bisect(own, (a, len(texts[k]) + 1))  # spans that are taken don't overlap each other
            if (not at or own[at - 1][1] <= a) and (at == len(own) or b <= own[at][0]):
                own.insert(at, (a, b))
                found[k].append((a, kind, b, -p))
    return [sorted(x) for x in found]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find(docs: DataFrame, *, precision: float = 0.97) -> DataFrame:
    """For each document (``doc_id``, ``text``) its spans, in code points, the end exclusive."""
    booster, threshold = model(precision)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, p in x] for x in spans_of(texts, booster, threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def redact(docs: DataFrame, *, precision: float = 0.97) -> DataFrame:
    """The same rows and columns, with each span of ``text`` replaced by its kind in angle brackets; ``n_chars``,
    where there is one, is the new length.  A null text stays null."""
    booster, threshold = model(precision)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            where = batch.schema.get_field_index("text")
            texts = batch.column(where).to_pylist()
            new = []
            for text, spans in zip(texts, spans_of([t or "" for t in texts], booster, threshold)):
                parts, free = [], 0
                for a, k, b, _ in spans:
                    if b > free:  # base kinds may overlap each other
                        parts += [text[free:a], f"<{KINDS[k].upper()}>"] if a >= free else []
                        free = b
                new.append("".join(parts) + text[free:] if spans else text)
            batch = batch.set_column(where, batch.schema.field(where), pa.array(new, batch.schema.field(where).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(n, batch.schema.field(n), pa.array([None if t is None else len(t) for t in new], batch.schema.field(n).type))
            yield batch

    return mapped(docs, run)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
