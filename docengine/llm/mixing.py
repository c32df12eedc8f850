"""Mixing documents to target weights of domains that they belong to in part, in DataFrame functions only.

A classifier fitted on a labelled table gives each document a posterior over domains: a Bernoulli model of the hashed
words that set one domain apart from the rest.  Document rates, nonnegative, are then fitted so that the expected
tokens of each domain (tokens times rate times posterior, summed) match the targets, by projected gradient steps on
the least-squares distance.  A step needs the domains' totals alone: one aggregate over a small table.  Its gradient is
a term for each domain times the document's posterior, so the rates after any number of steps are an expression of
the posteriors and of the steps' terms.  While steps are looked for, the rates that the last ones led to stand in a table
of numbers, so that a step costs the same whether it is the first or the ninetieth.

Documents are weighed by their tokens in the metric of the steps.  First steps weigh residuals besides by the inverse of
the second moments of the posteriors of documents whose rate isn't zero, which ends soon where the targets can be met; one
that leads away from them is halved, and left out if that doesn't help.  Where the targets aren't met by then, steps
along the plain gradient follow, whose fixed point is that of least squares on the totals; their lengths come from the
last two gradients (the two spectral lengths in turn), and the best point on the way stands.

Defined cases: a null or empty text has no tokens and the prior as its posterior; a null id is carried along and never
labelled; labels without a domain, and of unknown documents, are ignored; without any label all domains are equally
likely; repeated rows count as often; targets that can't be met are approached in the least-squares sense; an empty table
gives no rows; further columns are ignored by ``rates`` and kept by ``mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.rules import words
from docengine.llm.store import Store


def _literal_array(values: list[float]) -> Column:
    """An array as one constant that the optimizer folds, however long."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


@dataclass
class Domains:
    """Names of the domains, for each the log odds of every word bucket against the first, and the line from the sum
    of a document's odds to its logit."""

    names: list[str]
    odds: list[list[float]]
    width: int
    shift: list[float]
    scale: list[float]

    def posteriors(self, docs: DataFrame, *keep: Column | str, keep_scores: bool = False) -> DataFrame:
        """``keep``, ``n_tokens`` and the posteriors ``p_0``, ``p_1``, ... of each row, or ``keep`` and its sums of odds."""
        split = docs.select(*keep, words(F.lower(F.coalesce("text", F.lit("")))).alias("_words"))
        kept = [c for c in split.columns if c != "_words"]
        bucket = F.transform(F.array_distinct("_words"), lambda w: F.pmod(F.xxhash64(w), F.lit(self.width)).cast("int"))
        cut = split.select(*kept, F.size("_words").cast("long").alias("n_tokens"), bucket.alias("_buckets"))
        rest = range(1, len(self.names))
        tables = [_literal_array(self.odds[k]) for k in rest]
        start = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in rest], F.lit(0.0).alias("s0"))
        total = F.aggregate("_buckets", start, lambda a, b: F.struct(*[(a[f"s{k}"] + F.get(t, b)).alias(f"s{k}") for k, t in zip(rest, tables)], F.lit(0.0).alias("s0")))
        if keep_scores:
            return cut.select(*kept, total.alias("_t")).select(*kept, *[F.col(f"_t.s{k}") for k in rest])
        logits = F.struct(F.lit(0.0).alias("s0"), *[(self.shift[k] + self.scale[k] * F.col(f"_t.s{k}")).alias(f"s{k}") for k in rest])
        scored = cut.select(*kept, "n_tokens", total.alias("_t")).select(*kept, "n_tokens", logits.alias("_s"))
        most = F.greatest(*[F.col(f"_s.s{k}") for k in (0, *rest)], F.lit(-1e300))
        each = [F.exp(F.col(f"_s.s{k}") - most) for k in range(len(self.names))]
        return scored.select(*kept, "n_tokens", *[(e / reduce(Column.__add__, each)).alias(f"p_{k}") for k, e in enumerate(each)])


def _calibrate(rows: list[tuple], many: int, rounds: int = 300) -> tuple[list[float], list[float]]:
    """Shift and scale of each domain's score that make held-back labels likeliest (``rows``: place, then scores)."""
    shift, scale = [0.0] * many, [0.0] + [0.3] * (many - 1)
    spread = [1.0, *(math.sqrt(sum(r[k] ** 2 for r in rows) / max(1, len(rows))) or 1.0 for k in range(1, many))]
    seen_a, seen_b = [1e-6] * many, [1e-6] * many
    for _ in range(rounds):
        ga, gb = [0.0] * many, [0.0] * many
        for place, *s in rows:
            z = [0.0, *(shift[k] + scale[k] * s[k - 1] for k in range(1, many))]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            for k in range(1, many):
                off = e[k] / sum(e) - (place == k)
                ga[k] += off
                gb[k] += off * s[k - 1] / spread[k]
        for k in range(1, many):
            seen_a[k] += ga[k] ** 2
            seen_b[k] += gb[k] ** 2
            shift[k] -= 0.5 * ga[k] / math.sqrt(seen_a[k])
            scale[k] = max(0.0, scale[k] - 0.5 * gb[k] / math.sqrt(seen_b[k]) / spread[k])
    return shift, scale


def fit_domains(docs: DataFrame, labels: DataFrame, names: list[str], *, sample: int = 4000, width: int = 1 << 14, distinct: float = 4.0, telling: float = 1.0) -> Domains:
    """Learns from the documents that ``labels`` (``doc_id``, ``domain``) names; ``sample`` bounds their expected
    number, drawn by a hash of the id.  Three quarters give the buckets' odds, one quarter calibrates.  Buckets whose
    rates differ by fewer than ``distinct`` standard errors, or by a log of less than ``telling``, say nothing: common
    words of a language come together, and their small odds would add up to much."""
    known = labels.where(F.col("domain").isin(names) & F.col("doc_id").isNotNull()).select("doc_id", "domain").distinct()
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.xxhash64("doc_id") < int(share * 2**64 - 2**63)) if share < 1 else known
    if drawn.count() <= 4 * sample:  # a checked size
        drawn = F.broadcast(drawn)
    store = Store(docs.sparkSession, "domains")
    # one row for each id and domain, however many rows share the id
    drawn_texts = docs.select("doc_id", "text").join(drawn, "doc_id").groupBy("doc_id", "domain")
    texts = store.put(drawn_texts.agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    told = texts.where(~held).select("domain", F.transform(words(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int")).alias("b"))
    counts = told.select("domain", F.explode(F.array_append(F.array_distinct("b"), F.lit(-1))).alias("b")).groupBy("domain", "b").count().collect()
    place = {n: k for k, n in enumerate(names)}
    many, seen = [0.0] * len(names), [[0.0] * width for _ in names]
    for domain, b, n in counts:
        if b < 0:
            many[place[domain]] += n
        else:
            seen[place[domain]][b] += n
    odds = [[0.0] * width for _ in names]
    for k in range(1, len(names)):
        for b in range(width if many[k] and many[0] else 0):
            p, q = (seen[k][b] + 0.5) / (many[k] + 1), (seen[0][b] + 0.5) / (many[0] + 1)
            if abs(math.log(p / q)) >= telling and abs(p - q) > distinct * math.sqrt(p * (1 - p) / many[k] + q * (1 - q) / many[0]):
                odds[k][b] = math.log(p / q)
    raw = Domains(names, odds, width, [0.0] * len(names), [1.0] * len(names))
    if not sum(many):
        return raw
    scored = raw.posteriors(texts.where(held), "domain", keep_scores=True)
    rows = [(place[r[0]], *r[1:]) for r in scored.collect()]
    shift, scale = _calibrate(rows, len(names))
    return Domains(names, odds, width, shift, scale)


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """The solution of a small linear system, by elimination with pivots."""
    n = len(b)
    m = [[*row, y] for row, y in zip(a, b)]
    for k in range(n):
        pivot = max(range(k, n), key=lambda i: abs(m[i][k]))
        m[k], m[pivot] = m[pivot], m[k]
        for i in range(n):
            if i != k and m[k][k]:
                f = m[i][k] / m[k][k]
                m[i] = [x - f * y for x, y in zip(m[i], m[k])]
    return [m[k][n] / m[k][k] if m[k][k] else 0.0 for k in range(n)]


@dataclass
class Rates:
    """Rates as the steps that led to them."""

    steps: list[list[float]] = field(default_factory=list)

    def column(self, start: Column | None = None) -> Column:
        """The rates that the steps lead to, from ``start`` or from one."""
        start = F.lit(1.0) if start is None else start
        if not self.steps:
            return start
        steps = F.array(*[F.array(*map(F.lit, g)) for g in self.steps])  # folded into one constant
        down = lambda g: reduce(Column.__add__, [F.get(g, F.lit(k)) * F.col(f"p_{k}") for k in range(len(self.steps[0]))])
        return F.aggregate(steps, start, lambda r, g: F.greatest(F.lit(0.0), r - down(g)))


def fit_rates(members: DataFrame, targets: list[float], *, rounds: int = 30, plain: int = 60, tolerance: float = 1e-6) -> Rates:
    """``members`` has ``n_tokens`` and ``p_k``; ``targets`` are the domains' shares of all tokens, which stay as many.  At
    most ``rounds`` scaled and ``plain`` plain steps are taken."""
    store = Store(members.sparkSession, "rates")
    try:
        return _fit_rates(store, members, targets, rounds, plain, tolerance)
    finally:
        store.clear()


def _fit_rates(store: Store, members: DataFrame, targets: list[float], rounds: int, plain: int, tolerance: float) -> Rates:
    k = range(len(targets))
    p, n = [F.col(f"p_{i}") for i in k], F.col("n_tokens")
    names = (f"{i}" for i in count())

    def written(rows: DataFrame, rate: Column, last: Column) -> tuple[str, DataFrame]:
        name = next(names)
        return name, store.put(rows.select(n, *p, rate.alias("rate"), last.alias("last")), name)

    def moved(rated: tuple[str, DataFrame], step: list[float]) -> tuple[str, DataFrame]:
        """The rates a step further."""
        return written(rated[1], Rates([step]).column(F.col("rate")), F.col("rate"))

    def state(rated: tuple[str, DataFrame]) -> tuple[float, list[float], list[list[float]], float]:
        """Of these rates: how far the totals are off, in all and by domain, the second moments, and the square of the way
        that the last step has gone."""
        alive, gone = F.when(F.col("rate") > 0, n).otherwise(0), F.col("rate") - F.col("last")
        found = rated[1].agg(*[F.sum(n * F.col("rate") * x) for x in p], *[F.sum(alive * p[i] * p[j]) for i in k for j in k], F.sum(n * gone * gone)).first()
        off = [a - b for a, b in zip(found, goal)]
        return math.sqrt(sum(x * x for x in off)) / total, off, [[found[len(p) * (i + 1) + j] for j in k] for i in k], found[-1]

    rated = written(members, F.lit(1.0), F.lit(1.0))
    total = rated[1].agg(F.sum(n)).first()[0] or 0
    if not total:
        return Rates()
    goal = [w / sum(targets) * total for w in targets]
    steps: list[list[float]] = []
    size, off, gram, _ = state(rated)
    whole = gram  # all rates are above zero here
    for _ in range(rounds):
        if size <= tolerance:
            return Rates(steps)
        step, before = _solve([[gram[i][j] + (1e-9 * total if i == j else 0) for j in k] for i in k], off), size
        for _ in range(4):
            tried = moved(rated, step)
            after = state(tried)
            if after[0] < size:
                store.drop(rated[0])
                steps.append(step)
                rated, (size, off, gram, _) = tried, after
                break
            store.drop(tried[0])
            step = [g / 2 for g in step]
        if before - size <= 1e-3 * tolerance:
            break
    best, pace = (size, len(steps)), 1 / sum(whole[i][i] for i in k)  # the trace is no less than the largest eigenvalue
    for turn in range(plain if size > tolerance else 0):
        steps.append([pace * x for x in off])
        last, rated = rated, moved(rated, steps[-1])
        store.drop(last[0])
        size, after, _, way = state(rated)
        best = min(best, (size, len(steps)))
        change = [x - y for x, y in zip(after, off)]
        off, square = after, sum(x * x for x in change)
        if size <= tolerance or not square:
            break
        pace = square / sum(change[i] * whole[i][j] * change[j] for i in k for j in k) if turn % 2 else way / square
    return Rates(steps[: best[1]])


#: Copies of a document that are made at a time.
LEVEL = 4096


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: the rate's whole part, and once more for a share of the ids equal to the rest."""
    draw = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options: float) -> DataFrame:
    """For each document its ``n_tokens``, posteriors (an array in the targets' order), ``rate`` and ``copies``."""
    domains = fit_domains(docs, labels, list(targets), **options)
    members = Store(docs.sparkSession, "mixing").put(domains.posteriors(docs, F.col("doc_id").cast("long").alias("doc_id")), "members")
    rate = fit_rates(members, list(targets.values())).column()
    rated = members.select("doc_id", "n_tokens", F.array(*[f"p_{k}" for k in range(len(targets))]).alias("posterior"), rate.alias("rate"))
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options: float) -> DataFrame:
    """The documents, each as often as its ``copies`` say; the columns stay the same."""
    domains = fit_domains(docs, labels, list(targets), **options)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    members = Store(docs.sparkSession, "mixing").put(domains.posteriors(docs, whole, F.col("doc_id").alias("_id")), "members")
    rate = fit_rates(members, list(targets.values())).column()
    rated = members.select("_row", "_id", rate.alias("_rate")).select("_row", copies(F.col("_rate"), F.col("_id")).alias("_n"))
    # in two levels, so that no row makes a long array, whatever its rate; a row without copies has none, as a filter would
    # compute the rate once more
    level = F.lit(LEVEL).cast("long")
    upto = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / level))
    many = rated.select("_row", "_n", F.explode(F.when(F.col("_n") > 0, upto)).alias("_at"))
    return many.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(level, F.col("_n") - F.col("_at") * level)))).select("_row.*")
