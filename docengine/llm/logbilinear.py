"""Language-model scores from a log-bilinear neural model, next to add-half unigram scores.

The unigram base counts every token of the training documents exactly: words, and one end for each document.  The
log-bilinear model predicts a token from the two before it.  Every word has an embedding, as context and as target: the
commonest (those that occur ``own`` times, up to ``units`` of them) one of their own, all others that of a hashed unit,
which they share with words of their shape and hash.  Units in the order of their counts are cut into classes of about
equal mass, as many as the square root of the units: the model gives the class, then the unit within it, both
log-bilinear.  A word of a hashed unit has its add-half share of it, so the product is a distribution over all words, one
unknown word for each hashed unit included.

Noise-contrastive estimation runs in numpy.  Training goes through every token of the training documents equally often, at
one rate (once, or as often as ``visits`` tokens ask for; equal ones in equal contexts that a task holds together are one
with a weight), in rounds over disjoint parts of the documents, on each partition by itself; after a round the partitions'
parameters are averaged, each row by how much it has learnt from.  Partitions grow with the tokens, and a
partition's updates are far smaller than its texts.  Nothing is shuffled before training, so a task that is run again
sees the same rows in the same order and learns the same.

Scoring normalises exactly, by matrix products: the contexts of a batch of documents with all classes, and the tokens of
each class with all units of that class.

Documents whose ``crc32`` of the id, as text, leaves the remainder 1 on division by 5 are held out of all learning.

What is broadcast: parameters and words of at most ``units`` units and the hashed ones, some 12 MB, and counts of at most ``head`` words, some
4 MB, however large the corpus.  Counts of other words meet the documents' words in a join.

Defined cases: a null or empty text is its end alone; a null id is not held out; rows are scored each on its own; an
empty table gives no rows; where nothing is left to train on, all tokens are unknown and the model is the base;
further columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.store import Store
from docengine.llm.words import slices

#: The end of a text, as a word; no word of a text is empty.
END = b""
#: Shapes are 20, by last byte (letter, stop, comma, digit, other) and by what else a word holds, times so many hashes.
HASHES = 16
SHAPES = 20 * HASHES
#: Texts that a task takes at a time, and rows of counts that it merges before it hands them on.
SLICE, FLUSH = 1024, 500_000
#: Rows of a class that meet its units in one product.
PIECE = 32


def shape(word: bytes) -> int:
    """The shape of a word and a hash of it as one number below SHAPES."""
    last = word[-1] if word else 0
    ending = 0 if 97 <= last <= 122 or last >= 128 else 1 if last in b".!?" else 2 if last in b",;:" else 3 if 48 <= last <= 57 else 4
    foreign = not word.isascii()
    return (ending * 4 + 2 * foreign + (len(word) > 8)) * HASHES + xxhash.xxh3_64_intdigest(word) % HASHES


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z in lower case, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # cuts at the six ASCII white-space characters
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    full = pc.not_equal(flat, "")
    upto = np.concatenate([[0], full.to_numpy(zero_copy_only=False).cumsum()])
    return flat.filter(full), upto[offsets[1:]] - upto[offsets[:-1]]


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` and its ``count`` over all texts (a column ``text``), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> pa.RecordBatch:
            summed = pa.concat_tables(held).group_by("word").aggregate([("count", "sum")])
            held.clear()
            return pa.RecordBatch.from_arrays([summed["word"].combine_chunks().cast(pa.binary()), summed["count_sum"].combine_chunks()], names=["word", "count"])

        for batch in slices(batches, SLICE):
            flat, _ = split(batch.column(0))
            found = pc.value_counts(flat)
            held.append(pa.table({"word": found.field(0), "count": found.field(1)}))
            held.append(pa.table({"word": pa.array([END.decode()]), "count": pa.array([batch.num_rows], pa.int64())}))
            if sum(t.num_rows for t in held) > FLUSH:
                yield flush()
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


@dataclass
class Encoded:
    unit: np.ndarray  # of all tokens in a row, the end after each text's words
    context: np.ndarray  # the two units before each, as a number
    sizes: np.ndarray  # tokens of each text
    code: np.ndarray  # places of the words, without ends, in the vocabulary; -1 for others
    text: np.ndarray  # which text each word is of
    other: pa.Array  # the distinct words that the vocabulary lacks
    which: np.ndarray  # of each word with the code -1, its place among these
    shapes: np.ndarray  # theirs


class Vocabulary:
    """Words with their units, in the order of counts; others have their shape's.  The unit before a text's start is the
    one after the last."""

    def __init__(self, words: list[bytes], units: np.ndarray, shapes: np.ndarray, end: int, many: int):
        self.words, self.units, self.shapes, self.end, self.many = pa.array(words, pa.binary()).cast(pa.string()), np.append(units, 0), shapes, end, many

    def encode(self, texts: pa.Array) -> Encoded:
        flat, sizes = split(texts)
        code = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy().astype(np.int64)
        lacking = np.flatnonzero(code < 0)
        named = flat.take(pa.array(lacking)).dictionary_encode()
        which = named.indices.to_numpy().astype(np.int64)
        kinds = np.array(list(map(shape, named.dictionary.cast(pa.binary()).to_pylist())), np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        sizes = sizes + 1
        unit = np.full(len(code) + len(sizes), self.end)
        own = self.units[code]
        own[lacking] = self.shapes[kinds[which]]
        unit[np.arange(len(code)) + text] = own
        first, start = sizes.cumsum() - sizes, self.many - 1
        one = np.concatenate([[start], unit[:-1]])[: len(unit)]
        two = np.concatenate([[start] * 2, unit[:-2]])[: len(unit)]
        one[first] = start
        two[first] = start
        two[first[sizes > 1] + 1] = start
        return Encoded(unit, two * self.many + one, sizes, code, text, named.dictionary, which, kinds)


def _summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    order = np.argsort(ids)
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True] * (len(ids) > 0), ids[1:] != ids[:-1]]))
    return ids[first], np.add.reduceat(rows.take(order, 0), first, axis=0) if len(ids) else rows


def _pieces(times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of so many rows cut into pieces of ``PIECE`` rows: each row's place in its piece, its piece, and each piece's
    group.  What is filled up is less than a piece a group, however uneven these are."""
    place = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
    many = -(-times // PIECE)
    return place % PIECE, np.repeat(many.cumsum() - many, times) + place // PIECE, np.repeat(np.arange(len(times)), many)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class LogBilinear:
    """After units (j, i) the row h = q[i] C1 + q[j] C2 predicts; a class c scores h . k[c], a unit w of it h . r[w], where
    the last column of k and r stands for a bias."""

    def __init__(self, mass: np.ndarray, width: int = 24, seed: int = 11):
        """``mass`` has the units' counts, none above the one before it.  Before any training the model is that of counts."""
        self.mass = mass / mass.sum()
        self.edges = np.concatenate([[0.0], self.mass.cumsum()])
        classes = math.isqrt(len(mass) - 1) + 1
        _, self.of = np.unique(np.minimum(self.edges[:-1] * classes, classes - 1).astype(np.int64), return_inverse=True)
        self.low = np.searchsorted(self.of, np.arange(self.of[-1] + 2))
        self.weight = np.add.reduceat(self.mass, self.low[:-1])
        self.many, self.width, r = len(mass) + 1, width, np.random.default_rng(seed)
        start = lambda n, bias: np.concatenate([r.normal(0, 0.1, (n, width)), bias[:, None]], 1)
        self.parameters = {
            "q": r.normal(0, 0.1, (self.many, width)), "k": start(len(self.weight), np.log(self.weight)),
            "r": start(len(mass), np.log(self.mass / self.weight[self.of])), "c1": np.eye(width), "c2": 0.5 * np.eye(width),
        }
        self.parameters = {k: x.astype(np.float32) for k, x in self.parameters.items()}
        self.turned: tuple[np.ndarray, np.ndarray] | None = None

    def copy(self) -> LogBilinear:
        own = copy.copy(self)
        own.parameters, own.turned = {k: x.copy() for k, x in self.parameters.items()}, None
        return own

    def predicted(self, context: np.ndarray) -> np.ndarray:
        if self.turned is None:  # the parameters stay as they are from now on
            p = self.parameters
            self.turned = p["q"] @ p["c1"], p["q"] @ p["c2"]
        j, i = np.divmod(context, self.many)
        h = np.ones((len(context), self.width + 1), np.float32)
        h[:, :-1] = self.turned[0].take(i, 0) + self.turned[1].take(j, 0)
        return h

    @staticmethod
    def _totals(h: np.ndarray, rows: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """For each row of ``h`` the natural log of the sum of exp(h . row) over all ``rows``; in blocks that stay in a
        processor's cache."""
        out, step, ones = np.zeros(len(h)), max(1, block // len(rows)), np.ones(len(rows), np.float32)
        bounded = np.sqrt((h**2).sum(1).max(initial=0) * (rows**2).sum(1).max()) < 80
        for k in range(0, len(h), step):
            s = h[k : k + step] @ rows.T
            if not bounded:
                out[k : k + step] = top = s.max(1)
                s -= top[:, None]
            out[k : k + step] += np.log(np.exp(s, out=s) @ ones)
        return out

    def logs(self, context: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural log of each unit's probability after its context.  Each context is normalised over the classes once, and
        over the units of a class once for all of them that follow it."""
        p, many = self.parameters, len(self.weight)
        met, context = np.unique(context, return_inverse=True)
        pairs, pair = np.unique(context * many + self.of[unit], return_inverse=True)
        h, (at, of) = self.predicted(met), np.divmod(pairs, many)
        out = -self._totals(h, p["k"])[at]
        for k in range(0, len(at), 1 << 16):
            some = slice(k, k + (1 << 16))
            out[some] += np.einsum("ij,ij->i", h.take(at[some], 0), p["k"].take(of[some], 0))
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(many + 1))
        deep = np.diff(self.low) > 1
        for c in np.flatnonzero((np.diff(cuts) > 0) & deep):
            own = order[cuts[c] : cuts[c + 1]]
            out[own] -= self._totals(h.take(at[own], 0), p["r"][self.low[c] : self.low[c + 1]])
        inner = np.flatnonzero(deep[of][pair])
        out = out[pair]
        for k in range(0, len(inner), 1 << 16):
            some = inner[k : k + (1 << 16)]
            out[some] += np.einsum("ij,ij->i", h.take(context[some], 0), p["r"].take(unit[some], 0))
        return out

    def begin(self, noise: int, inner: int, rate: float, seed: int, calm: float = 1.0) -> None:
        """Makes ready for the steps of a round."""
        self.random, self.noise, self.inner, self.rate, self.calm = np.random.default_rng(seed), noise, inner, rate, calm
        self.seen = {k: np.full(len(x) if k in "qkr" else x.shape, self.calm, np.float32) for k, x in self.parameters.items()}
        self.learnt = {k: np.zeros(len(self.parameters[k]), np.float32) for k in "qkr"}

    def _move(self, name: str, ids: np.ndarray, rows: np.ndarray) -> None:
        """An Adagrad step of some rows, with one pace for each row."""
        ids, g = _summed(ids, rows)
        self.learnt[name][ids] += 1
        self.seen[name][ids] = seen = self.seen[name].take(ids) + np.einsum("ij,ij->i", g, g) / g.shape[1]
        g *= (self.rate / np.sqrt(seen))[:, None]
        self.parameters[name][ids] = self.parameters[name].take(ids, 0) - g

    def step(self, context: np.ndarray, unit: np.ndarray, weight: np.ndarray) -> None:
        """A noise-contrastive step on weighted tokens: each one's class against classes drawn for all rows alike, and its unit against
        units drawn for all rows of its class alike."""
        p, of = self.parameters, self.of.take(unit)
        j, i = np.divmod(context, self.many)
        qi, qj = p["q"].take(i, 0), p["q"].take(j, 0)
        h = np.ones((len(unit), self.width + 1), np.float32)
        h[:, :-1] = qi @ p["c1"] + qj @ p["c2"]
        drawn = np.minimum(np.searchsorted(self.weight.cumsum(), self.random.random(self.noise)), len(self.weight) - 1)
        shift = np.log(self.noise * self.weight).astype(np.float32)
        k_own, k_drawn = p["k"].take(of, 0), p["k"].take(drawn, 0)
        e_own = weight * (_sigmoid(np.einsum("ij,ij->i", h, k_own) - shift[of]) - 1)
        e_drawn = h @ k_drawn.T
        e_drawn -= shift[drawn]
        e_drawn = _sigmoid(e_drawn)
        e_drawn *= weight[:, None]
        gh = e_own[:, None] * k_own + e_drawn @ k_drawn
        ids, sums = _summed(of, e_own[:, None] * h)
        moved = {"k": (np.concatenate([ids, drawn]), np.concatenate([sums, e_drawn.T @ h]))}
        deep = np.flatnonzero(np.diff(self.low)[of] > 1)
        if len(deep):
            deep = deep[np.argsort(of[deep], kind="stable")]
            w, hd = unit[deep], h.take(deep, 0)
            classes, times = np.unique(of[deep], return_counts=True)
            low, long = self.low[classes], np.diff(self.low)[classes]
            other = low[:, None] + (self.random.random((len(classes), self.inner)) * long[:, None]).astype(np.int64)
            shift = np.log(self.inner / long).astype(np.float32)
            which = np.repeat(np.arange(len(classes)), times)
            r_own = p["r"].take(w, 0)
            e_own = weight[deep] * (_sigmoid(np.einsum("ij,ij->i", hd, r_own) - shift[which]) - 1)
            # rows of one class stand together, so many at a time, the last ones filled up with zeros
            at, piece, of_piece = _pieces(times)
            stack, seen = np.zeros((len(of_piece), PIECE, self.width + 1), np.float32), np.zeros((len(of_piece), PIECE, 1), np.float32)
            stack[piece, at], seen[piece, at, 0] = hd, weight[deep]
            other = other[of_piece]
            rows = p["r"].take(other, 0)
            e = stack @ rows.transpose(0, 2, 1)
            e -= shift[of_piece, None, None]
            e = _sigmoid(e)
            e *= seen
            gh[deep] += e_own[:, None] * r_own + (e @ rows)[piece, at]
            moved["r"] = np.concatenate([w, other.ravel()]), np.concatenate([e_own[:, None] * hd, (e.transpose(0, 2, 1) @ stack).reshape(-1, self.width + 1)])
        gh = gh[:, :-1]
        moved["q"] = np.concatenate([i, j]), np.concatenate([gh @ p["c1"].T, gh @ p["c2"].T])
        for name, q in (("c1", qi), ("c2", qj)):
            g = q.T @ gh
            self.seen[name] += g**2
            p[name] -= 0.1 * self.rate * g / np.sqrt(self.seen[name])
        for name, (at, g) in moved.items():
            self._move(name, at, g)

    def packed(self, steps: int) -> pa.RecordBatch:
        """Rows of all parameters that have learnt something, with their weights, in chunks."""
        p, wide = self.parameters, self.width + 1
        rows = np.concatenate([np.pad(p[k], ((0, 0), (0, wide - p[k].shape[1]))) for k in p])
        weights = np.concatenate([self.learnt[k] if k in self.learnt else np.full(len(p[k]), steps, np.float32) for k in p])
        at = [np.flatnonzero(weights[k : k + CHUNK]) + k for k in range(0, len(rows), CHUNK)]
        kept = [(k, x) for k, x in enumerate(at) if len(x)]
        columns = [pa.array([k for k, _ in kept], pa.int32()), *(pa.array([a[x].astype(t).tobytes() for _, x in kept], pa.binary()) for a, t in ((np.arange(len(rows)), "i8"), (weights, "f8"), (rows, "f4")))]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "at", "weights", "rows"])

    def with_rows(self, at: np.ndarray, rows: np.ndarray) -> LogBilinear:
        """The model with these rows, as ``packed`` numbers them, in place of its own."""
        own, n = self.copy(), 0
        for x in own.parameters.values():
            mine = (at >= n) & (at < n + len(x))
            x[at[mine] - n] = rows[mine][:, : x.shape[1]]
            n += len(x)
        return own


#: Rows of parameters that are averaged together.
CHUNK = 1024
#: Tokens that a task holds before it learns from them.
HELD = 2_000_000
PACKED = "chunk int, at binary, weights binary, rows binary"


def _mean(table: pa.Table) -> pa.Table:
    """Of one chunk, each row's mean by the weights of what it has learnt from."""
    at, weights, rows = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("at", "i8"), ("weights", "f8"), ("rows", "f4")))
    ids, sums = _summed(at, rows.reshape(len(at), -1) * weights[:, None])
    _, total = _summed(at, weights[:, None])
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "at": [ids.tobytes()], "weights": [total.tobytes()], "rows": [(sums / total).astype("f4").tobytes()]})


@dataclass
class Model:
    words: list[bytes]  # those with a unit of their own
    places: np.ndarray  # their units, then those of the shapes
    counts: dict[bytes, int]  # of the commonest words, all of those with at least ``least`` occurrences
    least: int
    tokens: int
    distinct: int
    share: np.ndarray  # add-half total of the words that share a unit, by shape
    net: LogBilinear | None

    def vocabulary(self, words: list[bytes]) -> Vocabulary:
        """Of these words; those without a unit of their own have their shape's."""
        places, shapes = dict(zip(self.words, self.places.tolist())), self.places[len(self.words) :]
        units = np.array([places[w] if w in places else shapes[shape(w)] for w in words], np.int64)
        return Vocabulary(words, units, shapes, places.get(END, 0), len(self.places) + 1)


def _head(words: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """Counts of the words that occur ``least`` times or more, with the smallest ``least`` that leaves ``most`` words
    at the utmost.  The choice reads a histogram of counts of fixed length."""
    bin_of = F.floor(F.log2(F.col("count").cast("double")) * 8).cast("int")
    bins = sorted(((r[0], r[1]) for r in words.groupBy(bin_of).agg(F.count("*")).collect()), reverse=True)
    total, lowest = 0, None
    for b, n in bins:
        if (total := total + n) > most:
            break
        lowest = b
    chosen = F.col("word") == F.lit(bytearray(END)) if lowest is None else (bin_of >= lowest) | (F.col("word") == F.lit(bytearray(END)))
    rows = words.where(chosen).toArrow()
    counts = dict(zip(rows["word"].to_pylist(), rows["count"].to_pylist()))
    least = min((n for w, n in counts.items() if w != END), default=1 << 62)
    return counts, least


def fit(docs: DataFrame, store: Store, *, own: int = 100, units: int = 40_000, head: int = 150_000, width: int = 24, rounds: int = 3, part: int = 20_000_000, visits: int = 1_000_000, size: int = 8192, noise: int = 64, inner: int = 16, most: int = 16, rate: float = 0.08) -> tuple[Model, DataFrame]:
    """The model, and the table of all word counts that it rests on.  ``part`` tokens make a partition of training, and
    training goes through ``visits`` tokens at least."""
    if not 0 < units <= 2_000_000:
        raise ValueError("units must be at most 2,000,000, so that three of them make a number")
    texts = docs.where(~held_out()).select("doc_id", "text")
    words = store.put(count_words(texts), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    counts, least = _head(words, head)
    ranked = sorted(((-n, w) for w, n in counts.items() if n >= own and w != END))[: units - 1]
    top = sorted([w for _, w in ranked] + [END] * (END in counts))
    known = set(top)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(SHAPES), np.zeros(SHAPES, np.int64)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w not in known:
                    k = shape(w)
                    total[k] += n + 0.5
                    seen[k] += n
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(total), pa.array(seen)], names=["shape", "total", "seen"])

    share, mass = np.full(SHAPES, 0.5), np.array([counts.get(w, 0) for w in top] + [0] * SHAPES) + 0.5
    for k, x, n in words.mapInArrow(shares, "shape int, total double, seen long").groupBy("shape").agg(F.sum("total"), F.sum("seen")).collect():
        share[k] += x
        mass[len(top) + k] += n
    order = np.argsort(-mass, kind="stable")
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    model = Model(top, places, counts, least, tokens, distinct, share, None)
    untrained = Model(top, places, {}, least, tokens, distinct, share, None)  # what the tasks need of it
    if not tokens:
        return model, words
    net, parts, passes = LogBilinear(mass[order], width), -(-tokens // part), -(-visits // tokens)
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], begun=net, turn=turn) -> Iterator[pa.RecordBatch]:
            own, vocabulary, held, steps, waiting = begun.copy(), untrained.vocabulary([w for w in top if w != END]), [], 0, 0
            own.begin(noise, inner, rate, 1000 * turn + TaskContext.get().partitionId())

            def learn() -> int:
                """Equal tokens in equal contexts are a row with their number as its weight, or several of ``most`` at the
                utmost."""
                unit, context = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                held.clear()
                met, times = np.unique(context * own.many + unit, return_counts=True)
                cuts = -(-times // most)
                met, weight = np.repeat(met, cuts), np.repeat((times / cuts).astype(np.float32), cuts)
                context, unit = np.divmod(met, own.many)
                for _ in range(passes):
                    for at in np.array_split(own.random.permutation(len(unit)), -(-len(unit) // size)):
                        own.step(context[at], unit[at], weight[at])
                return passes * -(-len(unit) // size)

            for batch in slices(batches, SLICE):
                got = vocabulary.encode(batch.column(0))
                held.append((got.unit, got.context))
                waiting += len(got.unit)
                if waiting > HELD:
                    steps, waiting = steps + learn(), 0
            if waiting:
                steps += learn()
            if steps:
                yield own.packed(steps)

        mine = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn)
        got = mine.select("text").coalesce(parts).mapInArrow(run, PACKED).groupBy("chunk").applyInArrow(_mean, PACKED).toArrow()
        at, rows = (np.frombuffer(b"".join(got[c].to_pylist()), t) for c, t in (("at", "i8"), ("rows", "f4")))
        net = net.with_rows(at, rows.reshape(len(at), width + 1))
    model.net = net
    return model, words


def _scores_in_head(docs: DataFrame, model: Model) -> DataFrame:
    """Two kinds of rows under a document's key: one for the document, with the scores of what the broadcast counts
    cover, and one for each further word of it."""
    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, net double, word binary, share double, times long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.float64(), pa.int64()]
    # made here once, not by every task
    words, own, net = sorted(w for w in model.counts if w != END), set(model.words), model.net
    vocabulary, shares, end = model.vocabulary(words), np.log10(model.share), model.counts.get(END, 0)
    whole = np.log10(model.tokens + 0.5 * (model.distinct + 1))
    base = np.log10(np.array([model.counts[w] for w in words] + [0]) + 0.5) - whole
    inner = np.array([0.0 if w in own else float(np.log10((model.counts[w] + 0.5) / model.share[shape(w)])) for w in words] + [0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 512):
            got = vocabulary.encode(batch.column(2))
            known, many = got.code >= 0, batch.num_rows
            of_text = lambda values: np.bincount(got.text[known], values, many)
            bases = of_text(base[got.code[known]]) + np.log10(end + 0.5) - whole
            nets = np.zeros(many)
            if net is not None:
                nets = np.add.reduceat(net.logs(got.context, got.unit), got.sizes.cumsum() - got.sizes) / np.log(10) + of_text(inner[got.code[known]])
            keys = np.arange(key, key + many)
            key += many
            told = [keys, batch.column(0), batch.column(1), got.sizes, of_text(np.ones(known.sum())).astype(np.int64) + (end > 0), bases, nets]
            yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(told, kinds)), *(pa.nulls(many, k) for k in kinds[7:])], names=names)
            pairs, times = np.unique(got.text[~known] * max(1, len(got.other)) + got.which, return_counts=True)
            text, word = np.divmod(pairs, max(1, len(got.other)))
            rest = [got.other.cast(pa.binary()).take(pa.array(word)), pa.array(shares[got.shapes[word]]), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(keys[text]), *(pa.nulls(len(pairs), k) for k in kinds[1:7]), *rest], names=names)

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, schema)


def scores(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document (``doc_id``,
    ``text``), learnt from those that aren't held out."""
    store = Store(docs.sparkSession, "logbilinear")
    model, words = fit(docs, store, **options)
    rows = store.put(_scores_in_head(docs, model), "rows")
    whole = F.lit(float(np.log10(model.tokens + 0.5 * (model.distinct + 1))))
    # words beyond the broadcast counts take theirs from the table
    rare = rows.where("word is not null").select("key", "word", "share", "times").join(words.where(F.col("count") < model.least), "word", "left")
    log = F.log10(F.coalesce("count", F.lit(0)) + 0.5)
    # where nothing was learnt the model is the base
    inner = log - F.col("share") if model.net is not None else F.lit(0.0)
    added = rare.groupBy("key").agg(
        F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (log - whole)).alias("more_base"),
        F.sum(F.col("times") * inner).alias("more_net"),
    )
    out = rows.where("n_tokens is not null").drop("word", "share", "times").join(added, "key", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0))
    net = F.col("net") + F.coalesce("more_net", F.lit(0.0)) if model.net is not None else base
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), net.alias("score"))
