"""Documents whose sets of word shingles are similar, and the groups that such links join.

A document's set is its distinct shingles of five words, as 64-bit hashes; documents with equal sets are one node.  Two
nodes link when their Jaccard similarity is at least the threshold.  The join is exact: prefixes are extended so that
similar nodes share several tokens of them, combinations of tokens are what candidates must have in common, and every
candidate is verified on whole sets.

1. Prefixes.  In the order of hashes, similar sets share their first l common shingles within the first
   ``n - overlap + l`` of either, with l a tenth of the overlap.  Each shingle's list knows two of its nodes, the smallest
   and the largest; a node of whose prefix fewer than l shingles have another node is done.  What is left is verified
   against the node that most of its prefix names.  Of a shingle that is frequent in a task's part of the table, all but
   two nodes settle this on the spot, so no list is longer than twice the number of tasks.
2. Turns.  Verified links give components.  The same is done again on the shingles that several components share: a node
   meets the component, by its smallest node, that most of its prefix names.  A node with too few such shingles is done;
   each turn leaves fewer.
3. Token combinations.  Of the nodes left, all shingles that several components share are ordered by the number of nodes,
   after those that only one has, and prefixes extended again.  A rare shingle is indexed alone.  Frequent ones are
   indexed in combinations of two: they are dealt into classes by hash, one fewer than similar sets share in their
   prefixes, so two of what they share fall into one class, and a node has a number of pairs in proportion to its set.
   The classes depend on the size's bucket; a node is indexed for its own and the next.  Nodes of different components
   under a rare key are verified; those under frequent keys form clusters, verified in blocks of bounded size by matrix
   products, giving only links between different components.

Links never leave the tables.  Shingles and sets are compared by 64-bit hashes; a chance collision could only matter
where it turns a similarity at the very threshold.

Defined cases: a null or empty text has the empty set, which links with nothing; fewer than five words are one shingle;
a row with a null id has its set counted, belongs to no component (null) and links nothing; rows that share an id are
each placed by their own text; an empty table gives no rows; further columns are ignored by ``groups``, kept by
``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.components import components
from docengine.llm.store import SHUFFLED, SMALL_BATCHES, Store
from docengine.llm.words import MEMO, slices, texts_as_bytes

SIZE = 5
PERCENT = 80
#: Shingles of more nodes than this are indexed in pairs.
FREQUENT = 32
#: Turns of prefixes before the token combinations.
TURNS = 2
#: Shingles of prefixes that a task holds before it settles the frequent among them.
HELD = 2_000_000
#: Nodes in a block of a cluster.
BLOCK = 1024
#: Odd multipliers of the rolling hash and of mixing (made from a rule, not from a table).
ODD = [int(xxhash.xxh3_64_intdigest(bytes([k]))) | 1 for k in range(64)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(ODD[30])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(ODD[31])
    return x ^ (x >> np.uint64(32))


def sets_of(texts: list[bytes], memo: WordHashes, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [t.lower().split() for t in texts]
    flat = [w for words in split for w in words]
    h = np.fromiter(map(memo.__getitem__, flat), np.uint64, len(flat))
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += h[k : k + n] * np.uint64(ODD[k])
    rolled, at, out = _mix(rolled), 0, []
    for words in split:
        m = len(words)
        if m >= size:
            out.append(np.unique(rolled[at : at + m - size + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if m else [], np.uint64))
        at += m
    return out


def _overlap(n: int, percent: int) -> int:
    """The least number of shingles that a set of n shares with a similar one."""
    return -(-percent * n // 100)


def _extension(n: int) -> int:
    return max(1, n // 10)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))


def _node(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _settled(owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its place among the rows of its token (by owner, who has a token once), and the first of them."""
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.concatenate([[True] * (len(order) > 0), token[order][1:] != token[order][:-1]]))
    times = np.diff(np.append(first, len(order)))
    place, leader = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(first, times)
    leader[order] = np.repeat(owner[order[first]], times)
    return place, leader


def _described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """For each document its node, the size of its set, a hash of its text, and of nodes that the task hasn't met before on
    a row with an id: the tokens of the prefix that other tasks must see, how many others are ``settled`` as shared, and
    the node (``near``) that most of those name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, met, held, many = WordHashes(), set(), [], 0

        def flush() -> pa.RecordBatch:
            prefixes = [x for h in held for x in h[-1]]
            nodes = np.array([k or 0 for h in held for k in h[3]], np.int64)
            owner = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
            token = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
            place, leader = _settled(owner, token)
            late = place > 1
            settled = np.bincount(owner[late], minlength=len(prefixes))
            pair, times = np.unique(owner[late] * len(prefixes) + leader[late], return_counts=True)
            pair = pair[np.argsort(times, kind="stable")]
            near = np.full(len(prefixes), -1)
            near[pair // max(1, len(prefixes))] = pair % max(1, len(prefixes))  # the last, most frequent one stays
            offsets = np.concatenate([[0], np.bincount(owner[~late], minlength=len(prefixes)).cumsum()]).astype(np.int32)
            columns = [pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), pa.array([k for h in held for k in h[3]], pa.int64()), pa.array([n for h in held for n in h[2]], pa.int64())]
            columns += [pa.array([_extension(_overlap(n, percent)) for h in held for n in h[2]], pa.int32()), pa.array(settled, pa.int32()), pa.array(nodes[near], pa.int64(), mask=near < 0) if len(nodes) else pa.array([], pa.int64())]
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(token[~late].view(np.int64))))
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "n", "need", "settled", "near", "prefix"])

        for batch in slices(batches):
            nodes, counts, prefixes = [], [], []
            for known, tokens in zip(batch.column(0).is_valid().to_pylist(), sets_of(texts_as_bytes(batch.column(2)), memo, size)):
                n = len(tokens)
                node = _node(tokens) if n else None
                fresh = n and known and node not in met
                if known and n:
                    met.add(node)
                nodes.append(node)
                counts.append(n)
                prefixes.append(_prefix(tokens, percent) if fresh else tokens[:0])
                many += len(prefixes[-1])
            held.append((batch.column(0), batch.column(1), counts, nodes, prefixes))
            if many > HELD:
                yield flush()
                many = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), _text_hash().alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, node long, n long, need int, settled int, near long, prefix array<long>")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Of the sorted tokens those of the prefix, extended by a tenth."""
    return tokens[: len(tokens) - _overlap(len(tokens), percent) + _extension(len(tokens))]


def _ends(rows: DataFrame, mask: int) -> DataFrame:
    """Of ``token, node, component`` the tokens of several components, with two of these and the number of rows.  The
    mask changes which two."""
    turned = F.col("component").bitwiseXOR(F.lit(mask))
    ends = rows.groupBy("token").agg(F.min(turned).alias("lo"), F.max(turned).alias("hi"), F.count("*").alias("many")).where("lo < hi")
    return ends.select("token", *[F.col(c).bitwiseXOR(F.lit(mask)).alias(c) for c in ("lo", "hi")], "many")


def _company(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """For each node of ``token, node, component`` how many of its tokens another component has (``found``), and the
    component (``hub``) that most of them name."""
    named = rows.join(ends.drop("many"), "token").select("node", "component", F.explode(F.array(F.struct(F.col("lo").alias("hub"), F.lit(1).alias("one")), F.struct(F.col("hi").alias("hub"), F.lit(0).alias("one")))).alias("e"))
    times = named.select("node", (F.col("e.hub") != F.col("component")).alias("other"), "e.*").groupBy("node", "other", "hub").agg(F.count("*").alias("times"), F.sum("one").alias("found"))
    return times.groupBy("node").agg(F.sum("found").alias("found"), F.max(F.when(F.col("other"), F.struct("times", "hub")))["hub"].alias("hub"))


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One row for each node (``node``, ``doc_id``) with its set, read from that document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            rows = [(k, t) for k, t in zip(batch.column(0).to_pylist(), sets_of(texts_as_bytes(batch.column(1)), memo, size)) if _node(t) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()), pa.array([t.tobytes() for _, t in rows], pa.binary())], names=["node", "n", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(nodes, "doc_id")
    return texts.select("node", "text").mapInArrow(run, "node long, n long, tokens binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (``a``, ``b``) of nodes whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x, y = (c.to_pylist() for c in batch.columns[2:4])
            keep, last, own = [], None, None
            for s, t in zip(x, y):
                if s is not last and s != last:
                    last, own = s, np.frombuffer(s, np.uint64)
                other = np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    sizes = sets.select("node", "n")
    fit = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    fit = fit.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    both = fit.join(left.drop("na"), "a").join(right.drop("nb"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long").distinct()


def _shared(rows: DataFrame, ends: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of ``token, node, component`` the rows of tokens that several components share, with their number ``many``, for
    nodes that have enough of them to be similar to one of another component; and the size ``n``."""
    kept = rows.join(ends.select("token", "many"), "token")
    enough = kept.groupBy("node").agg(F.count("*").alias("own")).join(sizes, "node").where(F.col("own") * 100 >= percent * F.col("n")).select("node", "n")
    return kept.join(enough, "node")


def _step(percent: int) -> float:
    """A little more than the largest ratio of similar sets' sizes."""
    return 101 / percent


def _bucket(n: int, percent: int) -> int:
    """Similar sets are in one bucket or in two that follow each other."""
    return int(np.log(n) / np.log(_step(percent)))


def _classes(bucket: int, percent: int) -> int:
    """The number of classes for a bucket and the one before it: a tenth of the smallest set, so that similar sets share
    one token more than that."""
    return max(1, int(_step(percent) ** (bucket - 1) / 10))


def _pair_keys(often: np.ndarray, classes: int, bucket: int) -> np.ndarray:
    """A key for every two of the tokens in one class."""
    which = often % np.uint64(classes)
    order = np.lexsort((often, which))
    token, which, out = often[order], which[order], []
    for lag in range(1, len(token)):
        same = which[lag:] == which[:-lag]
        if not same.any():
            break
        out.append(_mix(token[lag:][same] * np.uint64(ODD[5]) + token[:-lag][same]) ^ np.uint64(ODD[6 + bucket % 32]))
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def _keys(own: DataFrame, percent: int, frequent: int) -> DataFrame:
    """``key, often, node, component, n``: rare tokens of each node's prefix alone, frequent ones in pairs."""

    def run(rows: pa.Table) -> pa.Table:
        n, token, many = rows["n"][0].as_py(), rows["token"].to_numpy(), rows["many"].to_numpy()
        order = np.lexsort((token, many))
        token, many, bucket, closed = token[order].view(np.uint64), many[order], _bucket(n, percent), n - len(token)  # the closed ones come first
        rare, pairs = np.zeros(0, np.uint64), []
        for b in (bucket, bucket + 1):
            room = max(0, n - _overlap(n, percent) + _classes(b, percent) + 1 - closed)
            seldom = many[:room] <= frequent
            rare = max(rare, token[:room][seldom], key=len)
            pairs.append(_pair_keys(_mix(token[:room][~seldom]), _classes(b, percent), b))
        key = np.concatenate([rare, *pairs]).view(np.int64)
        same = lambda c: np.full(len(key), rows[c][0].as_py(), np.int64)
        return pa.table({"key": key, "often": np.arange(len(key)) >= len(rare), "node": same("node"), "component": same("component"), "n": same("n")})

    return own.groupBy("node").applyInArrow(run, "key long, often boolean, node long, component long, n long")


def _rare_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """Nodes of different components and fitting sizes that share a rare key."""
    left = keys.where("not often").select("key", F.col("node").alias("a"), F.col("component").alias("x"), F.col("n").alias("na"))
    right = left.select("key", F.col("a").alias("b"), F.col("x").alias("y"), F.col("na").alias("nb"))
    fits = (F.col("x") < F.col("y")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return left.join(right, "key").where(fits).select("a", "b").distinct()


def _cluster_links(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among nodes that frequent keys join, enough of them to connect all they connect."""
    own = keys.where("often").select("key", "node")
    hubs = own.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    stars = own.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    placed = components(stars).select(F.col("vertex").alias("node"), F.col("component").alias("cluster"))
    placed = placed.join(keys.where("often").select("node", "component").distinct(), "node")
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each block meets each other, and itself
    meeting = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    rows = dealt.select("cluster", "node", "component", "block", meeting.alias("m")).join(sets.select("node", "tokens"), "node")

    def run(rows: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(t, np.uint64) for t in rows["tokens"].to_pylist()]
        nodes, groups, block = (rows[c].to_numpy() for c in ("node", "component", "block"))
        size = np.array([len(t) for t in tokens])
        _, column, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        who = np.repeat(np.arange(len(tokens)), size)
        place = np.cumsum(times > 1) - 1
        useful = times[column] > 1
        who, column = who[useful], place[column[useful]]
        common = np.zeros((len(tokens), len(tokens)), np.float32)
        for at in range(0, int((times > 1).sum()), 4096):
            part = (column >= at) & (column < at + 4096)
            x = np.zeros((len(tokens), 4096), np.float32)
            x[who[part], column[part] - at] = 1
            common += x @ x.T
        near = 100 * common >= percent * (size[:, None] + size[None] - common)
        first, second = np.nonzero(np.triu(near & (groups[:, None] != groups[None]), 1))
        root = {g: g for g in groups.tolist()}

        def find(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        kept = []
        for a, b in zip(first.tolist(), second.tolist()):
            g, h = find(int(groups[a])), find(int(groups[b]))
            if g != h:
                root[g] = h
                kept.append((a, b))
        at = np.array(kept, np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[at[:, 0]], "b": nodes[at[:, 1]]})

    return rows.groupBy("cluster", "m").applyInArrow(run, "a long, b long")


def _components_of(sets: DataFrame, found: DataFrame) -> DataFrame:
    """The component of every node, by the smallest of its nodes that is among ``sets``."""
    linked = components(found).select(F.col("vertex").alias("node"), "component")
    placed = sets.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return placed.join(placed.groupBy("component").agg(F.min("node").alias("least")), "component").select("node", F.col("least").alias("component"))


def links(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, turns: int = TURNS) -> tuple[DataFrame, DataFrame, Store]:
    """``(documents, links, tables)``: for each row its ``doc_id``, ``text_hash``, ``node`` (null for the empty set) and
    set size ``n``; pairs of nodes (``a``, ``b``) that are similar, enough of them to connect all that links connect; and
    the store of both tables, ``documents`` and ``links``."""
    store = Store(docs.sparkSession, "jaccard", **SHUFFLED, **SMALL_BATCHES)
    described = store.put(_described(docs, size, percent), "described")
    own = described.where("doc_id is not null and node is not null")
    # the same exchange serves the lists and those who look themselves up in them
    rows = own.select("node", F.col("node").alias("component"), F.explode("prefix").alias("token")).repartition("token")
    mine = own.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.sum("settled").alias("settled"), F.max("need").alias("need"), F.max("near").alias("near"))
    left = mine.join(_company(rows, _ends(rows, 0)), "node", "left").where(F.coalesce("found", F.lit(0)) + F.col("settled") >= F.col("need"))
    company = store.put(left.select("node", "doc_id", "near", "hub"), "company")
    documents = store.put(described.select("doc_id", "text_hash", "node", "n"), "documents")
    store.drop("described")
    sets = store.put(_sets(docs, company.select("node", "doc_id"), size), "sets")
    sizes = sets.select("node", "n")

    def spread(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                tokens = [np.frombuffer(t, np.uint64) for t in batch.column(2).to_pylist()]
                tokens = tokens if whole else [_prefix(t, percent) for t in tokens]
                many = np.array([len(t) for t in tokens], np.int64)
                columns = [np.repeat(np.array(batch.column(k).to_pylist(), np.int64), many) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64))], names=["node", "component", "token"])

        return run

    schema, found, tables = "node long, component long, token long", None, []
    pairs = company.select("node", F.explode(F.array_distinct(F.array_compact(F.array("near", "hub")))).alias("hub")).where("node <> hub")
    for turn in range(turns):
        fresh = store.put(_linked(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), sets, percent), f"near{turn}")
        found = fresh if found is None else found.union(fresh)
        tables.append(f"near{turn}")
        named = store.put(_components_of(sets, found), f"components{turn}")
        placed = sets.select("node", "tokens").join(named, "node").select("node", "component", "tokens")
        if turn + 1 == turns or sets.isEmpty():
            break
        rows = placed.mapInArrow(spread(False), schema)
        ends = store.put(_ends(rows, int(np.uint64(ODD[40 + turn]).astype(np.int64))), f"ends{turn}")
        least = F.greatest(F.lit(1), F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) / 10))
        apart = store.put(_company(rows, ends).join(sizes, "node").where(F.col("found") >= least).select("node", "hub"), f"apart{turn}")
        # a set that is done has no partner outside its component
        sets, pairs = sets.join(apart.select("node"), "node", "left_semi"), apart
        sets = store.put(sets, f"sets{turn}")
        sizes = sets.select("node", "n")
        store.drop(f"ends{turn}", f"components{turn}", "sets" if turn == 0 else f"sets{turn - 1}", *([f"apart{turn - 1}"] if turn else ["company"]))
    if not sets.isEmpty():
        rows = placed.mapInArrow(spread(True), schema)
        ends = store.put(_ends(rows, 0), "ends")
        keys = store.put(_keys(store.put(_shared(rows, ends, sizes, percent), "shared"), percent, frequent), "keys")
        rare = store.put(_linked(_rare_pairs(keys, percent), sets, percent), "rare")
        found = found.union(rare).union(store.put(_cluster_links(keys, sets, percent), "often"))
    pairs = store.put(found, "links")
    store.drop("ends", "shared", "keys", "rare", "often", "company", "sets", f"sets{turn - 1}", f"apart{turn - 1}", f"components{turn}", *tables)
    return documents, pairs, store


def _placed(docs: DataFrame, **options: int) -> DataFrame:
    """For each row its ``doc_id``, ``text_hash``, ``n``, ``component`` (of nodes; null for the empty set and without an
    id) and ``component_id``."""
    rows, pairs, store = links(docs, **options)
    placed = components(pairs).select(F.col("vertex").alias("node"), "component")
    store.drop("links")
    named = rows.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first")).join(placed, "node", "left")
    named = named.select("node", "first", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    out = rows.join(named.join(least, "component").select("node", "component", "component_id"), "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"), alone.alias("component_id"))


def groups(docs: DataFrame, **options: int) -> DataFrame:
    """For each document (``doc_id``, ``text``) the size of its set and its group: the smallest id that links reach."""
    return _placed(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, **options: int) -> DataFrame:
    """One document of each group, unchanged: a row of the group's smallest id.  Rows of equal id and set are one document,
    of which the first by a hash of the text stays; of equal rows one stays.  Documents without an id belong to no group
    and stay."""
    first = _placed(docs, **options).where("doc_id = component_id").groupBy("doc_id", "component").agg(F.min("text_hash").alias("hash")).select(F.col("doc_id").alias("id"), "hash").distinct()
    # rows are carried whole, so no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("hash"))
    one = rows.where("id is not null").join(first, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return one.select("row").union(rows.where("id is null").select("row")).select("row.*")
