"""The training-data operators on small tables with every odd case, against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import chat, components, hamming, jaccard, logbilinear, mixing, packing, pii, quality, queries, rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, nothing, white space of all kinds, one word, repeats, a very long text, and columns that the operators use inside.
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "a b c a b c a b c x"), (6, "one two\n\none two\n \none two three"), (7, "long " * 30000), (None, "no id here"),
    (8, "The Same Words Are Said By All Of Us Here"), (9, "the same words are said by all of us here"), (9, "the same words are said by all of us here"),
    (10, "x\x1cy\x85z\xa0w é😀 <|endoftext|>  two  blanks \0 nul"),
]
SCHEMA = "doc_id long, text string, n int, words string, rank int, node int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0, "w", 1, 2) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# ------------------------------------------------------------------ packing
def test_pieces_are_the_tokenizers_ids(spark, odd, none, corpus):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path())
    assert packing.pack(none, queries.tokenizer_path()).count() == 0
    for docs in (odd, corpus.limit(60)):
        ids = lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]
        rows = sorted(packing.pack(docs, queries.tokenizer_path()).collect(), key=lambda r: r.sequence_id)
        assert len({r.sequence_id for r in rows}) == len(rows)
        assert all(p.length & (p.length - 1) == 0 and p.length <= 1024 and p.offset == 0 and len(p.ids) == 4 * p.length for p in rows)
        made, whole = [], []
        for p in rows:  # a document's pieces follow each other
            whole = [*([] if p.start == 0 else whole), *np.frombuffer(p.ids, "<u4").tolist()]
            assert len(whole) == p.start + p.length
            if len(whole) == p.doc_tokens:
                made.append((p.doc_id, whole))
        assert sorted(made, key=repr) == sorted(((r.doc_id, ids(r.text)) for r in docs.collect()), key=repr)
    twice = packing.digests(packing.pack(odd.where("doc_id = 9 or doc_id is null"), queries.tokenizer_path())).collect()
    assert len([r for r in twice if r.doc_id == 9 and r.start == 0]) == 2 and any(r.doc_id is None for r in twice)


def test_encoder_cuts_where_the_tokenizer_does(spark, tmp_path):
    from tokenizers import Tokenizer

    own, encoder, r = Tokenizer.from_file(queries.tokenizer_path()), packing.WordEncoder(queries.tokenizer_path()), random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", "b c", "'s", "12", "é", "<|endoftext|>", "<|endof", "text|>", "\0", "-", "!?", "\x1c", "\x85", "　", "日本"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
    assert packing.power_lengths(2055, 1024) == [1024, 1024, 4, 2, 1]
    spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = np.array([64, 220, 50256, 275, 0], "<u4").tobytes()
    assert {(x.start, x.ids_crc32) for x in queries.op2_packing(spark, str(tmp_path)).collect()} == {(0, zlib.crc32(ids[:16])), (4, zlib.crc32(ids[16:]))}


# ------------------------------------------------------------------ personal data
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain_spans(t):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(d)))
        found += [(m.start(), 2, m.end())] * (14 <= len(d) <= 19 and total % 10 == 0)
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def test_base_spans_are_the_patterns_matches():
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("aB0129@@..-_+% ():\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_found_spans_stand_in_the_digests(spark, odd, none, corpus):
    assert pii.find(none).count() == 0
    assert pii.digests(pii.find(odd)).where("doc_id = 1").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    text = 'mail a.b@c.org or +1 (234) 567-8901, card 4994226020900891, host 10.0.0.255, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", order 1234567, on 2024-10-12'
    r = pii.digests(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and [x.split(":")[0] for x in r.spans.split(",")] == ["email", "phone", "card", "ip", "secret"]
    for d in pii.digests(pii.find(corpus)).join(corpus, "doc_id").collect():
        base = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in plain_spans(d.text))
        assert d.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_redaction_keeps_rows_and_columns(spark, odd, corpus):
    clean = pii.redact(corpus)
    assert clean.schema == corpus.schema and clean.count() == corpus.count()
    assert all(not plain_spans(r.text) and r.n_chars == len(r.text) for r in clean.collect())
    assert sorted(map(repr, pii.redact(odd).collect())) == sorted(map(repr, odd.collect()))


def test_secrets_need_no_digit_and_no_length():
    booster, threshold = pii.model()
    found = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b, _ in pii.spans_of([t], booster, threshold)[0]]
    assert found("the password: CorrectHorseBattery! was sent") == [("secret", "CorrectHorseBattery!")]
    assert found("a remark: nothing of note") == [] and (3, 6, 14) in pii.candidates("at fe:ab:cd:ef on")
    r = random.Random(8)
    key = "".join(r.choice("abcdefghijkLMNOPQRSTU0123456789") for _ in range(600))
    assert ("secret", key) in found(f"set token={key} here")
    assert pii.features(key, (0, 4, 600))[6] > 0.4 and pii.features("a" * 128 + key, (0, 4, 728))[8] == len(set("a" + key)) / 728


def test_time_grows_with_the_text():
    booster, threshold = pii.model()
    for text in ("1 " + "a," * 250_000, "1.2." * 250_000, "a=" * 400_000, "+1 " * 300_000, "x@" * 300_000, "key: abc1 " * 60_000, "<title>" * 100_000 + "1"):
        begun = time.perf_counter()
        pii.spans_of([text], booster, threshold)
        assert time.perf_counter() - begun < 30, text[:20]


def test_spans_without_digits_and_of_people():
    booster, threshold = pii.model()
    found = lambda t: {(pii.KINDS[k], t[a:b]) for a, k, b, _ in pii.spans_of([t], booster, threshold)[0]}
    assert ("secret", "abcdefghijklmnopqrstuv") in found("set token = abcdefghijklmnopqrstuv now")
    assert ("birth", "1984-11-23") in found("she was born on 1984-11-23 in a town")
    assert ("street", "12 Marker Street") in found("he lives at 12 Marker Street with others")
    assert not found("the token is important here") and not found("a plain sentence: nothing private in it at all, on page 12 of 2024")


def test_odd_rows_have_their_own_spans(odd):
    rows = pii.find(odd).collect()
    assert len(rows) == len(ODD) and all(not r.spans for r in rows)
    docs = odd.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" mail a.b@c.org")))
    rows = pii.find(docs).collect()
    for r in rows:
        (s,) = r.spans
        text = (dict(ODD)[r.doc_id] if r.doc_id != 9 else ODD[-2][1]) or ""
        assert (s.kind, s.start, s.end) == ("email", len(text) + 6, len(text) + 15)


def test_candidate_model_holds_on_held_out_spans():
    booster, threshold = pii.model()
    p, y = booster.held
    chosen = p >= threshold
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.95


# ------------------------------------------------------------------ quality
def test_weak_labels_find_junk(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs)
    told = quality.scores(docs, model).join(labels, "doc_id").toPandas()
    assert told[told.quality == 1].kept.mean() > 0.99 and told[told.quality == 0].kept.mean() < 0.1
    assert quality.keep_good(docs, model).count() == quality.scores(docs, model).where("kept").count()
    kept = {r.doc_id for r in quality.scores(odd, model).where("kept").collect()}
    assert {1, 2, 3, 4} <= kept
    assert quality.fit(none) is None and quality.scores(none, None).count() == 0 and quality.keep_good(none, None).count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns


def test_votes_read_the_whole_text():
    varied = [b"w%d" % k for k in range(400)]
    assert quality._variety(b"", varied) == quality.GOOD and quality._variety(b"", varied + [b"again"] * 20000) == quality.BAD
    words = [b"word" if k % 3 else b"word#" for k in range(4500)]  # a third is marked, all in step with a stride of 3
    assert quality._marked_words(b"", words) == quality.ABSTAIN


def test_sample_is_of_exact_size_and_has_each_row_once(spark):
    docs = spark.createDataFrame([(k % 500 if k < 900 else 7, f"text {k % 500 if k < 900 else 7}") for k in range(3000)], "doc_id long, text string")
    texts = [r.text for r in quality._drawn(docs, 3000, 40).collect()]
    assert len(texts) == len(set(texts)) == 40 and sorted(texts) == sorted(r.text for r in quality._drawn(docs.repartition(5), 3000, 40).collect())
    same = spark.createDataFrame([(1, "again")] * 2000, "doc_id long, text string")
    assert [r.text for r in quality._drawn(same, 2e9, 40).collect()] == ["again"]
    assert quality._shape(b"a" * 40 + b"9") == b"a0"


def test_silent_labellers_keep_all(spark, odd):
    few = odd.where("doc_id <= 4")
    model = quality.fit(few)
    assert quality.keep_good(few, model).count() == 4


def test_label_model_is_plain_expectation_maximisation():
    r = np.random.default_rng(3)
    patterns = r.integers(-1, 2, (40, 4))
    counts = r.integers(1, 50, 40).astype(float)
    model = quality.LabelModel().fit(patterns, counts, rounds=7)
    rows = [(p, n) for p, n in zip(patterns.tolist(), counts) if any(p)]
    seen = lambda weight, j, v: sum(w for (p, _), w in zip(rows, weight) if p[j] == v) + 0.5
    start = [[[c * seen([n for _, n in rows], j, v) for v, c in zip((-1, 0, 1), by)] for j in range(4)] for by in ((0.8, 1, 0.2), (0.2, 1, 0.8))]
    rates, prior = [[[x / sum(row) for x in row] for row in c] for c in start], 0.85
    for _ in range(7):
        good = []
        for p, _ in rows:
            bad_, good_ = (share * math.prod(rates[c][j][v + 1] for j, v in enumerate(p)) for c, share in ((0, 1 - prior), (1, prior)))
            good.append(good_ / (good_ + bad_))
        for c in (0, 1):
            weight = [n * (g if c else 1 - g) for (_, n), g in zip(rows, good)]
            rates[c] = [[seen(weight, j, v) / (sum(weight) + 1.5) for v in (-1, 0, 1)] for j in range(4)]
        prior = sum(n * g for (_, n), g in zip(rows, good)) / sum(n for _, n in rows)
    assert model.prior == pytest.approx(prior) and model.rates == pytest.approx(np.array(rates))


def test_scores_are_those_of_the_scorer(spark, corpus):
    model = quality.fit(corpus)
    buckets = quality.Buckets(len(model.scorer.weights))
    found = {r.doc_id: r for r in quality.scores(corpus, model).collect()}
    for d in corpus.limit(60).collect():
        words = d.text.encode().split()
        total = sum(model.scorer.weights[list(buckets[w])].sum() for w in words) + model.scorer.weights[quality.AGAIN] * sum(a == b for a, b in zip(words, words[1:]))
        m = model.scorer.bias + total / (len(words) + quality.PADDING)
        assert found[d.doc_id].score == pytest.approx(1 / (1 + math.exp(-m)), rel=1e-6)
        assert found[d.doc_id].kept == (not words or found[d.doc_id].score >= 0.5)


def test_label_model_learns_who_is_right():
    r = np.random.default_rng(1)
    good = r.random(4000) < 0.8
    votes = np.stack([np.where(r.random(4000) < p, np.where(good, 1, -1), np.where(good, -1, 1)) * (r.random(4000) < 0.8) for p in (0.95, 0.9, 0.85, 0.8)], 1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel().fit(rows, counts.astype(float))
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.93 and abs(model.prior - 0.8) < 0.05


def test_rule_statistics_are_counts(odd, none, corpus):
    for docs in (odd.where("doc_id is not null and doc_id != 9"), corpus):
        found = {r.doc_id: r for r in rules.judge(docs).collect()}
        for d in docs.collect():
            text, r = d.text or "", found[d.doc_id]
            words = WORD.findall(text)
            windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
            times = Counter(windows)
            again = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
            assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
            assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert rules.judge(none).count() == 0


def test_rule_verdicts_are_the_label_models(odd, corpus):
    for docs in (odd, corpus):
        rows = rules.judge(docs).collect()
        votes = np.array([[r[f"vote_{k}"] for k in rules.rules()] for r in rows])
        table, counts = np.unique(votes, axis=0, return_counts=True)
        model = quality.LabelModel().fit(table, counts.astype(float))
        assert [r.probability for r in rows] == pytest.approx(model.posterior(votes).tolist(), abs=1e-9)
        assert all(r.kept == (not r.base_failed and r.probability >= 0.5) for r in rows)
    found = rules.judge(odd).collect()
    assert len(found) == len(ODD) and len({(r.n_words, r.n_repeat_words, r.probability) for r in found if r.doc_id == 9}) == 1
    assert next(r for r in found if r.doc_id is None).n_words == 3


def test_rules_keep_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    told = rules.judge(docs).where("not base_failed").join(labels, "doc_id").toPandas()
    assert told[told.quality == 1].kept.mean() > 0.99 and told[told.quality == 0].kept.mean() < 0.1


# ------------------------------------------------------------------ near-duplicates
def plain_groups(rows):
    sets = []
    for _, text in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(w)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}
    return sorted((rows[k][0], len(sets[k]), least[group[k]]) for k in range(len(rows)))


def near_copies(seed, n=60):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 300)}" for _ in range(120)]
    rows = []
    for k in range(n):
        w = list(base[: r.choice([120, 120, 110, 90])])
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        rows.append((k, " ".join(w if k % 3 else [f"y{r.randint(0, 10**6)}" for _ in range(100)] + base[:60])))
    return rows


def test_groups_are_those_of_all_pairs(spark, odd, none):
    rows = [x for x in ODD if x[0] is not None]
    found = jaccard.groups(odd.where("doc_id is not null")).collect()
    assert sorted(map(tuple, found)) == plain_groups(rows)
    (r,) = jaccard.groups(odd).where("doc_id is null").collect()
    assert (r.n_shingles, r.component_id) == (1, None)
    assert jaccard.groups(none).count() == 0


@pytest.mark.parametrize("frequent", [1, 32])
def test_near_copies_lose_no_link(spark, frequent):
    rows = near_copies(frequent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.groups(docs, frequent=frequent)
    assert sorted(map(tuple, found.collect())) == plain_groups(rows)
    if frequent == 32:
        assert jaccard.keep_first(docs).count() == len({c for _, _, c in plain_groups(rows)})


def test_copies_without_an_id_cost_no_link(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join([*words[:99], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard.groups(docs).collect()) == [(0, None), (1, 1), (2, 1)]


def test_one_document_of_each_group_stays(spark):
    t = " ".join(f"w{k}" for k in range(60))
    near, other = t + " tail", " ".join(f"v{k}" for k in range(60))
    rows = [(1, t), (1, t), (2, t), (3, other), (3, other), (4, near), (2, other), (5, None), (5, ""), (None, t), (6, "Ab c"), (6, "aB C")]
    docs = spark.createDataFrame([(i, x, "y", 0) for i, x in rows], "doc_id long, text string, `a.b` string, node int")
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr)
    assert found == sorted([(1, t), (2, other), (5, ""), (6, "ab c"), (None, t)], key=repr)
    assert jaccard.keep_first(docs.limit(0)).count() == 0


def test_frequent_tokens_are_settled_where_they_are():
    r = np.random.default_rng(6)
    owner, token = np.divmod(np.unique(r.integers(0, 400, 150)), 20)
    place, leader = jaccard._settled(owner, token.astype(np.uint64))
    for k, t in enumerate(token):
        own = [o for o, x in zip(owner, token) if x == t]
        assert place[k] == own.index(owner[k]) and leader[k] == own[0]


def test_pairs_of_a_class_meet_in_similar_sets():
    """Any two sets at the threshold share a key, and keys are in proportion to the set."""
    r = np.random.default_rng(7)
    for n in (5, 12, 60, 400, 3000):
        for _ in range(30):
            both = r.integers(1, 1 << 62, -(-8 * n // 10)).astype(np.uint64)
            sizes = n, r.integers(len(both), len(both) * 5 // 4 + 1)
            sets = [np.unique(np.concatenate([both, r.integers(1, 1 << 62, max(0, m - len(both))).astype(np.uint64)])) for m in sizes]
            if 100 * len(both) < 80 * len(np.union1d(*sets)):
                continue
            keys = []
            for s in sets:
                own, b = set(), jaccard._bucket(len(s), 80)
                for k in (b, b + 1):
                    room = len(s) - jaccard._overlap(len(s), 80) + jaccard._classes(k, 80) + 1
                    own |= set(jaccard._pair_keys(s[:room], jaccard._classes(k, 80), k).tolist())
                assert len(own) < 8 * len(s) + 40
                keys.append(own)
            assert keys[0] & keys[1]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.vertex: r.component for r in components.components(edges).collect()}
    assert found == {k: 0 for k in range(31)} | {100: 100, 101: 100}


# ------------------------------------------------------------------ language model
def test_base_scores_count_every_token(spark, odd, none, corpus):
    small = dict(own=3, head=60, width=8, rounds=2, visits=3000, size=512)
    for docs in (odd, corpus.limit(80)):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
        held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
        seen = Counter(w for i, words in rows if not held[i] for w in words)
        n = sum(seen.values())
        wanted = []
        for i, words in rows:
            base = sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (len(seen) + 1))) for w in words)
            wanted.append((i or 0, held[i], len(words), sum(seen[w] > 0 for w in words), n, pytest.approx(base, rel=1e-9)))
        found = logbilinear.scores(docs, **small).collect()
        assert sorted((r.doc_id or 0, *r[1:6]) for r in found) == sorted(wanted, key=lambda r: r[:3])
        assert all(math.isfinite(r.score) and r.score < 0 for r in found)
        assert len({r.score for r in found if r.doc_id == 9}) <= 1
    assert logbilinear.scores(none, **small).count() == 0


def test_nothing_to_train_on_leaves_the_base(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (r,) = logbilinear.scores(spark.createDataFrame([(held, "a b c")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 4, 0, 0) and r.score == r.base_score


def test_model_beats_the_base_on_held_out_texts(corpus):
    total = logbilinear.scores(corpus, own=5).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > 0.98 * total[1]


def test_scores_are_those_of_the_parameters(spark, corpus):
    """Every token's probability summed over all units, without matrix products over classes."""
    small = dict(own=20, head=300, width=8, rounds=2, visits=40_000)
    docs = corpus.limit(60)
    model, _ = logbilinear.fit(docs, logbilinear.Store(spark, "test"), **small)
    p, net, units = model.net.parameters, model.net, dict(zip(model.words, model.places.tolist()))
    shapes = model.places[len(model.words) :]
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    seen = Counter(w for i, words in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in words)
    found = {r.doc_id: r.score for r in logbilinear.scores(docs, **small).collect()}
    for i, words in sorted(rows, key=lambda r: len(r[1]))[:25]:
        own = [int(units.get(w, shapes[logbilinear.shape(w)])) for w in words]
        total = 0.0
        for k, (w, u) in enumerate(zip(words, own)):
            one, two = own[k - 1] if k else net.many - 1, own[k - 2] if k > 1 else net.many - 1
            h = np.append(p["q"][one] @ p["c1"] + p["q"][two] @ p["c2"], 1).astype(float)
            by_class, within = np.exp(p["k"] @ h), np.exp(p["r"] @ h)
            total += math.log10(by_class[net.of[u]] / by_class.sum() * within[u] / within[net.of == net.of[u]].sum())
            if w not in units:
                total += math.log10((seen[w] + 0.5) / model.share[logbilinear.shape(w)])
        assert found[i] == pytest.approx(total, rel=1e-4)


def test_a_step_on_uneven_classes_is_not_filled_up(monkeypatch):
    """Memory of a step follows its rows, however many of them one class has; pieces give what whole classes give."""
    import tracemalloc

    start, r = logbilinear.LogBilinear(np.ones(10_000)), np.random.default_rng(1)
    rare = np.flatnonzero(start.of == 7)
    unit = np.concatenate([r.choice(rare, 8000), start.low[:-1]])
    context, weight, moved = r.integers(0, start.many**2, len(unit)), np.ones(len(unit), np.float32), []
    for piece in (logbilinear.PIECE, 10_000):
        monkeypatch.setattr(logbilinear, "PIECE", piece)
        net = start.copy()
        net.begin(64, 16, 0.08, 3)
        tracemalloc.start()
        net.step(context, unit, weight)
        moved.append((net.parameters, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    for k, x in start.parameters.items():
        assert np.allclose(moved[0][0][k], moved[1][0][k], atol=1e-4) and not np.array_equal(moved[0][0][k], x)
    assert moved[0][1] < 40_000_000 < moved[1][1]


def test_probabilities_add_up():
    net = logbilinear.LogBilinear(np.arange(40, 0, -1.0))
    for context in (0, 7, 41 * 41 - 1):
        assert np.exp(net.logs(np.full(40, context), np.arange(40))).sum() == pytest.approx(1, abs=1e-5)
    assert np.exp(net.logs(np.full(40, 40 * 41 + 40), np.arange(40))) == pytest.approx(net.mass, rel=0.5)


def test_training_goes_through_every_token(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randint(0, 40)}" for _ in range(50))) for k in range(100)], "doc_id long, text string")
    a, _ = logbilinear.fit(docs, logbilinear.Store(spark, "test"), own=1, visits=1)
    b, _ = logbilinear.fit(docs, logbilinear.Store(spark, "test"), own=1, visits=1)
    start = logbilinear.LogBilinear(a.net.mass)
    assert all((a.net.parameters[k] == b.net.parameters[k]).all() for k in a.net.parameters)  # training is repeatable
    used = a.places[: len(a.words)]
    end = a.places[a.words.index(b"")]
    assert all((a.net.parameters["q"][u] != start.parameters["q"][u]).any() for u in used if u != end)  # nothing follows an end
    assert (a.net.parameters["k"] != start.parameters["k"]).any(1).all()


def test_what_follows_a_word_is_learnt(spark):
    r = random.Random(4)
    pairs = [(f"left{k:03}", f"right{k:03}") for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(w for _ in range(40) for w in r.choice(pairs))) for k in range(300)], "doc_id long, text string")
    model, _ = logbilinear.fit(docs, logbilinear.Store(spark, "test"), own=50, visits=3_000_000, size=1024)
    units = dict(zip(model.words, model.places.tolist()))
    assert len(model.words) == 121
    context = units[b"right001"] * model.net.many + units[b"left007"]
    assert np.exp(model.net.logs(np.array([context]), np.array([units[b"right007"]])))[0] > 0.5


# ------------------------------------------------------------------ mixing
def test_rates_meet_the_targets(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rated = mixing.rates(docs, queries.domains_of(labels), queries.TARGETS).toPandas()
    p, n = np.stack(rated.posterior), rated.n_tokens.to_numpy()
    assert (rated.rate >= 0).all() and p.sum(1) == pytest.approx(np.ones(len(p)))
    assert (n * rated.rate.to_numpy()) @ p / n.sum() == pytest.approx(list(queries.TARGETS.values()), abs=1e-3)
    assert n.tolist() == [len(WORD.findall(t)) for t in docs.toPandas().set_index("doc_id").loc[rated.doc_id].text]
    mixed = mixing.mix(docs, queries.domains_of(labels), queries.TARGETS)
    assert mixed.columns == docs.columns and mixed.count() == rated.copies.sum()
    unlabelled = labels.select("doc_id", F.lit(None).cast("string").alias("domain"))
    assert {round(r.rate, 6) for r in mixing.rates(odd, unlabelled, {"a": 1.0, "b": 1.0}).collect()} == {1.0}
    assert mixing.rates(none, unlabelled, {"a": 1.0, "b": 1.0}).count() == 0 == mixing.mix(none, unlabelled, {"a": 1.0, "b": 1.0}).count()


def test_posteriors_and_rates_by_plain_python(spark, corpus):
    import xxhash

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    names = list(queries.TARGETS)
    domains = mixing.fit_domains(corpus, queries.domains_of(labels), names)
    docs = corpus.limit(40).collect()
    got = {r.doc_id: r for r in domains.posteriors(corpus, "doc_id").collect()}
    bucket = lambda w: (xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(w.encode(), 42) >= 1 << 63 else 0)) % domains.width
    for d in docs:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d.text.lower()))
        odds = [sum(float(f"{domains.odds[k][bucket(w)]:.6g}") for w in set(words)) for k in range(3)]
        z = [0.0, *(domains.shift[k] + domains.scale[k] * odds[k] for k in (1, 2))]
        e = [math.exp(x - max(z)) for x in z]
        assert got[d.doc_id].n_tokens == len(words) and [got[d.doc_id][f"p_{k}"] for k in range(3)] == pytest.approx([x / sum(e) for x in e], rel=1e-5, abs=1e-9)


@pytest.mark.parametrize("reachable", [True, False])
def test_rates_are_those_of_least_squares(spark, reachable):
    r = np.random.default_rng(4)
    p = r.dirichlet([0.4, 0.3, 0.3], 80) if reachable else np.stack([x := r.uniform(0.4, 0.6, 80), 1 - x, 0 * x], 1)
    n, targets = r.integers(1, 90, 80), [0.2, 0.5, 0.3] if reachable else [0.9, 0.06, 0.04]
    members = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_0 double, p_1 double, p_2 double")
    got = mixing.fit_rates(members, targets).column()
    rate = np.array([x.rate for x in members.select(got.alias("rate")).collect()])
    goal = np.array(targets) * n.sum()
    loss = lambda x: (((n * x) @ p - goal) ** 2).sum()
    plain, pace = np.ones(80), 1 / ((n * p.T) @ p).trace()
    for _ in range(20_000):
        plain = np.maximum(0, plain - pace * (p @ ((n * plain) @ p - goal)))
    assert (rate >= 0).all() and math.sqrt(loss(rate)) <= math.sqrt(loss(plain)) + 0.002 * n.sum()


def test_a_step_of_the_mix_costs_the_same_however_many_went_before(spark, monkeypatch):
    """While rates are fitted each step is computed once, from the rates before it; the result computes them once a row."""
    r = np.random.default_rng(4)
    p, n = np.stack([x := r.uniform(0.4, 0.6, 80), 1 - x], 1), r.integers(1, 90, 80)
    members = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_0 double, p_1 double")
    column, applied = mixing.Rates.column, []
    monkeypatch.setattr(mixing.Rates, "column", lambda self, *start: applied.append(len(self.steps)) or column(self, *start))
    fitted = mixing.fit_rates(members, [0.9, 0.1], plain=12)
    assert len(fitted.steps) > 4 and max(applied) <= 1
    whole = column(fitted)
    parts = column(mixing.Rates(fitted.steps[3:]), column(mixing.Rates(fitted.steps[:3])))
    want = np.ones(80)
    for step in fitted.steps:
        want = np.maximum(0, want - p @ step)
    got = members.select(whole.alias("a"), parts.alias("b")).toPandas()
    assert (got.a == got.b).all() and got.a.to_numpy() == pytest.approx(want, abs=1e-9)


def test_the_mix_computes_a_rate_once_a_row(spark, odd, capsys):
    told = spark.createDataFrame([(8, "a"), (9, "b"), (6, "b"), (5, "a")], "doc_id long, domain string")
    mixed = mixing.mix(odd, told, {"a": 0.3, "b": 0.7})
    capsys.readouterr()
    mixed.explain()
    assert capsys.readouterr().out.count("aggregate(") == 1


def test_mixing_odd_rows(spark, odd):
    told = spark.createDataFrame([(8, "a"), (9, "b"), (9, "a"), (6, "b"), (6, "b"), (99, "a"), (None, "a"), (5, "other")], "doc_id long, domain string")
    targets = {"a": 0.5, "b": 0.5}
    rated = mixing.rates(odd, told, targets).collect()
    assert len(rated) == len(ODD) and all(math.isfinite(r.rate) and r.rate >= 0 for r in rated) and len({r.rate for r in rated if r.doc_id == 9}) == 1
    clash = odd.withColumnRenamed("words", "a.b")
    mixed = mixing.mix(clash, told, targets)
    assert mixed.columns == clash.columns and mixed.count() == sum(r.copies for r in rated)


# ------------------------------------------------------------------ search, chat, WARC
def test_search_is_exact(spark):
    r = np.random.default_rng(2)
    codes = [r.integers(0, 256, 8, np.uint8).tobytes() for _ in range(150)]
    codes += [codes[0]] * 40 + [bytes([codes[1][0] ^ 1]) + codes[1][1:]] * 3
    rows = [(k, c, "x") for k, c in enumerate(codes)] + [(0, codes[0], "x"), (None, codes[0], "x"), (9999, None, "x"), (9998, b"12", "x")]
    index = spark.createDataFrame(rows, "id long, code binary, neighbor_id string")
    found = hamming.search(index, index.where("id % 10 = 0 or id = 9998"), k=7, shard_codes=50, block_queries=4)
    bits = [np.unpackbits(np.frombuffer(c, np.uint8)) for c in codes]
    wanted = []
    for q in range(0, len(codes), 10):
        best = sorted((int((bits[q] != b).sum()), k) for k, b in enumerate(bits) if k != q)[:7]
        wanted += [(q, k, d, n) for n, (d, k) in enumerate(best, 1)]
    assert sorted((x.query_id, x.neighbor_id, x.distance, x.rank) for x in found.collect()) == sorted(wanted)
    assert hamming.search(index.limit(0), index).count() == 0 == hamming.search(index, index.limit(0)).count()


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "ann", "Hi <|end|>"), (1, 2, None, None), (1, 2, "ann", "Bye"), (1, 600, "bob", "Late"), (None, 1, "cy", "x"), (None, 1, "cy", "x"), (2, 1, "system", "alone"), (3, None, "eve", "")]
    turns = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, part string")
    found = {(r.conv_id, r.part, r.speaker): r for r in chat.rotate(turns).collect()}
    assert set(found) == {(1, p, s) for p in (0, 1) for s in ("ann", "bob", "unknown")} | {(None, 0, "cy"), (3, -1, "eve")}
    ann = found[1, 0, "ann"]
    assert ann.text == "<|system|>\nBe brief.<|end|>\n<|assistant|>\nHi < |end|><|end|>\n<|assistant|>\nBye<|end|>\n<|user name=unknown|>\n<|end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in ann.mask.split(",")]
    assert [ann.text[a:b] for a, b in spans] == ["Hi < |end|><|end|>", "Bye<|end|>"] and (ann.n_turns, ann.n_own) == (4, 2)
    assert found[1, 0, "bob"].mask == "" and found[None, 0, "cy"].n_own == 2
    assert chat.rotate(turns.limit(0)).count() == 0


def test_rows_of_a_long_dialogue_are_one_text(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 1, None]), r.choice([None, 0, 1, 1, 2, 3, 7, 7, 7]), r.choice(["system", "ann", "bob", None]), r.choice(["a", "b <|", None, "ccc"])) for _ in range(120)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(x.conv_id, x.speaker): x for x in chat.rotate(turns.withColumn("turn", F.coalesce("turn", F.lit(-1)) * 0 + F.coalesce("turn", F.lit(-1)) + 1), span=1000).collect()}
    cut: dict = {}
    for x in sorted(chat.rotate(turns, span=2).collect(), key=lambda x: (x.part, x.piece)):
        got = cut.setdefault((x.conv_id, x.speaker), ["", []])
        assert x.start == len(got[0]) and x.n_turns <= 2
        got[1] += [(x.start + int(a), x.start + int(b)) for a, b in (m.split(":") for m in x.mask.split(",") if m)]
        got[0] += x.text
    assert len(whole) == 6 and all(cut[k][0] == x.text and ",".join(f"{a}:{b}" for a, b in cut[k][1]) == x.mask for k, x in whole.items())


PAGE = """<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><script>var t="</p>";</script><style>p{}</style></head>
<body><!-- <p>gone</p> --><h1>Head</h1><p>One <b>bold</b> word<br>next&nbsp;line</p><a href="/x?a=1&amp;b=2">link</a></body></html>"""


def test_derived_records_lead_to_their_source(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", PAGE, 0), (2, None, None, 0), (2, None, None, 0), (3, "http://c.example/", "<p" * 5000, 0)], "page_id long, url string, html string, block int")
    made = warc.derive_pages(pages).collect()
    assert sorted(map(repr, made)) == sorted(map(repr, warc.derivatives(warc.responses(pages)).collect())) and len(made) == 8
    about, text = sorted((r for r in made if r.page_id == 1), key=lambda r: r.record_type, reverse=True)
    assert text.block.decode() == "A & B\nHead\nOne bold word\nnext line\nlink"
    (source,) = warc.responses(pages.where("page_id = 1")).collect()
    assert about.refers_to == text.refers_to == source.record_id and text.target_uri == "http://a.example/"
    fields = about.block.decode()
    for said in (f"conversion-record-id: {text.record_id}", f"source-payload-digest: {source.source_payload_digest}", "title: A & B", "language: en", "outlink: /x?a=1&b=2", "source-http-header: Content-Type: text/html; charset=utf-8"):
        assert said in fields
    assert all(r.block_digest == warc.digest(r.block) and r.content_length == len(r.block) for r in made)
    assert next(r for r in made if r.page_id == 2 and r.record_type == "conversion").block == b""
    assert warc.derive_pages(pages.limit(0)).count() == 0

    rows = [source.asDict(), about.asDict(), text.asDict()]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(warc.serialise, rows)))
    read = warc.read(spark, str(tmp_path)).collect()
    assert [(r.record_id, bytes(r.block), r.refers_to, r.block_digest) for r in read] == [(r["record_id"], bytes(r["block"]), r["refers_to"], r["block_digest"]) for r in rows]


def test_other_bodies_are_other_records(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>b</p>"), (1, "u", "<p>b</p>")], "page_id long, url string, html string")
    made = warc.derive_pages(pages).collect()
    assert len({r.record_id for r in made}) == 4 and len({r.refers_to for r in made}) == 2


def test_plain_text_against_a_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template")
            self.out.append("\n" if tag in warc.BREAKS else "")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template") and self.hidden > 0
            self.out.append("\n" if tag in warc.BREAKS else "")

        def handle_data(self, data):
            self.out.append("" if self.hidden else data)

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(120).collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        lines = (" ".join(re.split("[ \t\r\f\v\xa0]+", x)).strip() for x in "".join(plain.out).split("\n"))
        assert warc.plain_text(r.html) == "\n".join(x for x in lines if x)


def test_unclosed_elements_take_linear_time():
    begun = time.perf_counter()
    for tag in ("<title>", "<a href", "<html ", "<meta ", "<script>", "<!--", "<p", "</"):
        warc.derive(warc.response(1, "u", tag * 60_000, "1970-01-01T00:00:00Z"))
    assert time.perf_counter() - begun < 60
    assert warc.title("<title>A</title><title>B</title>") == "A" and warc.title("<title>open") == ""


def test_large_files_are_streamed(spark, tmp_path):
    rows = [warc.response(k, f"http://x/{k}", "body " * (k % 7) * 1000, "1970-01-01T00:00:00Z") for k in range(600)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.serialise, rows)))
    import gzip

    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(warc.serialise(r)) for r in rows[:50]))
    found = sorted((r.record_id, bytes(r.block)) for r in warc.read(spark, str(tmp_path), whole=0).collect())
    assert found == sorted((r["record_id"], r["block"]) for r in rows + rows[:50])
    assert warc.read(spark, str(tmp_path), whole=1 << 30).count() == 650


def test_first_documents_keep_columns_of_any_name(spark):
    """Columns named like internals, in any case and of any type, come back as they were."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "h", 1.5, [1], "x"), (2, text, "h2", 2.5, [2], "y"), (2, text, "h2", 2.5, [2], "y"), (None, text, "h3", 3.5, [3], "z"), (4, None, "h4", 4.5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash string, _ID double, row array<int>, `a.hash` string")
    kept = jaccard.keep_first(docs)
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
    upper = docs.withColumnsRenamed({"_hash": "HASH", "_ID": "Id"})
    assert sorted(map(tuple, jaccard.keep_first(upper).collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
