"""Fill-in-middle, the filter audit and language identification on small tables with every odd case, against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import audit, fim, langid
from docengine.llm.words import slices

#: Nulls, nothing, white space, marks, one word, line ends of all kinds, a very long text, repeated rows and ids.
ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, "word", "en"), (5, "a b c a b c\n\n\nx", "de"), (6, "one two\r\none two\n", "en"), (7, "long line\n" * 20000, "en"), (None, "no id here", "fr"),
    (8, "holds <S> a mark", "fr"), (9, "é😀\nzwölf <P\n>\n日本", "de"), (9, "é😀\nzwölf <P\n>\n日本", "de"), (9, "the id again\nwith another text", "de"), (10, "\n", "fr"), (11, "12 34 !?", "fr"),
    (12, "long line\n" * 20000, "fr"), (13, "no id here", None), (14, "SHOUTING " * 300, "en"), (15, "x" * 700 + "a", "en"), (16, "x" * 700 + "b", "en"), (17, "x" * 700 + "a", "en"),
]
SCHEMA = "doc_id long, text string, lang string, class int, length int, _salt string, stretch int, mask int, n int, output int, `a.b` int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 1, "s", 2, 3, 4, 5, 6) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_slices_keep_to_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 200, "c" * 40, "d" * 40, ""])], names=["k", "t"])
    assert [s.num_rows for s in slices([batch], 4, 100)] == [2, 1, 3] and [s.num_rows for s in slices([batch], 2, 10_000)] == [2, 2, 2]
    assert list(slices([batch.slice(0, 0)], 4, 100)) == []


# ------------------------------------------------------------------ fill-in-middle
PLAIN_UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+", "character": r"(?s)."}


@pytest.mark.parametrize("unit", fim.UNITS)
def test_checkpoints_find_every_cut(unit):
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a", "b c", "\n", "\n\n", " ", "é", "😀", "\t", "日本 "]) for _ in range(r.randrange(0, 60)))
        parts = re.findall(PLAIN_UNITS[unit], text)
        index = fim.Index(text.encode(), unit, r.choice([1, 2, 7, 32]))
        assert index.n == len(parts) and "".join(parts) == text
        for k in range(len(parts) + 1):
            assert index.cut(k) == (len("".join(parts[:k]).encode()), len("".join(parts[:k])))


def plain_fim(doc_id, text, unit, percent, spm, seed):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    parts = re.findall(PLAIN_UNITS[unit], text)
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= percent:
        return doc_id, len(parts), "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (doc_id, len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (doc_id, len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit,percent,spm,seed", [("line", 100, 50, 7), ("word", 60, 0, 1), ("character", 90, 100, 2)])
def test_parts_are_those_of_plain_code_and_give_the_text_back(odd, none, corpus, unit, percent, spm, seed):
    options = {"unit": unit, "percent": percent, "spm_percent": spm, "seed": seed}
    assert fim.transform(none, **options).count() == 0
    for docs in (odd, corpus):
        made = fim.transform(docs, **options).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted((tuple(r)[:6] for r in made), key=repr) == sorted((plain_fim(i, t, unit, percent, spm, seed) for i, t in texts), key=repr)
        assert sorted(((r["doc_id"], r["back"]) for r in made), key=repr) == sorted(((i, t or "") for i, t in texts), key=repr)


def test_fim_names_its_settings(odd):
    with pytest.raises(ValueError, match="unit"):
        fim.transform(odd, unit="page")
    with pytest.raises(ValueError, match="every"):
        fim.transform(odd, every=0)


# ------------------------------------------------------------------ audit
def plain_masks(rows):
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        late = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), late)
        out.append((doc_id, lang or "", sum(f << k for k, f in enumerate(fails))))
    return out


@pytest.mark.parametrize("bits", [64, 2, 1])
def test_failures_are_those_of_plain_code(odd, none, corpus, bits):
    """Few bits put different texts of one length into a class: the full comparison must tell them apart."""
    assert audit.failures(none, bits=bits).count() == 0
    for docs in (odd, corpus):
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
        found = [tuple(r) for r in audit.failures(docs, bits=bits).select("doc_id", "part", "mask").collect()]
        assert sorted(found, key=repr) == sorted(plain_masks(rows), key=repr)


def test_chance_classes_are_met(spark):
    """Texts of one length whose hashes of one bit agree are in one class, and stay apart by their texts."""
    rows = [(i, f"text {i % 20:02}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: bool(r["mask"] & 16) for r in audit.failures(docs, bits=1).collect()}
    assert found == {i: i >= 20 for i in range(60)}


def test_a_class_with_most_rows_is_marked(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    late = audit.failures(docs).where(F.col("mask").bitwiseAND(F.lit(16)) != 0)
    assert late.count() == docs.where("doc_id % 3 > 0").count() - 1


def test_every_order_and_step_counts_what_plain_code_counts(spark, odd, none, corpus):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (9, 0, 1), (9, 1, None), (12, None, 1), (17, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.failures(none), labels).count() == 0
    rows = plain_masks([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()])
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels.collect() if r["toxic"] == 1 and r["doc_id"] is not None}
    wanted, shapley = {}, {}
    for part in {p for _, p, _ in rows}:
        own = [(i, m) for i, p, m in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                fails = {k for k, (_, m) in enumerate(own) if m & bit}
                removed = fails - gone
                counts = [len(own) - len(gone | fails), len(removed), len(fails & gone), sum(own[k][1] == bit for k in fails), sum(own[k][0] in good for k in removed), sum(own[k][0] in toxic for k in removed)]
                wanted[part, order, step] = counts
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                gone |= fails
    found = {(r[0], r[1], r[2]): list(r)[3:] for r in audit.interactions(audit.failures(odd), labels).collect()}
    assert found == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in wanted.items()}
    assert len(found) == 600 * len({p for _, p, _ in rows})


# ------------------------------------------------------------------ language
def greedy(text, sample):
    """The number of phrases: each the longest prefix of what is left that the sample has, or one byte."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_parses_are_the_greedy_ones_of_plain_code():
    r = random.Random(11)
    make = lambda n, letters: bytes(r.choice(letters) for _ in range(n))
    samples = [make(300, b"ab "), make(500, b"abcd "), make(40, b"z")]
    languages = [langid.automaton(str(k), s) for k, s in enumerate(samples)]
    texts = [make(r.randrange(0, 90), b"abcdz e") for _ in range(60)] + [make(3 * langid.STRETCH + 5, b"abc ")]
    found = langid.phrases(texts, languages, [x.table() for x in languages])
    for t, row in zip(texts, found.tolist()):
        pieces = [t[at : at + langid.STRETCH] for at in range(0, len(t), langid.STRETCH)]
        assert row == [sum(greedy(p, s) for p in pieces) for s in samples]


def test_automaton_has_just_the_factors():
    sample = b"abracadabra abba"
    x = langid.automaton("x", sample)
    moves = {(s, c): t for s, c, t in x.edges.tolist()}
    have = set()

    def walk(state, said):
        have.add(said)
        for c in range(len(x.alphabet)):
            if (state, c) in moves:
                walk(moves[state, c], said + x.alphabet[c : c + 1])

    walk(0, b"")
    assert have == {sample[a:b] for a in range(len(sample) + 1) for b in range(a, len(sample) + 1)}
    assert x.states <= 2 * len(sample)


def test_odd_texts_have_their_defined_language(spark, odd, none):
    languages = langid.fit(odd)
    assert [x.name for x in languages] == ["de", "en", "fr"]
    found = langid.predict(odd, languages).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    texts = {i: t for i, t, _ in ODD if i != 9}
    for r in found:
        if r.doc_id in texts:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) and (r.lang_pred != "und" or r.score == 0)
    assert langid.fit(none) == [] and langid.fit(odd.where("lang is null")) == [] and langid.predict(none, languages).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, []).collect()} == {("und", 0.0)}
    only = langid.fit(odd.where("lang = 'de'"))
    assert {r.score for r in langid.predict(odd.where("doc_id = 4"), only).collect()} == {1.0}


def test_held_out_documents_are_told_apart(corpus):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (r[0] for r in corpus.select("doc_id").collect())}
    assert {r[0]: r[1] for r in corpus.select("doc_id", langid.held_out(F.col("doc_id"))).collect()} == held
    languages = langid.fit(corpus.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(corpus, languages).join(corpus, "doc_id").where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_a_passage_in_another_language_is_not_learned(spark):
    """All the English license that the French documents carry doesn't make English French."""
    r = random.Random(4)
    en, fr = ["the of and to in that with was his which her from".split(), "le la des une que dans pour qui est sur pas".split()]
    text = lambda words: "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(20))
    license_ = "the license of that which was with her and from his to in the that"
    rows = [(k, text(en), "en") for k in range(30)] + [(100 + k, text(fr) + "\n" + license_, "fr") for k in range(30)]
    languages = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, license_), (2, text(fr))], "doc_id long, text string")
    assert {x.doc_id: x.lang_pred for x in langid.predict(asked, languages).collect()} == {1: "en", 2: "fr"}


def test_samples_keep_to_their_bounds(corpus):
    languages = langid.fit(corpus, sample=5000, tables=1 << 20)
    assert all(x.size <= 5000 and x.states * (len(x.alphabet) + 1) * 4 <= (1 << 20) / len(languages) for x in languages)
    assert np.isclose(len(languages), 4)


# ------------------------------------------------------------------ what stays behind
def test_a_scope_deletes_the_tables_of_operators(spark):
    from pathlib import Path

    from docengine.llm.store import Store, scope

    kept = Store(spark, "kept")
    with scope():
        inner = Store(spark, "inner")
        found = kept.put(inner.put(spark.range(5), "a"), "b")
        there = Path(inner.root.replace("file://", "").replace("file:", ""))
        assert there.exists()
    assert not there.exists() and found.count() == 5


def test_a_document_can_be_taken_very_often(spark, monkeypatch):
    """Copies come in levels, all of them."""
    from docengine.llm import mixing

    docs = spark.createDataFrame([(k, "fine words " * 40) for k in range(50)] + [(99, "vile things")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "a") for k in range(50)] + [(99, "b")], "doc_id long, domain string")
    rated = mixing.rates(docs, labels, {"a": 0.2, "b": 0.8})
    for level in (4096, 3):
        monkeypatch.setattr(mixing, "LEVEL", level)
        assert mixing.mix(docs, labels, {"a": 0.2, "b": 0.8}).groupBy("doc_id").count().agg(F.sum("count")).first()[0] == rated.agg(F.sum("copies")).first()[0]


def test_repeated_ids_are_one_sample_row(spark):
    from docengine.llm import mixing

    docs = spark.createDataFrame([(k % 40, f"word{k % 40} " * 5 + ("vile" if k % 2 else "fine")) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(40)] * 2, "doc_id long, domain string")
    rated = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5})
    assert rated.count() > 0 and rated.columns == docs.columns
