"""Operators on small inputs made up for them."""

import pytest
from pyspark.sql import functions as F

from docengine import expect
from docengine.functions import text as fn
from docengine.operators import dense, diagnostics, evaluate, hybrid, lexical, pages, sections
from docengine.sources import documents as src
from docengine.sources import query_sets
from docengine.schemas import CHUNK
from docengine.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, words", [("a b\tc\nd", 4), ("a\x1cb\x85c\xa0d　e f", 6), ("", 0), ("  ", 0)])
def test_white_space_is_unicodes(spark, text, words):
    assert one(spark, text, fn.word_count) == words


@pytest.mark.parametrize(
    "line, kind",
    [("", "blank"), ("(₹ in million)", "hdr"), ("Mar 31, 2024", "hdr"), ("2025", "hdr"), ("FY2024 2023-24", "hdr"), ("Notes", "hdr"), ("1,234 (5.0) -", "num"),
     ("Sales 1,234 5%", "row"), ("Sales 1,234", "text"), ("A sentence on sales.", "text"), ("Particulars of it all.", "text")],
)
def test_line_kinds(spark, line, kind):
    assert one(spark, line, fn.line_kind) == kind


@pytest.mark.parametrize("line, yes", [("INDUSTRY OVERVIEW", True), ("- RISK FACTORS -", True), ("CIN", False), ("Overview", False), ("GOODS", False), ("GOODSS", True), ("1. GENERAL", False), ("A, B", False)])
def test_upper_headings(spark, line, yes):
    assert one(spark, line, fn.is_upper_heading) is yes


def test_terms_have_pairs_of_neighbours(spark):
    assert one(spark, "The Fresh Issue of shares", fn.search_terms) == ["fresh", "issue", "shares", "fresh__issue", "issue__shares"]
    assert one(spark, "the of", fn.search_terms) == [] == one(spark, None, fn.search_terms)


def test_chunk_ids_grow_past_four_digits(spark):
    df = spark.createDataFrame([("D", 7), ("D", 12345)], "d string, i int")
    assert [r[0] for r in df.select(fn.chunk_id(F.col("d"), F.col("i"))).collect()] == ["D_chunk_0007", "D_chunk_12345"]


def test_pages_are_replaced_only_by_more_text(spark):
    native = pages.measure(spark.createDataFrame([("D", 1, "", 1), ("D", 2, "Many plain words stand on this page already.", 0), ("D", 3, "x", 1)], "document_id string, page_number int, text string, image_count int"))
    read = spark.createDataFrame([("D", 1, "A page that was read from its image in full"), ("D", 2, "Other words that are longer than those that were here before"), ("D", 3, "y")], "document_id string, page_number int, text string")
    found = {r.page_number: r for r in pages.merge_recognised(native, read).collect()}
    assert (found[1].extraction_method, found[1].quality_flag) == ("ocr", "normal")
    assert found[2].extraction_method == found[3].extraction_method == "pymupdf" and found[3].quality_flag == "suspicious"


def test_sections_are_carried_forward(spark):
    texts = ["SECTION I: GENERAL\nDEFINITIONS AND TERMS\nWords.", "More.", "SECTION II: - RISKS\n", "Section 3: Inner risks", "CONTENTS\nSECTION IX: NOT HERE", "Tail."]
    df = spark.createDataFrame([("D", k, t) for k, t in enumerate(texts, 1)], "document_id string, page_number int, text string")
    found = [(r.section, r.subsection) for r in sections.detect(df).orderBy("page_number").collect()]
    assert found == [("GENERAL", "DEFINITIONS AND TERMS")] * 2 + [("RISKS", None)] + [("RISKS", "Inner risks")] * 3


def test_lexical_search(spark):
    chunks = spark.createDataFrame([("c1", 0, "Total assets are large."), ("c2", 1, "The fresh issue is of new shares."), ("c3", 2, "Words on people.")], "chunk_id string, position int, content string")
    asked = spark.createDataFrame([("q", "Fresh Issue"), ("none", "the of")], "query_id string, query string")
    (r,) = lexical.search(chunks, asked).collect()
    assert (r.query_id, r.chunk_id, r.rank) == ("q", "c2", 1) and r.score > 0
    for k1, b in ((0, 0.5), (1, 2)):
        with pytest.raises(ValueError):
            lexical.search(chunks, asked, k1=k1, b=b)


def test_dense_search_ranks_and_hydrates(spark):
    index = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.6, 0.8]), ("c", 2, [0.6, 0.8])], "id string, position long, embedding array<float>")
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<float>")
    found = dense.search(index, asked, 2)
    assert [(r.rank, r.id, r.score) for r in found.orderBy("rank").collect()] == [(1, "b", 0.8), (2, "c", 0.8)]
    chunks = spark.createDataFrame([("b", "B")], "chunk_id string, content string")
    with pytest.raises(KeyError, match="unknown chunk_id: c"):
        dense.hydrate(found, chunks)
    with pytest.raises(ValueError):
        dense.append(index, spark.createDataFrame([("d", 3, [1.0])], index.schema), 2)


def test_fusion_prefers_what_both_arms_have(spark):
    arm = lambda rows: spark.createDataFrame([("q", k, c, p) for k, (c, p) in enumerate(rows, 1)], "query_id string, rank int, chunk_id string, position int")
    fused = hybrid.fuse([arm([("c2", 1), ("c3", 2), ("c1", 0)]), arm([("c1", 0)])], 2).orderBy("rank").collect()
    assert [r.chunk_id for r in fused] == ["c1", "c2"] and fused[0].score == pytest.approx(1 / 63 + 1 / 61)
    with pytest.raises(ValueError):
        hybrid.check_parameters(0, 1)


def test_metrics_are_hit_rates(spark):
    cases = spark.createDataFrame([("x",), ("y",)], "case_id string")
    ranks = spark.createDataFrame([("x", k, c) for k, c in enumerate("abcd", 1)] + [("y", k, c) for k, c in enumerate("abz", 1)], "case_id string, rank int, chunk_id string")
    gold = spark.createDataFrame([("x", "b"), ("x", "d"), ("y", "z")], "case_id string, chunk_id string")
    assert {r.metric: r.value for r in evaluate.evaluate(cases, ranks, gold).collect()} == {"Recall@1": 0, "Recall@3": 1, "Recall@5": 1, "Recall@10": 1, "MRR": pytest.approx((1 / 2 + 1 / 3) / 2, abs=1e-6)}
    with pytest.raises(ValueError):
        evaluate.evaluate(cases.limit(0), ranks, gold)
    with pytest.raises(KeyError):
        evaluate.evaluate(cases, ranks.where("case_id = 'x'"), gold)


def test_arguments_are_checked(spark):
    for bad, error in ((True, TypeError), ("3", TypeError), (0, ValueError)):
        with pytest.raises(error):
            expect.top_k(bad)
    with pytest.raises(ValueError, match="query must not be empty"):
        expect.query_text("  ")
    with pytest.raises(ValueError, match="Duplicate chunk_id: c1"):
        expect.unique(spark.createDataFrame([("c1",), ("c1",)], "chunk_id string"), "chunk_id")


def test_documents_make_the_round_trip(spark, tmp_path):
    blank = F.lit(None).cast("string")
    own = pages.measure(spark.createDataFrame([("D", 2, "Second page.", 0), ("D", 1, "First page.", 0)], "document_id string, page_number int, text string, image_count int")).withColumns({"section": blank, "subsection": blank})
    docs = spark.createDataFrame([("D", "X Ltd", "RHP", "x.pdf", 2)], "document_id string, company_name string, document_type string, source_file string, page_count int")
    src.save_documents(src.nest(docs, own), str(tmp_path / "out"))
    read = src.pages_of(src.read_documents(spark, str(tmp_path / "out/*.json")))
    assert [(r.page_number, r.text) for r in read.collect()] == [(1, "First page."), (2, "Second page.")]


def test_manifest_and_gold_are_checked(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good = file("m.json", '[{"pdf": "a.txt", "document_id": "A", "company_name": "X", "document_type": "RHP"}]')
    assert src.load_manifest(spark, good).count() == 1
    with pytest.raises(ValueError, match="entry 2: missing fields company_name, pdf"):
        src.load_manifest(spark, file("n.json", '[{"pdf": "a", "document_id": "A", "company_name": "X", "document_type": "RHP"}, {"document_id": "B", "document_type": "RHP"}]'))
    with pytest.raises(ValueError, match="entry 1: document_type"):
        src.load_manifest(spark, file("o.json", '[{"pdf": "a", "document_id": "A", "company_name": "X", "document_type": "Y"}]'))
    with pytest.raises(FileNotFoundError):
        src.load_manifest(spark, str(tmp_path / "none.json"))
    cases, gold = src.load_gold(spark, file("g.json", '{"document_id": "D", "cases": [{"id": "1", "query": "q", "relevant_chunk_ids": ["a", "b"]}]}'))
    assert cases.count() == 1 and gold.count() == 2
    with pytest.raises(ValueError, match="invalid query"):
        src.load_gold(spark, file("h.json", '{"cases": [{"id": "1", "query": " ", "relevant_chunk_ids": ["a"]}]}'))


def test_files_are_parsed_and_recognised(spark, tmp_path):
    (tmp_path / "a.txt").write_text("The first page holds a good many plain words.\f \fThird page, also with a number of words.")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    manifest = spark.createDataFrame([("a.txt", "A"), ("b.txt", "B"), ("c.txt", "C")], "pdf string, document_id string")
    found, failed = src.parse_files(spark, manifest, str(tmp_path))
    assert found.count() == 3 and {r.document_id for r in failed.collect()} == {"B", "C"}
    read = src.recognise(spark, found, manifest, str(tmp_path), lambda content, n: f"Words of page {n} as they were recognised in the image.")
    assert [(r.document_id, r.page_number) for r in read.collect()] == [("A", 2)]
    merged = pages.merge_recognised(found, read)
    assert merged.where("extraction_method = 'ocr'").count() == 1 and pages.summary(merged).first().suspicious_pages == 0


def test_encoder_and_diagnostics(spark, tmp_path):
    encode = src.hashed_encoder(64)
    chunks = spark.createDataFrame([("c1", 0, "fresh issue of shares", 1, 1), ("c2", 1, "total assets at the end", 2, 2)], "chunk_id string, position long, content string, page_start int, page_end int")
    vectors = encode(chunks, "content").select(F.col("chunk_id").alias("id"), "position", "embedding")
    src.save_vectors(vectors, str(tmp_path / "v"))
    index = src.load_vectors(spark, str(tmp_path / "v"))
    with pytest.raises(FileNotFoundError):
        src.load_vectors(spark, str(tmp_path / "w"))
    gold = spark.createDataFrame([("k", "c1")], "case_id string, chunk_id string")
    asked = spark.createDataFrame([("k", "k1", "the fresh issue"), ("k", "k2", "nothing of it")], "case_id string, query_id string, query string")
    assert {r.query_id: r.best_rank for r in diagnostics.wording(index, asked, gold, encode, 1).collect()}["k1"] == 1
    audit = diagnostics.truncation_audit(chunks, gold, chunks.where("chunk_id = 'c2'"), ["assets", "gold"]).orderBy("chunk_id").collect()
    assert [r.keywords for r in audit] == [{}, {"assets": 6}]
    near = diagnostics.evidence_locality(spark.createDataFrame([("fresh issue", "fresh issue", 0)], "query string, content string, at int"), encode).first()
    assert near.chunk_score == near.snippet_score == pytest.approx(1, abs=1e-5)
    first = evaluate.first_relevant_rank(gold.select("case_id"), spark.createDataFrame([("k", 1, "c1")], "case_id string, rank int, chunk_id string"), gold)
    src.write_report(evaluate.metrics(first), evaluate.case_report(first), str(tmp_path / "r"), top_k=10)
    assert spark.read.json(str(tmp_path / "r")).first().num_cases == 1


def test_retrieval_checks_its_arguments(spark):
    chunks = spark.createDataFrame([("c1", 0, "Total assets are large."), ("c2", 1, "The fresh issue is of new shares.")], "chunk_id string, position int, content string")
    asked = spark.createDataFrame([("q", "Fresh Issue", [1.0, 0.0])], "query_id string, query string, embedding array<float>")
    index = spark.createDataFrame([("c1", 0, [1.0, 0.0]), ("c2", 1, [0.0, 1.0])], "id string, position long, embedding array<float>")
    for bad, error in ((True, TypeError), ("3", TypeError), (0, ValueError)):
        for search in (lambda k: lexical.search(chunks, asked, k), lambda k: dense.search(index, asked, k), lambda k: hybrid.search(index, chunks, asked, k)):
            with pytest.raises(error):
                search(bad)
    with pytest.raises(ValueError, match="query must not be empty"):
        lexical.search(chunks, asked.withColumn("query", F.lit("  ")))
    for cells in (0, 100):
        with pytest.raises(ValueError, match="empty lexical index"):
            lexical.search(chunks.limit(0), asked, cells=cells).collect()
    with pytest.raises(ValueError, match="empty vector index"):
        dense.search(index.limit(0), asked)
    with pytest.raises(ValueError, match="must have 2 numbers"):
        dense.search(index, spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<float>"))
    with pytest.raises(ValueError, match="mismatch"):
        dense.require_same_size(index, chunks.limit(1))
    with pytest.raises(ValueError, match="the lexical side has 1"):
        hybrid.search(index, chunks, asked, lexical_chunks=chunks.limit(1))
    found = hybrid.search(index, chunks, asked, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == ["c2", "c1"] and dense.size(index) == 2


def test_both_ways_of_lexical_search_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"))
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    by_batch, by_term = (sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 5)) for r in lexical.search(chunks, asked, cells=n).collect()) for n in (1 << 23, 0))
    assert by_batch == by_term and len(by_batch) > 100


def test_texts_are_found_as_they_stand(spark):
    docs = spark.createDataFrame([(1, "before one two three four five six seven after"), (2, "xone two three four five six sevenx"), (3, "one two  three four five six seven"), (4, "tiny text"), (5, None)], "chunk_id long, text string")
    cases = spark.createDataFrame([(1, "one two three four five six seven"), (2, "tiny"), (3, "nothing of all this is said in any document")], "case_id long, text string")
    for sought in (1 << 20, 30, 3):
        assert sorted(map(tuple, evaluate.holding(docs, cases, sought=sought).collect())) == [(1, 1), (1, 2), (2, 4)]
    odd = spark.createDataFrame([(4, ""), (5, None), (6, "tiny"), (7, "tiny text")], "case_id long, text string")
    for sought in (1 << 20, 3):
        assert sorted(map(tuple, evaluate.holding(docs, odd, sought=sought).collect())) == [(4, 1), (4, 2), (4, 3), (4, 4), (6, 4), (7, 4)]


def test_gold_belongs_to_the_document(spark):
    gold, chunks = spark.createDataFrame([("k", "c1"), ("k", "c9")], "case_id string, chunk_id string"), spark.createDataFrame([("c1", 1, 2, "S", None, "Words\nof it")], "chunk_id string, page_start int, page_end int, section string, subsection string, content string")
    with pytest.raises(ValueError, match="does not match"):
        evaluate.check_gold("X", "D", gold, chunks)
    with pytest.raises(ValueError, match="c9"):
        evaluate.check_gold("D", "D", gold, chunks)
    ranked = spark.createDataFrame([("k", 1, "c1", 0.5)], "case_id string, rank int, chunk_id string, score double")
    assert evaluate.shown(ranked, chunks, gold).first().line == "1. score=0.5000 c1 GOLD pages 1-2 | S | - | Words of it"


def test_ingest_writes_what_it_can(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"\xff\xfe" if name[0] == "b" else b"SECTION I: GENERAL\nSome plain words stand here.\fA second page of words.")
    rows = [(n, n[0].upper(), "X Ltd", "RHP") for n in ("a.pdf", "b.pdf", "c.txt")]
    manifest = spark.createDataFrame(rows, "pdf string, document_id string, company_name string, document_type string")
    with pytest.raises(RuntimeError, match="2 of 3 documents failed: B: .*; C: file must end with .pdf"):
        src.ingest(spark, manifest, str(tmp_path / "in"), str(tmp_path / "out"), suffix=".pdf")
    (d,) = src.read_documents(spark, str(tmp_path / "out/*.json")).collect()
    assert (d.document_id, d.page_count, d.pages[1].section) == ("A", 2, "GENERAL")
    assert src.ingest(spark, manifest.limit(1), str(tmp_path / "in"), str(tmp_path / "out")) == {"success": 1, "failure": 0}
    page = src.recognise_page(spark, manifest, str(tmp_path / "in"), "A", 2, lambda content, n: f"Page {n} was read from its image by a machine.").first()
    assert (page.page_number, page.extraction_method, page.quality_flag) == (2, "ocr", "normal")
    for bad, error in ((0, ValueError), (3, ValueError), (True, TypeError)):
        with pytest.raises(error):
            src.recognise_page(spark, manifest, str(tmp_path / "in"), "A", bad, lambda content, n: "")
    with pytest.raises(FileNotFoundError):
        src.recognise_page(spark, manifest, str(tmp_path / "in"), "Z", 1, lambda content, n: "")


def test_reports_have_both_blocks(spark, tmp_path):
    first = spark.createDataFrame([("k", 1), ("l", None)], "case_id string, first_rank int")
    pair = evaluate.metrics(first), evaluate.case_report(first)
    src.write_comparison(pair, pair, str(tmp_path / "c"), document_id="D", document_name="X", gold="g.json", parameters={"top_k": 10, "candidate_k": 50, "rrf_k": 60}, dataset={"chunks": 2})
    r = spark.read.json(str(tmp_path / "c")).first()
    assert (r.parameters.rrf_k, r.dataset.chunks, r.dense.num_cases, r.hybrid.metrics["Recall@1"]) == (60, 2, 2, 0.5)
    src.write_dense_report(*pair, str(tmp_path / "d"), document_id="D", document_name="X", top_k=10)
    assert spark.read.json(str(tmp_path / "d")).first().top_k_requested == 10
    assert query_sets.questions(spark).count() == 7 and query_sets.questions(spark, dense=True).count() == 5 and query_sets.paraphrases(spark).count() == 12


def test_stream_chunks_what_arrives(spark, tmp_path):
    blank = F.lit(None).cast("string")
    own = pages.measure(spark.createDataFrame([("D", 1, "SECTION I: GENERAL\nSome plain words.", 0)], "document_id string, page_number int, text string, image_count int"))
    own.withColumns({"section": blank, "subsection": blank}).select(*[c.split()[0] for c in ingest.PAGE.split(", ")]).write.parquet(str(tmp_path / "in"))
    q = ingest.chunk_stream(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    (c,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert c.section == "GENERAL" and "Some plain words." in c.content


def test_pages_may_come_in_any_order_and_batch(spark, tmp_path):
    """However the pages of documents are split over files, late and repeated ones included, the chunks are those of one batch."""
    import random

    from docengine.operators import chunk, sections

    r = random.Random(6)
    blank = F.lit(None).cast("string")
    counts = {"A": 5, "B": 1, "C": 7, "late": 3}
    rows = [(d, k, f"SECTION {'IVX'[k % 3]}: PART {k // 2}\nWords of page {k} of {d} stand here and there.\nMore of them follow.", 0, n) for d, n in counts.items() for k in range(1, n + 1)]
    own = pages.measure(spark.createDataFrame(rows, "document_id string, page_number int, text string, image_count int, page_count int")).withColumns({"section": blank, "subsection": blank}).select(*ingest.FIELDS, "page_count")
    wanted = sorted(map(repr, chunk.chunk_documents(sections.detect(own.drop("page_count"))).collect()))
    keys = [(d, k) for d, k, *_ in rows]
    r.shuffle(keys)
    keys = [k for k in keys if k != ("late", 2)]
    keys[3:3] = keys[:2]  # pages that come twice

    def drop(part):
        chosen = own.where(F.struct("document_id", "page_number").isin([F.struct(F.lit(d), F.lit(k)) for d, k in part]))
        chosen.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = ingest.page_stream(spark, str(tmp_path / "in"), files_per_trigger=1, counted=True)
        ingest.chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(200)
        return sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).drop("batch").select(*[c.split()[0] for c in CHUNK.split(", ")]).collect()))

    for at in range(0, len(keys), 3):
        drop(keys[at : at + 3])
    assert run() == [x for x in wanted if "document_id='late'" not in x]
    drop([("late", 2)])
    assert run() == wanted
