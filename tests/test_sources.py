"""Files by path, the JSON sink, checked settings, and ingestion that can be run again."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from docengine.operators import pages
from docengine.sources import documents as src
from docengine.sources import files, ingestion, sink

MANIFEST = "pdf string, document_id string, company_name string, document_type string"


@pytest.fixture
def folder(tmp_path):
    for name in ("x", "y", "in"):
        (tmp_path / name).mkdir()
    (tmp_path / "x/a.pdf").write_text("The first of x.\fThe second of x.")
    (tmp_path / "y/a.pdf").write_text("The only page of y.")
    (tmp_path / "in/bad.pdf").write_bytes(b"\xff\xfe")
    return tmp_path


# ------------------------------------------------------------------ files
def test_files_of_one_base_name_stay_apart(spark, folder):
    manifest = spark.createDataFrame([("x/a.pdf", "X"), ("y/a.pdf", "Y"), (f"{folder}/x/a.pdf", "again")], "pdf string, document_id string")
    found, failed = src.parse_files(spark, manifest, str(folder))
    assert sorted((r.document_id, r.page_number, r.text[-2:]) for r in found.collect()) == [("X", 1, "x."), ("X", 2, "x."), ("Y", 1, "y."), ("again", 1, "x."), ("again", 2, "x.")]
    assert failed.isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "content" not in plan


def test_missing_files_folders_and_unreadable_ones_are_three_errors(spark, folder):
    manifest = spark.createDataFrame([("none.pdf", "N"), ("x", "D"), ("in/bad.pdf", "B"), ("y/a.pdf", "Y")], "pdf string, document_id string")
    found, failed = src.parse_files(spark, manifest, str(folder))
    assert {r.document_id for r in found.collect()} == {"Y"}
    errors = {r.document_id: r.error for r in failed.collect()}
    assert errors["N"].startswith("FileNotFoundError: no such file") and errors["D"].startswith("ValueError: not a file") and errors["B"].startswith("ValueError: ")
    for path, error in (("none.pdf", FileNotFoundError), ("x", ValueError), ("in/bad.pdf", ValueError)):
        with pytest.raises(error):
            src.parse_file(spark, f"{folder}/{path}", "D")
    assert src.parse_file(spark, f"{folder}/x/a.pdf", "D").count() == 2


def test_an_extractor_that_fails_midway_fails_its_file_alone(spark, folder):
    def fragile(content):
        yield "a page", 0
        if b"only" in content:
            raise RuntimeError("broken on page 2")

    manifest = spark.createDataFrame([("x/a.pdf", "X"), ("y/a.pdf", "Y")], "pdf string, document_id string")
    found, failed = src.parse_files(spark, manifest, str(folder), fragile)
    assert {r.document_id for r in found.collect()} == {"X"} and [r.error for r in failed.collect()] == ["ValueError: broken on page 2"]


def test_the_data_source_opens_the_files_of_its_manifest(spark, folder):
    listed = [{"pdf": p, "document_id": d, "company_name": "C", "document_type": "RHP"} for p, d in (("x/a.pdf", "X"), ("y/a.pdf", "Y"), ("none.pdf", "N"))]
    (folder / "m.json").write_text(json.dumps(listed))
    spark.dataSource.register(files.paged_files())
    found = spark.read.format("paged_files").option("folder", str(folder)).option("files_per_partition", 1).load(str(folder / "m.json"))
    assert found.rdd.getNumPartitions() == 3
    assert sorted((r.document_id, r.page_number or 0, r.error is None) for r in found.collect()) == [("N", 0, False), ("X", 1, True), ("X", 2, True), ("Y", 1, True)]


# ------------------------------------------------------------------ sink
def document(spark, *rows):
    return spark.createDataFrame([(d, "X Ltd", "RHP", f"{d}.pdf", n) for d, n in rows], "document_id string, company_name string, document_type string, source_file string, page_count int")


def measured(spark, *rows):
    blank = F.lit(None).cast("string")
    return pages.measure(spark.createDataFrame([(d, k, t, 0) for d, k, t in rows], "document_id string, page_number int, text string, image_count int")).withColumns({"section": blank, "subsection": blank})


def test_documents_are_files_of_their_name(spark, tmp_path):
    to = str(tmp_path / "out")
    own = measured(spark, ("D", 2, 'Second "page"\n₹'), ("D", 1, "First page."), ("E", 1, "Of E."))
    sink.save_pages(document(spark, ("D", 2), ("E", 1), ("F", 0)), own, to)
    assert sorted(os.listdir(to)) == ["D.json", "E.json", "F.json"]
    said = json.loads((tmp_path / "out/D.json").read_text())
    assert [p["text"] for p in said["pages"]] == ["First page.", 'Second "page"\n₹'] and list(said) == ["document_id", "company_name", "document_type", "source_file", "page_count", "pages"]
    assert (tmp_path / "out/D.json").read_text() == json.dumps(said, indent=2, ensure_ascii=False)
    assert json.loads((tmp_path / "out/F.json").read_text())["pages"] == []
    back = src.pages_of(src.read_documents(spark, f"{to}/*.json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, own.select(*back.columns).collect()))
    # one document is replaced, the others stay
    sink.save_documents(src.nest(document(spark, ("D", 1)), measured(spark, ("D", 1, "New."))), to)
    assert [p["text"] for p in json.loads((tmp_path / "out/D.json").read_text())["pages"]] == ["New."] and sorted(os.listdir(to)) == ["D.json", "E.json", "F.json"]
    sink.save_pages(document(spark, ("G", 0)), own, to, overwrite=True)
    assert sorted(os.listdir(to)) == ["G.json"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    to = str(tmp_path / "out")
    sink.save_pages(document(spark, ("D", 1)), measured(spark, ("D", 1, "Old.")), to)
    broken = measured(spark, ("D", 1, "New."), ("E", 1, "New.")).withColumn("text", F.when(F.col("document_id") == "E", F.raise_error(F.lit("lost"))).otherwise(F.col("text")).cast("string"))
    for docs, own in ((document(spark, ("D", 1), ("E", 1)), broken), (document(spark, ("a/b", 0), ("D", 1)), measured(spark, ("D", 1, "New.")))):
        with pytest.raises(Exception):
            sink.save_pages(docs, own, to)
        assert os.listdir(to) == ["D.json"] and json.loads((tmp_path / "out/D.json").read_text())["pages"][0]["text"] == "Old."


# ------------------------------------------------------------------ settings
@pytest.mark.parametrize("text,message", [
    ('{"pdf": "a", "document_id": "A", "company_name": "X", "document_type": "RHP"}', "list of objects"),
    ("[]", "list of objects"), ("[1]", "entry 1: must be an object"), ("not json", "no JSON"),
    ('[{"pdf": "a", "document_id": 5, "company_name": "X", "document_type": "RHP"}]', "entry 1: document_id must be text"),
    ('[{"pdf": "a", "document_id": "A", "company_name": "X", "document_type": "RHP"}, {"pdf": null, "document_id": "B", "company_name": ["X"], "document_type": "RHP"}]', "entry 2: company_name, pdf must be text"),
    ('[{"document_id": "A", "document_type": "RHP"}]', "entry 1: missing fields company_name, pdf"),
    ('[{"pdf": "a", "document_id": "A", "company_name": "X", "document_type": "rhp"}]', "entry 1: document_type must be one of"),
])
def test_manifests_are_typed(spark, tmp_path, text, message):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(ValueError, match=message):
        src.load_manifest(spark, str(tmp_path / "m.json"))


@pytest.mark.parametrize("text,message", [
    ("[]", "an object"), ('{"cases": {}}', "list of cases"), ('{"cases": []}', "list of cases"), ("{}", "list of cases"), ('{"cases": ["a"]}', "case 1: must be an object"),
    ('{"cases": [{"id": 1, "query": "q", "relevant_chunk_ids": ["a"]}]}', "case 1: invalid id"),
    ('{"cases": [{"id": "1", "query": "q", "relevant_chunk_ids": ["a"]}, {"id": "2", "query": 7, "relevant_chunk_ids": ["a"]}]}', "case 2: invalid query"),
    ('{"cases": [{"id": "1", "query": "q", "relevant_chunk_ids": [3]}]}', "case 1: invalid relevant_chunk_ids"),
    ('{"cases": [{"id": "1", "query": "q", "relevant_chunk_ids": []}]}', "case 1: invalid relevant_chunk_ids"),
    ('{"cases": [{"id": "1", "query": "q", "relevant_chunk_ids": ["a", null]}]}', "case 1: invalid relevant_chunk_ids"),
    ('{"cases": [{"id": "1", "query": "q", "relevant_chunk_ids": "a"}]}', "case 1: invalid relevant_chunk_ids"),
])
def test_gold_is_typed_where_it_is_strict(spark, tmp_path, text, message):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(ValueError, match=message):
        src.load_gold(spark, str(tmp_path / "g.json"))
    cases, gold = src.load_gold(spark, str(tmp_path / "g.json"), strict=False)
    assert cases.count() <= 2 and gold.count() <= 2


# ------------------------------------------------------------------ ingestion
def test_a_second_run_reads_what_failed_or_changed(spark, folder):
    log = folder / "log"
    log.mkdir()

    def logged(content):
        (log / f"{time.time_ns()}").write_bytes(content[:10])
        return files.form_feed_pages(content)

    manifest = spark.createDataFrame([("x/a.pdf", "X", "C", "RHP"), ("y/a.pdf", "Y", "C", "RHP"), ("in/bad.pdf", "B", "C", "RHP"), ("none.pdf", "N", "C", "RHP"), ("n.txt", "T", "C", "RHP")], MANIFEST)
    to = str(folder / "out")

    def run():
        before = len(os.listdir(log))
        try:
            result = src.ingest(spark, manifest, str(folder), to, logged)
        except RuntimeError as e:
            result = str(e)
        return result, len(os.listdir(log)) - before

    said, opened = run()
    assert said.startswith("3 of 5 documents failed: B: ") and "N: no such file" in said and "T: file must end with .pdf" in said and opened == 3
    assert sorted(n for n in os.listdir(to) if n[0] not in "._") == ["X.json", "Y.json"]
    said, opened = run()
    assert said.startswith("3 of 5") and opened == 1  # the unreadable file alone
    (folder / "in/bad.pdf").write_text("Now it can be read.")
    (folder / "y/a.pdf").write_text("Y has changed.")
    said, opened = run()
    assert said.startswith("2 of 5") and opened == 2
    assert json.loads((folder / "out/Y.json").read_text())["pages"][0]["text"] == "Y has changed."
    manifest = manifest.where("document_id in ('X', 'Y', 'B')")
    assert run() == ({"success": 3, "failure": 0}, 0)
    last = {r.document_id: r.status for r in ingestion.ledger(spark, to).collect()}
    assert last == {"X": "success", "Y": "success", "B": "success", "N": "failure", "T": "failure"}


def test_one_file_is_ingested_with_all_that_describes_it(spark, folder):
    whole = {"document_id": "X", "company_name": "C", "document_type": "RHP"}
    made = src.ingest_file(spark, f"{folder}/x/a.pdf", f"{folder}/out", **whole)
    assert made == f"{folder}/out/X.json" and json.loads(open(made).read())["page_count"] == 2
    with pytest.raises(ValueError, match="company_name, document_type"):
        src.ingest_file(spark, f"{folder}/x/a.pdf", f"{folder}/out", document_id="X")
    with pytest.raises(FileNotFoundError):
        src.ingest_file(spark, f"{folder}/none.pdf", f"{folder}/out", **whole)
    with pytest.raises(ValueError, match="must end with"):
        src.ingest_file(spark, str(folder / "x"), f"{folder}/out", **whole)
    with pytest.raises(ValueError):
        src.ingest_file(spark, f"{folder}/in/bad.pdf", f"{folder}/out", **whole)
