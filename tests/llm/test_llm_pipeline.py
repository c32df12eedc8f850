"""The pipeline's stages, each on what the one before it kept, and the registered queries that have SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docengine.llm import jaccard, packing, pii, quality, queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, after = kept["quality"]
    assert after.count() == quality.scores(before, quality.fit(before)).where("kept").count() < before.count()
    before, after = kept["near_duplicates"]
    groups = jaccard.groups(before).toPandas()
    assert {r.doc_id for r in after.collect()} == set(groups.component_id)
    before, after = kept["pii"]
    assert after.count() == before.count() and pii.digests(pii.find(after)).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    before, after = kept["mixing"]
    assert after.select("doc_id").distinct().count() <= before.count() and after.count() > 0
    before, pieces = kept["packing"]
    assert pieces.count() == packing.pack(before, queries.tokenizer_path()).count()
    assert corpus_pipeline.run(spark, FOLDER).count() == pieces.count()


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, nothing, repeated rows, an empty table, and columns of any name: no stage fails, and rows without cause to go
    stay."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = " ".join(reversed(docs.where("lang = 'en' and n_chars > 400").orderBy("doc_id").first().text.split()))
    odd = [(None, "a text without an id", "en", "s", 1), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, clean, "en", "s", 18), (10**9 + 2, clean, "en", "s", 18), (10**9 + 3, "long words of a text " * 5000, "en", "s", 9)]
    mixed = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("a.b", F.lit(1)).withColumn("node", F.lit("x"))
    for k, table in enumerate((mixed, mixed.limit(0))):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, at, FOLDER).write.parquet(str(tmp_path / f"{name}{k}"))
            after = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if name != "packing":
                assert after.columns == at.columns
            if k == 0 and name == "near_duplicates":
                before, ids = ([r.doc_id for r in x.where(f"doc_id is null or doc_id >= {10**9}").collect()] for x in (at, after))
                assert before.count(10**9 + 2) == 2 and {10**9, 10**9 + 1} < set(before)
                assert len(ids) == len(set(ids)) and set(ids) == set(before)
            at = after
        assert (at.count() > 0) == (k == 0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found, wanted = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    value = lambda v: None if v is None or v != v else v.item() if isinstance(v, np.generic) else v
    plain = lambda df: sorted((tuple(map(value, r)) for r in df[columns].itertuples(index=False, name=None)), key=repr)
    assert plain(found) == plain(wanted)


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
