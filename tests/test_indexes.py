"""Stored indexes give what a full scan gives, read less, and are safe to append to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import dense, lexical, lexical_index, vector_index
from docengine.operators.lexical_index import LexicalIndex
from docengine.operators.vector_index import VectorIndex

FOLDER = "/root/testdata/sf0.001"
RANKED = ["query_id", "rank", "chunk_id", "position", "score"]


def rows(df, *columns):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"), F.col("lang").alias("section"))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@pytest.fixture(scope="module")
def stored(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lexical"))
    index = LexicalIndex.build(chunks.where("position % 4 > 0"), path, slots=8)
    return index.append(chunks.where("position % 4 = 0 and position < 100")).append(chunks.where("position % 4 = 0 and position >= 100"))


@pytest.mark.parametrize("block,held,carried", [(128, 4_000_000, 1 << 20), (8, 4_000_000, 1 << 20), (8, 3000, 0)])
def test_search_of_the_index_is_search_of_all_chunks(spark, chunks, asked, tmp_path, monkeypatch, block, held, carried):
    """With small blocks, with tasks that make blocks several times, and where queries meet blocks in joins."""
    for name, value in (("BLOCK", block), ("HELD", held), ("CARRIED", carried)):
        monkeypatch.setattr(lexical_index, name, value)
    index = LexicalIndex.build(chunks.where("position % 3 > 0"), str(tmp_path / "i"), slots=4).append(chunks.where("position % 3 = 0"))
    assert index.size == chunks.count()
    few = asked.where("query_id < 12") if carried == 0 else asked
    for k, parameters in ((10, {}), (1, {"k1": 0.5, "b": 0.0}), (300, {"b": 1.0})):
        assert rows(index.search(few, k, **parameters), *RANKED) == rows(lexical.search(chunks, few, k, **parameters), *RANKED)


def test_blocks_that_can_not_matter_are_not_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 4)
    monkeypatch.setattr(lexical_index, "FIRST", 1)
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.col("id").alias("position"), F.concat(F.lit("common "), F.when(F.col("id") % 100 == 7, "rare rare ").otherwise(""), F.repeat(F.lit("word "), (F.col("id") % 50).cast("int"))).alias("content"))
    asked = spark.createDataFrame([("q", "rare common")], "query_id string, query string")
    index = LexicalIndex.build(chunks, str(tmp_path / "i"))
    _, scored = index.reached(asked, 3)
    weights, postings, _ = index.weights(asked)
    assert scored.count() < 0.3 * index.bounds(weights, postings).count()
    assert rows(index.search(asked, 3), *RANKED) == rows(lexical.search(chunks, asked, 3), *RANKED)


def test_a_search_opens_the_slots_of_its_terms(stored, spark):
    one = spark.createDataFrame([("q", "total")], "query_id string, query string")
    plan = stored.weights(one)[1]._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")
    assert "slot" in filters[0] and "term" in filters[1] and "total" in filters[1]
    assert "places" not in stored.weights(one)[1].groupBy("term").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_rows_of_an_index_hold_many_terms(stored, chunks, spark):
    """A build shuffles, sorts and writes far fewer rows than there are terms; a count of terms reads no postings."""
    rows_, terms = stored.rows().where("slot >= 0"), lexical.term_stats(lexical.doc_terms(chunks)).count()
    assert 0 < rows_.count() < terms / 10
    one = spark.createDataFrame([("q", "total")], "query_id string, query string")
    plan = stored.weights(one)[1].groupBy("term").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan.split("ReadSchema")[1] and "_word,total)" in plan


@pytest.mark.parametrize("run,sought", [(256, 0), (2, 32)])
def test_words_of_odd_texts_are_those_of_a_scan(spark, tmp_path, monkeypatch, run, sought):
    """Words end with their text, pairs sort between words and digits, other alphabets and nulls have no words."""
    for name, value in (("RUN", run), ("SOUGHT", sought), ("BLOCK", 4), ("HELD", 40)):
        monkeypatch.setattr(lexical_index, name, value)
    texts = ["ab a1 a b", "a b ab", None, "", "\u212a \u0130x ÄB straße-x9", "x9", "9x x9 9x the x9 9x", "ΩΩ \n", "a" * 5000 + " b", "b a", "a9 a__b a", "A B"]
    chunks = spark.createDataFrame([(k, 20 - k, t) for k, t in enumerate(texts)], "chunk_id int, position int, content string").coalesce(2)
    asked = spark.createDataFrame(list(enumerate(["a b", "ab a1", "k", "9x x9 x", "a9 b a", "i x", "stra e", "a" * 5000, "absent"])), "query_id int, query string")
    index = LexicalIndex.build(chunks.where("chunk_id % 3 > 0"), str(tmp_path / "i"), slots=3).append(chunks.where("chunk_id % 3 = 0"))
    expected = rows(lexical.search(chunks, asked), *RANKED)
    assert rows(index.search(asked), *RANKED) == expected and len({r[0] for r in expected}) == 8


def test_an_index_is_checked_and_committed(spark, stored, chunks, asked):
    again = LexicalIndex.open(spark, stored.path)
    assert again.size == chunks.count() and again.version == 3 and len(again.segments) == 3
    assert rows(again.search(asked), *RANKED) == rows(lexical.search(chunks, asked), *RANKED)
    with pytest.raises(ValueError, match="Duplicate chunk_id"):
        stored.append(chunks.where("position = 5"))
    with pytest.raises(ValueError, match="Duplicate chunk_id"):
        stored.append(chunks.where("position = 5").withColumn("chunk_id", F.lit("new")).union(chunks.where("position = 6").withColumn("chunk_id", F.lit("new"))))
    with pytest.raises(FileExistsError):
        LexicalIndex.build(chunks, stored.path)
    with pytest.raises(FileNotFoundError):
        LexicalIndex.open(spark, stored.path + "/none")
    extra = chunks.where("position = 5").withColumn("chunk_id", F.lit("extra"))
    old = LexicalIndex(spark, stored.path, 2, stored.slots, stored.id_type, stored.segments[:2])
    with pytest.raises(FileExistsError):  # another append came first
        old.append(extra)
    assert LexicalIndex.open(spark, stored.path).size == chunks.count()
    for bad, error in ((0, ValueError), (True, TypeError)):
        with pytest.raises(error):
            stored.search(asked, bad)
    with pytest.raises(ValueError, match="must not be empty"):
        stored.search(asked.withColumn("query", F.lit(" ")))
    assert stored.search(asked.withColumn("query", F.lit("the of"))).count() == 0


def test_an_empty_index_can_be_appended_to(spark, chunks, asked, tmp_path):
    index = LexicalIndex.build(chunks.limit(0), str(tmp_path / "i"))
    assert index.size == 0
    with pytest.raises(ValueError, match="empty"):
        index.search(asked)
    assert rows(index.append(chunks).search(asked), *RANKED) == rows(lexical.search(chunks, asked), *RANKED)


# ------------------------------------------------------------------ vectors
VECTOR = ["query_id", "rank", "id", "position", "score"]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("position"), "embedding")


@pytest.mark.parametrize("cells", [None, 1, 7, 400])
def test_search_of_cells_is_search_of_all_vectors(spark, vectors, tmp_path, cells):
    asked = vectors.where("id % 9 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = VectorIndex.build(vectors.where("id % 4 > 0"), str(tmp_path / "v"), cells=cells).append(vectors.where("id % 4 = 0"))
    index = VectorIndex.open(spark, index.path)
    assert index.size == vectors.count() and index.dimension == 64
    for k in (1, 10, 600):
        assert rows(index.search(asked, k), *VECTOR) == rows(dense.search(vectors, asked, k), *VECTOR)
    reach = index.reach(asked, 1)
    assert reach["vectors"] == vectors.count() and 0 < reach["scored"] <= reach["read"] <= 1
    if cells == 400:
        assert reach["scored"] < 0.8


def test_far_cells_are_not_read(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = np.eye(8)[:6] * 3
    data = [(f"v{k}", k, (centres[k % 6] + 0.05 * r.normal(size=8)).tolist()) for k in range(600)] + [("zero", 600, [0.0] * 8)] + [(f"copy{k}", 700 + k, centres[0].tolist()) for k in range(200)]
    vectors = spark.createDataFrame(data, "id string, position long, embedding array<float>")
    index = VectorIndex.build(vectors, str(tmp_path / "v"), cells=12)
    asked = spark.createDataFrame([("a", (centres[1] * 2).tolist()), ("b", (-centres[2]).tolist())], "query_id string, embedding array<float>")
    assert index.reach(asked.where("query_id = 'a'"), 5)["read"] < 0.4
    assert rows(index.search(asked, 5), *VECTOR) == rows(dense.search(vectors, asked, 5), *VECTOR)
    plan = index.search(asked.where("query_id = 'a'"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell")


def test_vectors_are_checked_and_parts_named(spark, vectors, tmp_path):
    index = VectorIndex.build(vectors.where("id < 100"), str(tmp_path / "v"))
    with pytest.raises(ValueError, match="Duplicate id"):
        index.append(vectors.where("id = 3"))
    with pytest.raises(ValueError, match="width must be 64"):
        index.append(spark.createDataFrame([(1000, 1, [1.0])], "id long, position long, embedding array<float>"))
    with pytest.raises(ValueError, match="must have 64 numbers"):
        index.search(spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<float>"))
    with pytest.raises(ValueError, match="dimension"):
        VectorIndex.build(vectors.limit(0), str(tmp_path / "w"))
    with pytest.raises(FileExistsError):
        VectorIndex.build(vectors, index.path)
    with pytest.raises(FileNotFoundError, match="commits"):
        VectorIndex.open(spark, str(tmp_path / "none"))
    (tmp_path / "v/centres").rename(tmp_path / "v/elsewhere")
    with pytest.raises(FileNotFoundError, match="centres"):
        VectorIndex.open(spark, index.path)
    (tmp_path / "v/elsewhere").rename(tmp_path / "v/centres")
    (tmp_path / f"v/vectors/{index.segments[0]['name']}").rename(tmp_path / "v/elsewhere")
    with pytest.raises(FileNotFoundError, match="vectors/segment"):
        VectorIndex.open(spark, index.path)
    assert vector_index.CELLS >= 1
