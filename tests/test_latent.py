"""The trained encoder against numpy's decomposition of the whole matrix, and in the places that take an encoder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.functions.text import search_words
from docengine.operators import dense, diagnostics, evaluate, latent
from docengine.plans import tables as t
from docengine.sources.documents import hashed_encoder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chunks(spark):
    return t.chunks(spark, FOLDER).repartition(3)


@pytest.fixture(scope="module")
def encoder(chunks):
    return latent.fit(chunks, width=16, slots=512, turns=6)


def matrix(chunks, slots, rarity):
    rows = chunks.orderBy("chunk_id").select("chunk_id", F.transform(search_words(F.col("content")), lambda w: F.pmod(F.xxhash64(w), F.lit(slots))).alias("s")).collect()
    a = np.zeros((len(rows), slots))
    for k, r in enumerate(rows):
        slot, n = np.unique(np.array(r.s or [], int), return_counts=True)
        a[k, slot] = (1 + np.log(n)) * rarity[slot]
        a[k] /= np.linalg.norm(a[k]) or 1
    return [r.chunk_id for r in rows], a


def test_directions_are_those_of_the_whole_matrix(chunks, encoder):
    v = encoder.directions
    assert v.shape == (512, 16) and np.allclose(v.T @ v, np.eye(16), atol=1e-4)
    _, a = matrix(chunks, 512, encoder.rarity)
    u, s, w = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(encoder.strength, s[:16], rtol=2e-2)
    best = ((a - (u[:, :16] * s[:16]) @ w[:16]) ** 2).sum()
    assert ((a - a @ v @ v.T) ** 2).sum() <= 1.02 * best


def test_vectors_are_texts_along_the_directions(chunks, encoder):
    ids, a = matrix(chunks, 512, encoder.rarity)
    y = a @ encoder.directions
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    found = {r.chunk_id: r.embedding for r in encoder(chunks, "content").collect()}
    assert all(np.allclose(found[i], row, atol=1e-4) for i, row in zip(ids, y)) and len(found) == len(ids)


def test_odd_texts(spark, encoder):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "the of")], "k int, t string")
    assert all(np.allclose(r.v, 0) for r in encoder(odd, "t", "v").collect())
    one = latent.fit(odd.union(spark.createDataFrame([(4, "words of one text")], "k int, t string")), "t", width=8, slots=64)
    assert one.directions.shape == (64, 1)
    none = latent.fit(odd.limit(0), "t", width=8, slots=64)
    assert none.directions.shape[1] == 0


def test_it_stands_in_for_the_hashed_encoder(spark, chunks):
    """Parts of texts find the texts that they are from; both encoders' hits are told side by side."""
    trained = latent.fit(chunks, width=64, slots=4096)
    asked = chunks.where("chunk_id % 7 = 0 and length(content) > 400").select(F.col("chunk_id").alias("query_id"), F.substring("content", 100, 250).alias("query"))
    hits = {}
    for name, encode in (("hashed", hashed_encoder(64)), ("latent", trained)):
        index = encode(chunks, "content").select(F.col("chunk_id").alias("id"), "position", "embedding")
        ranked = dense.search(index, encode(asked, "query").select("query_id", "embedding"), 10)
        gold = asked.select(F.col("query_id").alias("case_id"), F.col("query_id").alias("chunk_id"))
        first = evaluate.first_relevant_rank(gold.select("case_id"), ranked.withColumnsRenamed({"query_id": "case_id", "id": "chunk_id"}), gold)
        hits[name] = {r.metric: r.value for r in evaluate.metrics(first).collect()}
    print(hits)
    assert hits["latent"]["Recall@10"] >= hits["hashed"]["Recall@10"] and hits["latent"]["MRR"] > 0.3
    pairs = spark.createDataFrame([("fresh issue", "fresh issue of shares", 0)], "query string, content string, at int")
    near = diagnostics.evidence_locality(pairs, trained).first()
    assert -1.001 <= near.chunk_score <= 1.001
