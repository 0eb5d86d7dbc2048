"""Vectors are the sums of the features, however many texts are embedded at once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granary.functions import embedding
from granary.operators import retrieval

rng = random.Random(3)
LETTERS = "abcdefé世𝒳1"
MANY = [None, [], ["a"], ["abc"], ["abcd"], ["世" * 9]] + [["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 6))) for _ in range(rng.choice([1, 2, 5, 40]))] for _ in range(80)]


def test_sums_are_those_of_the_columns(spark):
    rows = spark.createDataFrame(list(enumerate(MANY)), "id long, tokens array<string>")
    each = rows.select("id", F.explode(embedding.features(F.col("tokens"))).alias("f")).select("id", embedding.placed(F.col("f")).alias("at"))
    want = np.zeros((len(MANY), embedding.DIM))
    for r in each.groupBy("id", "at.i").agg(F.sum("at.weight").alias("v")).collect():
        want[r.id, r.i] = r.v
    own = pa.array(MANY, pa.list_(pa.string()))
    assert np.array_equal(embedding.HashSpace().sums(own), want)
    assert np.array_equal(np.concatenate([embedding.HashSpace().sums(own.slice(i, 1)) for i in range(len(MANY))]), want)
    assert embedding.HashSpace().unit([]).shape == (0, embedding.DIM)


def test_parts_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(embedding, "TEXTS", 7)
    monkeypatch.setattr(embedding, "TOKENS", 50)
    found = list(embedding.parts(pa.array(MANY, pa.list_(pa.string()))))
    assert [lo for lo, _ in found] == [0, *(hi for _, hi in found[:-1])] and found[-1][1] == len(MANY)
    assert all(hi - lo == 1 or sum(len(t or []) for t in MANY[lo:hi]) <= 50 for lo, hi in found)


def test_slices_of_queries_find_the_same(spark):
    texts = [(i, " ".join(t) if t is not None else None) for i, t in enumerate(MANY)]
    rows = spark.createDataFrame(texts + [(1000 + i, t) for i, t in texts], "id long, text string").repartition(3)  # every text twice, so that scores tie
    asked = rows.where("id < 20")
    key = lambda found: sorted((r.query_id, r.rank, r.id, r.score) for r in found.collect())
    whole = key(retrieval.hybrid_search(asked, rows, k=4, dictionary=["abc"]))
    assert key(retrieval.hybrid_search(asked, rows, k=4, dictionary=["abc"], slice_queries=6)) == whole
    vectors = embedding.HashSpace().unit(MANY)
    for q in (2, 7, 19):
        best = [r for r in whole if r[0] == q]
        assert len(best) == 4 and [r[2] for r in best[:2]] == [q, 1000 + q]
        assert best[0][3] >= 0.5 and np.isclose(vectors[q] @ vectors[q], 1)
    assert all(q not in (0, 1) for q, *_ in whole)


def test_features_are_counted_where_their_parts_are(spark):
    """Parts are dealt by their number, and neither features nor counts are shuffled after that."""
    from granary.plans.queries import embed_features

    plan = embed_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_pairs_are_not_remembered_and_hash_alike():
    space = embedding.HashSpace()
    space.sums(pa.array([["one", "two", "three"]], pa.list_(pa.string())))
    assert not [f for f in space.known if f.startswith("b:")] and "w:one" in space.known
    assert space.hashed(["b:one_two", "w:one"]).tolist() == space.places(["b:one_two", "w:one"]).tolist() and len(space.hashed([])) == 0


def test_chunks_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNKS", 2)
    chunks = spark.createDataFrame([(i, f"word{i} shared text") for i in range(6)], "id long, text string").coalesce(1)
    found = retrieval.hybrid_search(spark.createDataFrame([(1, "word3 shared")], "id long, text string"), chunks, k=3)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString() and found.where("rank = 1").first().id == 3


def test_keywords_shuffle_texts_and_not_tokens(spark):
    rows = spark.createDataFrame([(1, "beta alpha beta"), (2, "some"), (1, "alpha alpha"), (3, None)], "id long, text string")
    best = retrieval.keywords(rows, "id", "text")
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, best.collect())) == [(1, "alpha beta"), (2, "some")]
