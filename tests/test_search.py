"""Block-wise search and what stands on it, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import metrics, ranking

DIM = 5


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def table(n, rng):
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(DIM)], i % 3) for i in range(n)]
    return rows + [(n, None, 0), (n + 1, [1.0], 1), (n + 2, [0.0] * DIM, 2)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranking, "VECTOR_ROWS", 7)
    monkeypatch.setattr(ranking, "QUERY_ROWS", 3)


def test_dense_over_blocks_with_ties_nulls_and_other_lengths(spark, small_blocks):
    rows = table(60, random.Random(1))
    v = spark.createDataFrame(rows, "node_id long, embedding array<double>, collection int").repartition(3)
    q = v.where("node_id % 10 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    by_id = {i: e for i, e, _ in rows}
    order = lambda x: (x[0] is None, -round(x[0] or 0.0, 9), x[1])
    for k in (4, 100):
        got = {}
        for r in ranking.dense(v, q, k).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.node_id)
        assert got == {a: [n for _, n in sorted(((cosine(by_id[a], e), i) for i, e, _ in rows), key=order)[:k]] for a in by_id if a % 10 == 0}
    for r in ranking.dense(v, q, 2, collections=True).groupBy("query_id", "collection").count().collect():
        assert r["count"] <= 2


def test_fused_search_against_fuse(spark, small_blocks):
    rows = [r for r in table(50, random.Random(2)) if r[1] and len(r[1]) == DIM and any(r[1])]
    v = spark.createDataFrame(rows, "node_id long, embedding array<double>, c int").drop("c")
    v = v.withColumns({"graph": F.expr("if(node_id % 3 = 0, node_id % 10 / 10.0D, null)"), "hierarchy": F.expr("if(node_id % 4 = 0, node_id % 5 / 5.0D, null)")})
    q = v.where("node_id < 5").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    long = []
    for a in q.collect():
        for r in v.collect():
            c = cosine(a.q, r.embedding)
            long += [(a.query_id, r.node_id, s, x) for s, x in (("dense", round(c, 6) if c > 0.1 else None), ("graph", r.graph), ("hierarchy", r.hierarchy)) if x is not None]
    want = ranking.fuse(spark.createDataFrame(long, "query_id long, node_id long, signal string, score double"), k=6)
    got = ranking.fused_search(v, q, {"all": ranking.FUSION}, 6)
    key = lambda df: {(r.query_id, r["rank"]): (r.node_id, round(r.score, 9)) for r in df.collect()}
    assert key(got) == key(want)


def test_only_hit_relevant_pairs_are_joined(spark):
    hits = spark.createDataFrame([(1, 5, 1, "s"), (1, 6, 2, "s"), (2, 5, 1, "s")], "query_id long, node_id long, rank int, system string")
    out = metrics.per_query(hits, spark.range(40).selectExpr("id % 4 as query_id", "id as node_id"), 2)
    got = {r.query_id: (r.hit, r.mrr) for r in out.collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0)} and out.where("recall > 0").first().recall == pytest.approx(0.1)


def test_languages_are_worked_out_once(spark):
    """Long texts: a plan that removes characters one by one, or counts again for each comparison, takes minutes."""
    import time

    from ledgerleaf.functions import text as T

    rows = [("the law of the land", None, "en"), ("", None, "en"), (None, None, "en"), ("अनुबंध চু x", "hi", "hi"), ("চুক্তি अ", "bn", "bn"), ("अ চ", "hi", "hi"), ("der und la", None, "de"), ("die la le les", None, "fr"), ("\u0964\u0d80 zz", "hi", "hi"), ("ക text", "ml", "ml")]
    df = spark.createDataFrame(rows, "text string, script string, lang string")
    for r in df.select("*", T.script_language(F.col("text")).alias("s"), T.detect_language(F.col("text")).alias("d")).collect():
        assert (r.s, r.d) == (r.script, r.lang), r.text
    long = spark.range(8).select(F.repeat(F.lit("the law of the land is read "), 100_000).alias("text"))
    t = time.time()
    assert {(r.s, r.d) for r in long.select(T.script_language(F.col("text")).alias("s"), T.detect_language(F.col("text")).alias("d")).collect()} == {(None, "en")}
    assert time.time() - t < 20


def test_text_topk_of_copies_against_all_pairs(spark):
    rng = random.Random(4)
    words = "red blue hot cold ring rod".split()
    rows = [(i, [rng.choice(words)], sorted({rng.choice(words), rng.choice(words)})) for i in range(120)]
    d = spark.createDataFrame(rows, "node_id long, ti array<string>, te array<string>")
    q = d.where("node_id % 10 = 0").select(F.col("node_id").alias("query_id"), F.col("te").alias("k"))
    pairs = q.crossJoin(d).where("query_id <> node_id").select("query_id", "node_id", ranking.text_score(F.col("k"), F.col("ti"), F.col("te")).alias("score"))
    want = ranking.top_k(pairs.where("score >= 0.25"), 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.node_id, r.score) for r in df.collect())
    assert key(ranking.text_topk(q, d, 5)) == key(want)


def test_bm25_reads_texts_once_and_counts_within_them(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "The red ring, the RED rod"), (2, None), (3, "blue ring of 7"), (4, "")], "doc_id long, text string")
    rows = {r.node_id: (r.dl, dict(zip(r.tokens, r.tfs, strict=True))) for r in ranking.postings(docs, "doc_id", "text").collect()}
    assert rows == {1: (4, {"red": 2, "ring": 1, "rod": 1}), 2: (None, {}), 3: (3, {"blue": 1, "ring": 1, "7": 1}), 4: (0, {})}
    found = ranking.bm25(docs, spark.createDataFrame([(9, "red ring"), (8, None)], "item_id long, text string"))
    assert [(r.query_id, r.node_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(9, 1, 1), (9, 3, 2)]


def test_bm25_questions_of_equal_terms_match_once(spark, monkeypatch):
    written = {}
    settled = ranking.settled

    def counted(df, tag):
        out = settled(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(ranking, "settled", counted)
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue ring"), (3, "rod")], "doc_id long, text string")
    rows = [(i, "the RED ring" if i % 2 else "ring, red") for i in range(5)] + [(7, "rod"), (8, ""), (9, None)]
    found = ranking.bm25(docs, spark.createDataFrame(rows, "item_id long, text string")).collect()
    assert written["weights"] == 3
    assert sorted((r.query_id, r["rank"], r.node_id) for r in found) == [*((i, n, n) for i in range(5) for n in (1, 2)), (7, 1, 3)]


def test_chooser_by_runs_of_columns():
    """The k largest with ties to the first columns, whatever is masked, as a plain sort gives them."""
    import numpy as np

    rng = np.random.default_rng(2)
    for spread in (3, 50, 10**6):
        key = rng.integers(0, spread, (7, 500)).astype(float)
        key[rng.random(key.shape) < 0.5] = -np.inf
        key[0], key[1, 3:] = -np.inf, -np.inf
        i, j = ranking.chooser(3)(key)
        want = {(r, c) for r in range(7) for c in sorted(np.flatnonzero(key[r] > -np.inf), key=lambda c: (-key[r, c], c))[:3]}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_dense_in_slices_of_queries(spark, monkeypatch):
    """Several blocks and slices with copies, zero vectors, nulls and other lengths: as one matrix at a time of each query."""
    rng = random.Random(6)
    vectors = [(f"v{i:03}", None if i % 41 == 5 else [0.0, 0.0] if i % 37 == 4 else [1.0] if i % 29 == 3 else [float(rng.randint(-3, 3)), 1.0]) for i in range(150)]
    queries = [(i, None if i == 7 else [0.0, 0.0] if i == 9 else [1.0, 2.0, 3.0] if i == 11 else [float(rng.randint(-3, 3)), -1.0]) for i in range(20)]
    v, q = spark.createDataFrame(vectors, "node_id string, embedding array<double>"), spark.createDataFrame(queries, "query_id long, q array<double>")
    rows = lambda: sorted((r.query_id, r["rank"], r.node_id, r.score) for r in ranking.dense(v, q, 4).collect())
    whole = rows()
    for name, size in (("VECTOR_ROWS", 16), ("QUERY_ROWS", 8), ("QUERIES_AT_ONCE", 3)):
        monkeypatch.setattr(ranking, name, size)
    assert rows() == whole and len(whole) == 80
