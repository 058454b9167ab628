"""Pinned values and properties of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.operators import explain, graph, hierarchy, index, metrics, ranking
from ledgerleaf.sources import files
from ledgerleaf.streaming import streams


def one(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "kind", "level", "number"),
    [
        ("Sec. 13 provides that", "section", 5, "13"), ("14. This section applies to", "section", 5, "14"), ("Section 14A of the Act", "section", 5, "14A"), ("(1) Where any person", "sub_section", 6, "1"),
        ("(a) the person concerned", "clause", 7, "a"), ("(i) where the contract", "sub_clause", 8, "i"), ("(c) third", "sub_clause", 8, "c"), ("CHAPTER II Of Contracts", "chapter", 4, "Of Contracts"),
        ("APPENDIX B", "appendix", 1, "APPENDIX B"), ("Section 12-A applies", "section", 5, "12-A"), ("CHAPTER IIII", "chapter", 4, "I"),
    ],
)
def test_line_classes(spark, line, kind, level, number):
    x = one(spark, hierarchy.classify(F.col("line")), line=line)
    assert (x["node_type"], x["level"], x["numbering"]) == (kind, level, number)


def test_body_lines_and_structural_mismatch(spark):
    assert one(spark, hierarchy.classify(F.col("line")), line="PART I — PRELIMINARY") is None
    doc = spark.createDataFrame([(1, "lost\n1. First\nbody\nmore\n(a) sub")], "doc_id int, text string")
    rows = hierarchy.body_merge(hierarchy.line_blocks(doc)).orderBy("seq").collect()
    assert [(r.seq, r.node_type, r.text) for r in rows] == [(1, "section", "body\nmore"), (2, "clause", "")]


def test_nested_set_against_a_stack(spark):
    random.seed(5)
    docs = {d: [random.randint(1, 9) for _ in range(random.randint(1, 25))] for d in range(40)}
    rows = [(d, i, lv) for d, levels in docs.items() for i, lv in enumerate(levels, 1)]
    got = {(r.doc_id, r.seq): (r.parent, r.depth, r.left, r.right) for r in hierarchy.nested_set(spark.createDataFrame(rows, "doc_id int, seq int, level int")).collect()}
    for d, levels in docs.items():
        stack, parent, kids = [(0, 0)], {}, {}
        for i, lv in enumerate(levels, 1):
            while stack[-1][1] >= lv:
                stack.pop()
            parent[i] = stack[-1][0]
            kids.setdefault(parent[i], []).append(i)
            stack.append((i, lv))
        clock, want = [0], {}

        def walk(n, depth):
            clock[0] += 1
            left = clock[0]
            for k in kids.get(n, []):
                walk(k, depth + 1)
            clock[0] += 1
            want[n] = (parent.get(n), depth, left, clock[0])

        walk(0, 0)
        assert all(got[d, i] == want[i] for i in parent)


def test_propagation_pins(spark):
    nested = spark.createDataFrame([(1, 1, 1, 10, 0), (1, 2, 2, 5, 1), (1, 3, 3, 4, 2), (1, 4, 6, 9, 1), (1, 5, 7, 8, 2)], "doc_id int, seq int, left int, right int, depth int")
    closure = graph.ancestors(nested, "doc_id")
    run = lambda *seeds: {r.node: round(r.strength, 6) for r in graph.propagate(spark.createDataFrame([(1, s) for s in seeds], "doc_id int, node int"), closure, "doc_id").collect()}
    assert run(3) == {3: 1.0, 2: 0.6, 1: 0.36}
    assert run(2)[3] == 0.4
    assert run(3, 5)[1] == 0.72
    assert max(run(1, 2, 3, 4, 5).values()) <= 1.0


def test_reached_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b", "CITES"), ("b", "c", "CITES"), ("c", "a", "CITES")], "src string, dst string, rel_type string")
    got = {r.node: r.hops for r in graph.reached(e, spark.createDataFrame([("a",)], "start string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_merge_nodes_drops_inner_edges(spark):
    g = spark.createDataFrame([(1, 1), (2, 1)], "node_id int, keeper int")
    e = spark.createDataFrame([(1, 2, "R"), (2, 3, "R"), (4, 2, "R")], "src int, dst int, rel_type string")
    assert {(r.src, r.dst) for r in graph.merge_nodes(e, g).collect()} == {(1, 3), (4, 1)}


def test_metric_pins(spark):
    hits = spark.createDataFrame([("s", 1, "a", 1), ("s", 1, "x", 2), ("s", 1, "b", 3)], "system string, query_id int, node_id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, node_id string")
    r = metrics.per_query(hits, rel, 2).first()
    assert (r.recall, r.precision, r.hit, r.mrr) == (0.5, 0.5, 1.0, 1.0)
    assert round(r.ap, 4) == 0.8333


def test_p95_is_not_interpolated(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 21)], "k int, v double")
    assert metrics.p95(df, ["k"], "v").first()["p95"] == 20.0
    assert df.agg(metrics.nearest_rank_p95(F.col("v")).alias("x")).first()["x"] == 20.0


def test_index_sync(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    now = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, h string")
    assert {r.k for r in index.changed(now, old, "k", "h").collect()} == {2, 4}
    assert {r.k for r in index.stale(now, old, "k").collect()} == {3}
    assert {(r.k, r.h) for r in index.synced(now, old, "k", "h").collect()} == {(1, "a"), (2, "B"), (4, "d")}
    assert index.changed(now, now, "k", "h").isEmpty()


def test_point_id_is_a_uuid5(spark):
    import uuid

    assert one(spark, index.point_id(F.lit("n_0001"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "n_0001"))


def test_hash_embedding(spark):
    rows = spark.createDataFrame([("the act",), ("the act",), ("",), (None,)], "text string")
    v = [r.embedding for r in index.embed_text(rows).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and not any(v[2]) and not any(v[3])


def test_text_functions(spark):
    assert one(spark, T.clean_noise_lines(F.col("t")), t="Page 1 of 5\nkeep\n\n- 3 -\nDownloaded from here") == "keep\n"
    assert one(spark, T.tokenize(F.col("t")), t="Sec. 12A, of") == ["sec", "12a", "of"]
    assert one(spark, T.tokenize(F.col("t")), t="act — (Sec.) “धारा” <x>") == ["act", "sec", "धारा", "x"]
    assert one(spark, T.intent(F.col("t")), t="he defines fines") == "explanation"
    for t in ("what is section 5", "Sec. 12 says", "Order VII Rule 11"):
        assert one(spark, T.intent(F.col("t")), t=t) == "section_lookup"
    assert one(spark, T.section_keys(F.col("t")), t='124. "Contract" 294A and 1872') == ["124", "294a"]
    assert one(spark, T.section_matches(F.lit("10"), F.array(F.lit("10(a)")))) and not one(spark, T.section_matches(F.lit("10"), F.array(F.lit("101"))))
    assert one(spark, T.dice(T.bigrams(F.lit("abcd")), T.bigrams(F.lit("abcd")))) == 1.0
    x = one(spark, T.expanded(F.lit("he was forced to sign"), F.array(F.lit("15"))))
    assert x["available"] == ["15"] and x["omitted"] == ["14", "19", "2"]


def test_confidence_and_guard(spark):
    assert round(one(spark, explain.confidence(F.lit(1.0), F.lit(1.0), F.lit(3), F.lit(True))), 6) == 1.0
    assert one(spark, explain.guarded(F.lit("x"), F.lit(True))) == explain.GUARD


def test_dedupe_keeps_the_best(spark):
    rows = [(1, 7, 1, "long same text here", "p1"), (1, 8, 2, "other", "p1"), (1, 9, 3, "long same text here", "p3"), (1, 7, 4, "x", "p4"), (1, 5, 5, "quite different words", "p5")]
    got = ranking.dedupe_evidence(spark.createDataFrame(rows, "query_id long, node_id long, rank int, text string, path string")).orderBy("rank").collect()
    assert [r.duplicate_reason for r in got] == [None, "duplicate_path", "duplicate_text", "duplicate_node_id", None]


def _brute_dice(texts):
    def grams(t):
        t = " ".join((t or "").split())
        return {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else {"short " + t}

    g = {i: grams(t) for i, t in texts}
    score = {(a, b): 2.0 * len(g[a] & g[b]) / ((len(g[a]) + len(g[b])) or 1) for a in g for b in g if a < b}
    return {k: round(v, 6) for k, v in score.items() if v >= 0.95}


def test_near_dups_of_any_length_and_across_bands(spark, tmp_path):
    from ledgerleaf.plans import registry

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    texts = []
    for size in (10, 30, 60, 150, 400) * 6:
        t = " ".join(word() for _ in range(size))
        texts += [t, t[:-1], t + " " + word(), t.replace("a", "q", 3)]
    edge = " ".join(word() for _ in range(80))[:399]
    texts += [edge, edge + "zz", "", "a", None, "aa", "aaa"]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.similarity for r in registry.QUERIES["dice_near_dups"](spark, str(tmp_path)).collect()}
    want = _brute_dice([r[:2] for r in rows])
    assert got == want and (120, 121) in got and any(min(rows[a][2], rows[b][2]) >= 600 for a, b in got)


def test_near_dups_meet_in_blocks(spark, monkeypatch):
    """Several blocks, tiles and alphabets, copies and classes of one set: as brute force, and no row for each bigram."""
    monkeypatch.setattr(ranking, "BLOCK_LEAST", 16)
    monkeypatch.setattr(ranking, "BLOCKS", 9)
    rng = random.Random(5)
    texts = []
    for letters in ("abcdefghij", "абвгдежз", "aé漢字かな𝒳y", "ab"):
        for size in (3, 40, 200, 900):
            t = "".join(rng.choice(letters + " ") for _ in range(size)).strip()
            texts += [t, t, t + " " + t, t[:-1] + "Q", t + "!?"]
    texts += ["", None, " ", "x", "x ", "\t漢"]
    rows = list(enumerate(texts))
    df = ranking.dice_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id")
    got = [(r.a, r.b, round(r.similarity, 6)) for r in df.collect()]
    assert len(got) == len(set(got)) and {(a, b): s for a, b, s in got} == _brute_dice(rows)
    assert "explode(grams" not in df._jdf.queryExecution().toString()


def test_near_dups_bitmaps_are_made_once_for_each_class(spark, monkeypatch):
    """Sets of every size that bitmaps are folded for, in runs shorter than a block; a class brings its bitmap to all blocks."""
    written, settled = {}, ranking.settled

    def kept(df, tag):
        written[tag] = df.columns
        return settled(df, tag)

    monkeypatch.setattr(ranking, "settled", kept)
    monkeypatch.setattr(ranking, "RUN", 8)
    monkeypatch.setattr(ranking, "BLOCK_LEAST", 16)
    monkeypatch.setattr(ranking, "BLOCKS", 4)
    rng = random.Random(9)
    texts = []
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789", "".join(map(chr, range(0x4E00, 0x4E80)))):
        for size in (100, 165, 170, 330, 660, 900, 1500):
            t = "".join(rng.choice(letters) for _ in range(size))
            texts += [t, t[:-2], t[: size * 19 // 20], t[: size // 2] + "#" + t[size // 2 + size // 60 :], t[::-1]]
    df = ranking.dice_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")
    got = {(r.a, r.b): round(r.similarity, 6) for r in df.collect()}
    assert got == _brute_dice(list(enumerate(texts))) and len(got) >= 40
    assert "bits" in written["bigram-classes"]


def test_shared_bigrams_pair_by_pair_where_there_are_many(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé漢字") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    batch = pa.record_batch({"id": pa.array(range(40)), "text": pa.array(texts)})
    codes = next(iter(ranking._bigram_sets()([batch]))).column("codes").to_pylist()
    i, j = map(np.ravel, np.indices((40, 40)))
    by_bits, width = ranking._shared_bigrams(codes)
    monkeypatch.setattr(ranking, "BITS", 0)
    by_pairs, none = ranking._shared_bigrams(codes)
    assert width > 0 == none and by_bits(i, j).tolist() == by_pairs(i, j).tolist()
    assert all(by_bits(i, j)[i == j] == [max(1, len({t[k : k + 2] for k in range(len(t) - 1)})) for t in (" ".join(t.split()) for t in texts)])


def test_top_k_prunes_per_task(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("node_id"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in ranking.top_k(df, 5)._jdf.queryExecution().executedPlan().toString()


def test_rate_limiter_resets(spark):
    rows = [(1, i, s) for i, s in enumerate([0, 10, 59, 60, 70])]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: (r.hits, r.rejected) for r in streams.reset_limiter(df, limit=2).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, True), 3: (1, False), 4: (2, False)}
    assert {r.event_id: r.hits for r in streams.sliding_hits(df).collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3}


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("héllo".encode("latin-1"))
    (tmp_path / "b.txt").write_text("  ")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    got = {r.path[-5:].lstrip("/"): [p.text for p in r.pages] for r in files.load_any(files.raw_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ["héllo"] and got["b.txt"] == [] and got[".docx"] == ["One\nTwo"]


def test_citations_whole(spark):
    text = "See Section 45-A of the Contract Act, 1872. Order VII Rule 11 and AIR 1965 SC 123; (2001) 2 SCC 45."
    rows = graph.citations(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("position").collect()
    assert [(r.citation_type, r.ref_number, r.act_name, r.court, r.year) for r in rows] == [
        ("section", "45-A", "the Contract Act, 1872", "", ""), ("rule", "11", "", "", ""), ("order", "Order VII Rule 11", "", "", ""), ("case", "", "", "SC", "1965"), ("case", "", "", "SCC", "2001"),
    ]
    assert all(text[r.start : r.end] == r.raw_text for r in rows)
    nodes, edges = graph.courts(graph.citations(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t"), "id")
    assert {r.node_id for r in nodes.collect()} == {"court_sc", "court_scc"} and edges.count() == 2


def test_parsed_query(spark):
    x = one(spark, T.parsed_query(F.col("t")), t="what does Section 12 of the Act say")
    assert x["section_refs"] == ["section 12"] and x["section_numbers"] == ["12"] and "say" in x["keywords"] and not x["is_empty"]


def test_text_bearing_ties_and_blanks(spark):
    from ledgerleaf.operators import evidence

    # 1 is the root of 2, 4 and 6; 3 lies under 2, 5 under 4; 6 has neither text nor children
    rows = [(1, None, 0.0, 0), (2, "  ", 0.0, 0), (3, "aa", 0.5, 1), (4, "bb", 0.5, 1), (5, "longer", 0.5, 0), (6, "", 0.0, 0)]
    nodes = spark.createDataFrame([(7, *r) for r in rows], "doc_id int, seq int, text string, text_score double, citation_score int")
    pairs = [(2, 1, 1), (3, 1, 2), (4, 1, 1), (5, 1, 2), (6, 1, 1), (3, 2, 1), (5, 4, 1)]
    closure = spark.createDataFrame([(7, *p) for p in pairs], "doc_id int, node int, ancestor int, distance int")
    got = {r.node: r.evidence for r in evidence.text_bearing(nodes, closure, "doc_id").collect()}
    assert got == {1: 4, 2: 3, 3: 3, 4: 4, 5: 5, 6: None}
    assert evidence.text_bearing(nodes.limit(0), closure, "doc_id").count() == 0


def test_nested_documents_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"d{d}", i, rng.randint(1, 6), rng.choice(["1", "", "a"])) for d in range(12) for i in range(1, rng.randint(2, 15))]
    lines = spark.createDataFrame(rows, "doc_id string, seq int, level int, numbering string")
    titles = spark.createDataFrame([("d0", "An Act"), ("d1", "")], "doc_id string, title string")
    files.write_hierarchies(hierarchy.nested_documents(lines, titles), str(tmp_path / "h"))
    docs = files.read_hierarchies(spark, str(tmp_path / "h"))
    got = {(r.document_id, r.seq, r.level, r.numbering, r.parent) for r in hierarchy.flat_documents(docs).collect()}
    assert got == {(r.doc_id, r.seq, r.level, r.numbering, r.parent) for r in hierarchy.parents(lines).collect()}
    for r in docs.collect():
        root, by = r.nodes[0], {n.node_id: n for n in r.nodes}
        assert (root.node_id, root.parent_id, root.left, root.right) == ("root", None, 1, 2 * len(r.nodes))
        assert r.title == {"d0": "An Act"}.get(r.document_id, "Document")
        assert all(by[c].parent_id == n.node_id for n in r.nodes for c in n.children)
        assert sum(len(n.children) for n in r.nodes) == len(r.nodes) - 1
    assert hierarchy.nested_documents(lines.where("false")).collect() == []


def test_containment_without_runs(spark):
    needles = spark.createDataFrame([(1, "one"), (2, "two words"), (3, "a b c"), (4, None), (5, "x p q r s y"), (6, "p q r s t")], "i int, text string")
    texts = spark.createDataFrame([(1, "someone said two wordsmith"), (2, "aa b cc"), (3, None), (4, "ex p q r s yes"), (5, "p  q r s t")], "k int, text string")
    got = {tuple(r) for r in metrics.contained(needles, texts, "i", "k").collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (5, 4)}


def test_similarity_of_equal_blank_and_repeated_texts(spark):
    rows = [(1, "a b", " A b "), (2, "a", None), (3, "", ""), (4, "a b", "a b")]
    pairs = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: (round(r.cosine, 6), round(r.relevance, 6)) for r in metrics.semantic_similarity(pairs, "k", "a", "b", index.md5_buckets).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.0, 1.0)}


def test_nested_documents_shuffle_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [(d, i, rng.randint(1, 9), "x") for d in range(40) for i in range(1, rng.randint(2, 12))]
    spark.createDataFrame(rows, "doc_id int, seq int, level int, numbering string").write.parquet(f"{tmp_path}/lines")
    df = hierarchy.nested_documents(spark.read.parquet(f"{tmp_path}/lines"))
    with_conf = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_conf)
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    files.write_hierarchies(df, f"{tmp_path}/h")
    assert not list((tmp_path / "h").glob("*.json")) and files.read_hierarchies(spark, f"{tmp_path}/h").count() == 40


def test_needles_longer_than_all_texts_are_not_cut(spark, monkeypatch):
    from ledgerleaf.operators import metrics

    seen, keep = {}, metrics.settled
    monkeypatch.setattr(metrics, "settled", lambda df, tag: seen.setdefault(tag, keep(df, tag)))
    texts = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "id int, text string")
    rows = [("in", "e two three four f"), ("whole", "one two three four five six"), ("long", "one two three four five six seven"), ("no", None)]
    needles = spark.createDataFrame(rows, "item string, text string")
    assert sorted(tuple(r) for r in metrics.contained(needles, texts, "item", "id").collect()) == [("in", 1), ("whole", 1)]
    assert {r["item"] for r in seen["needle-runs"].collect()} == {"in", "whole"}
    monkeypatch.undo()
    assert metrics.contained(needles, texts.limit(0), "item", "id").collect() == []
