import random

import numpy as np
import pytest

from ledgerleaf.llm import op2_jaccard_join as J
from ledgerleaf.llm import op5_link_graph as L
from ledgerleaf.llm.components import components
from ledgerleaf.llm.words import LOWER, WORD, shingles
from tests.llm.fixtures import empty, frame, rows


def features(text, width):
    return shingles(WORD.findall((text or "").encode().translate(LOWER)), width)


def brute(texts, width, percent):
    f = {i: set(features(t, width).tolist()) for i, t in texts}
    root = {i: i for i in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(f)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            same = len(f[a] & f[b])
            if same and 100 * same >= percent * (len(f[a]) + len(f[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(f[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_against_all_pairs(spark, width, percent):
    got = J.jaccard_join(frame(spark), width, percent).collect()
    assert len(got) == len(rows())
    want = brute({(r[0], r[1]) for r in rows() if r[0] is not None}, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = []
    for i in range(700):  # many lie just beside the limit, so that components and leaders differ
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute(texts, 3, 90)


def test_one_of_each(spark):
    docs = frame(spark)
    kept = J.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    want = brute({(r[0], r[1]) for r in rows() if r[0] is not None}, 5, 80)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if i == c)
    assert ids.count(None) == 1
    assert J.jaccard_join(empty(spark)).collect() == [] and J.one_of_each(empty(spark)).collect() == []


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(1)
    band = J.bands(percent)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        add = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        same = len(np.intersect1d(a, b))
        if same and 100 * same >= percent * (len(a) + len(b) - same):
            assert len(np.intersect1d(J.signatures(a, percent, band), J.signatures(b, percent, band)))
            assert not J.far_apart(J.bitmap(a), J.bitmap(b), len(a), len(b), percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_sets_without_common_features_share_hardly_any_signature(width, percent):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, (1 << 64) - 1, int(rng.integers(30, 500)), dtype=np.uint64)) for _ in range(600)]
    found = [np.unique(J.signatures(x, percent, J.bands(percent))) for x in sets]
    _, holders = np.unique(np.concatenate(found), return_counts=True)
    assert (holders * (holders - 1) // 2).sum() < len(sets) // 2


def test_sets_with_bare_partitions_share_a_signature():
    rng = np.random.default_rng(4)
    seen = 0
    for percent in (60, 70, 80, 90):  # wide distances: few features for each partition
        band = J.bands(percent)
        for _ in range(1500):
            n = int(rng.integers(1, 60))
            a = np.unique(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            more = (n - gone) * 100 // percent - n if rng.integers(2) else 0
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, (1 << 64) - 1, max(0, more), dtype=np.uint64)]))
            if J.linked(a, b, percent):
                seen += 1
                assert len(np.intersect1d(J.signatures(a, percent, band), J.signatures(b, percent, band)))
    assert seen > 3000


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in ends}


def page(i, url, *links):
    return (i, url, "".join(f'<p>x</p><a class="c" href="{x}">t</a>' for x in links))


def test_rules_and_propagation(spark):
    pages = spark.createDataFrame(
        [
            page(1, "http://bad.net/x", "http://worse.com/a"), page(2, "https://Feeder.COM/q?z=1#t", "http://bad.net/1", "http://bad.net/2"), page(3, "http://good.example.net/en/1", "https://friend.com/x"),
            page(4, "http://friend.com/y", "http://good.example.net/en/"), page(5, "http://x.example.com/de/1"), page(6, "http://a.org/fr/1"), page(7, None), page(8, "no scheme"), page(9, "http://bad.net"), page(9, "http://bad.net"),
            page(10, "http://example.net/en"), (11, "http://plain.com/", None),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r for r in L.judge_urls(pages).collect()}
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("feeder.com", "/q", None, "block")
    assert (got[1].rule, got[1].verdict) == ("net/", "block") and (got[3].rule, got[3].verdict) == ("example.net/en/", "allow")
    assert got[4].verdict == "allow" and got[4].trust > 0
    assert (got[5].rule, got[6].rule) == ("example.com/de/", "org/fr/")
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in (7, 8))
    assert got[9].rule is None and got[10].rule == "net/" and got[11].verdict == "allow"
    assert L.judge_urls(spark.createDataFrame([], pages.schema)).collect() == []


def test_rank_against_power_iteration(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0)]
    names = "abcd"
    move = np.zeros((4, 4))
    for s, d, w in edges:
        move[names.index(d), names.index(s)] += w
    move /= np.maximum(move.sum(0), 1e-12)
    seed, x = np.array([1.0, 0, 0, 0]), np.array([1.0, 0, 0, 0])
    for _ in range(L.STEPS):
        y = L.DAMPING * move @ x
        x = y + seed * (1 - y.sum())
    got = {r.host: r.score for r in L.personalised_rank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0)], "host string, mass double")).collect()}
    assert all(abs(got.get(n, 0) - v) < 1e-9 for n, v in zip(names, x, strict=True))


def _solved(edges, seeds):
    """The limit, from the linear system: x = d M x + (1 - sum(d M x)) seed."""
    names = sorted({x for s, d, _ in edges for x in (s, d)} | set(seeds))
    at = {x: i for i, x in enumerate(names)}
    move = np.zeros((len(names),) * 2)
    for s, d, w in edges:
        move[at[d], at[s]] += w
    move = L.DAMPING * move / np.maximum(move.sum(0), 1e-12)
    seed = np.array([(x in seeds) / len(seeds) for x in names])
    x = np.linalg.solve(np.eye(len(names)) - move + np.outer(seed, move.sum(0)), seed)
    return dict(zip(names, x.tolist(), strict=True))


def test_far_and_uncrawled_hosts_against_the_linear_system(spark):
    hosts = ["spam.net", *(f"h{i}.com" for i in range(1, 31))]
    links = [(hosts[i], hosts[i - 1]) for i in range(1, 31)] + [("loop1.com", "loop2.com"), ("loop2.com", "loop1.com"), ("loop2.com", "spam.net")]
    pages = spark.createDataFrame([page(i, f"http://{s}/x", f"http://{d}/") for i, (s, d) in enumerate(links)], "page_id long, url string, html string")
    got = {r.host: r for r in L.judge_urls(pages).collect()}
    want = _solved([(d, s, 1.0) for s, d in links], {"spam.net"})
    assert "spam.net" not in got and set(got) == {s for s, _ in links}
    assert all(abs(r.distrust - want[h]) < 1e-10 and r.verdict == "block" for h, r in got.items())


@pytest.mark.parametrize("small", [0, 100])
def test_rounds_go_on_to_the_limit(spark, small):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 3.0)]
    frames = spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0)], "host string, mass double")
    got = {r.host: r.score for r in L.personalised_rank(*frames, steps=None, tolerance=1e-2, small=small).collect()}
    assert sum(abs(got[n] - v) for n, v in _solved(edges, {"a"}).items()) <= 1e-2


def test_hot_hosts_and_odd_pages_by_spark_rounds(spark):
    """One host with a third of all links; null html, clashing columns, a very long url; every rank is Spark's."""
    rng = random.Random(5)
    pairs = [("hub.com", f"h{rng.randrange(40)}.com") for _ in range(60)] + [(f"h{rng.randrange(40)}.com", rng.choice(["hub.com", "spam.net", f"h{rng.randrange(40)}.com"])) for _ in range(120)]
    pairs = [(s, d) for s, d in pairs if s != d]
    rows_ = [(*page(i, f"http://{s}/x", f"http://{d}/"), "c", 1.0) for i, (s, d) in enumerate(pairs)]
    rows_ += [(1000, "http://h1.com/" + "a" * 200_000, None, "c", 1.0), (1001, "http://alone.com/", "<p>", None, None)]
    got = {r.page_id: r for r in L.judge_urls(spark.createDataFrame(rows_, "page_id long, url string, html string, host string, trust double")).collect()}
    weights = {}
    for s, d in pairs:
        weights[d, s] = weights.get((d, s), 0.0) + 1
    want = _solved([(s, d, w) for (s, d), w in weights.items()], {"spam.net"})
    assert len(got) == len(rows_) and all(abs(r.distrust - want.get(r.host, 0.0)) < 1e-10 for r in got.values())
    assert len(got[1000].path) == 200_001 and got[1001].verdict == "allow"
