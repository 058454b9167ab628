"""The registered queries' own columns on a small awkward table, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm import op1_quality, op3_license_scan, op6_decontamination, op7_repeats, op8_personal_data, registry
from ledgerleaf.llm.op6_decontamination import TOKEN
from ledgerleaf.llm.words import LOWER
from tests.llm.fixtures import SCHEMA, rows

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    text = rows()[0][1]
    items = [(1, " ".join(text.split()[5:40])), (2, "two words"), (None, text), (10, None), (3, rows()[2][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def run(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).collect()
    assert len(got) == len(rows())
    return got


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op4_columns(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]
    got = run(spark, sf, "op4_token_orc")
    want = sorted((r[0] is not None, r[0] or 0, len(ids(r[1])), crc(ids(r[1]))) for r in rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_op9_columns(spark, sf):
    got = run(spark, sf, "op9_sharding")
    size = lambda t: len((t or "").encode())
    want = sorted((r[0] is not None, r[0] or 0, size(r[1]) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = {(r.doc_id, r.text_crc32): r.slot for r in registry.QUERIES["op9_sharding"](spark, sf).collect() if r.doc_id != 3}
    assert all(again[r.doc_id, r.text_crc32] == r.slot for r in got if r.doc_id != 3)  # a law of seed and records alone


def test_op6_columns(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.item_id is not None]
    windows = {}
    for i, t in items:
        w = TOKEN.findall((t or "").encode().translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, text, *_ in rows():
        w = TOKEN.findall((text or "").encode().translate(LOWER))
        hit, found = set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        want.append((i is not None, i or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = run(spark, sf, "op6_decontamination")
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)


def test_op6_automata_in_turn(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    order = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.collect())
    assert order(op6_decontamination.decontaminate(docs, bench, limit=20)) == order(op6_decontamination.decontaminate(docs, bench))
    one, several = (op6_decontamination.without_spans(docs, bench, limit=n) for n in (1 << 20, 20))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")
    assert several.columns == docs.columns and sorted(map(key, several.collect())) == sorted(map(key, one.collect()))


def test_op6_long_items_are_cut_without_loss(spark):
    words = [f"w{i % 37}x{i // 5}" for i in range(120)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("short", "a b c"), ("other", " ".join(words[40:75]))], "item_id string, text string")
    texts = [" ".join(["q", *words[i : i + 10], "q"]) for i in range(111)] + [" ".join(words[i : i + 9]) for i in range(0, 110, 7)] + ["z a b c z", " ".join(words), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = [{r.doc_id: (r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in op6_decontamination.decontaminate(docs, bench, limit=n).collect()} for n in (1 << 20, 25)]
    assert seen[0] == seen[1]
    assert all(seen[1][i][0] == 10 and "long" in seen[1][i][1] for i in range(111))
    assert all(seen[1][i][0] == 0 for i in range(111, 127))
    for index in op6_decontamination.indexes(bench, limit=25):
        assert len(index.automaton.next) <= 2 * 25 + 1


def test_op7_columns(spark, sf):
    first = {}
    last = max(r[0] for r in rows() if r[0] is not None) + 1
    for i, text, *_ in sorted(rows(), key=lambda r: last if r[0] is None else r[0]):
        w = WORD.findall(text or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), last if i is None else i)
    want = []
    for i, text, *_ in rows():
        w = WORD.findall(text or "")
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (last if i is None else i) for j in range(k, k + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i is not None, i or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = run(spark, sf, "op7_repeats")
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_op7_passages_that_share_a_hash():
    key, again, doc = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([3, 9, 4, 1])
    assert op7_repeats._later(key, again, doc).tolist() == [False, False, True, False]


def test_op1_columns(spark, sf):
    assert registry.QUERIES["op1_quality"](spark, sf).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_least_determinant_against_numpy(spark):
    rng = np.random.default_rng(3)
    d = len(op1_quality.DIMS)
    mix = rng.normal(size=(d, d)) * 0.4
    x = np.concatenate([rng.normal(size=(400, d)) @ mix, rng.normal(size=(60, d)) * 0.1 + 4])
    stats = spark.createDataFrame([("en", "s", *map(float, v)) for v in x], "q_lang string, q_source string, " + ", ".join(f"{n} double" for n in op1_quality.DIMS))
    r = next(g for g in op1_quality.fit(stats).collect() if g.grp_level == 0)
    floor = np.diag([op1_quality.VECTOR[n][1] ** 2 for n in op1_quality.DIMS])

    def end(core):
        for _ in range(60):
            c = x[core]
            centre, cov = c.mean(0), np.cov(c.T, bias=True) + floor
            far = np.einsum("ij,jk,ik->i", x - centre, np.linalg.solve(cov, np.eye(d)), x - centre)
            core = np.argsort(far, kind="stable")[: int(op1_quality.CORE * len(x))]
        c = x[core]
        return np.linalg.slogdet(np.cov(c.T, bias=True) + floor)[1]

    best = min(end(rng.choice(len(x), d + 2, replace=False)) for _ in range(40))
    got = 2 * sum(np.log(r[f"l_{i}_{i}"]) for i in range(d))
    assert got <= best + 0.05
    assert np.abs([r[f"m_{i}"] for i in range(d)]).max() < 1.0  # the cluster at 4 is outside


def test_licenses_against_every_template(spark):
    """What a scan of every block with every template confirms on its own is reported, or overlaps a report."""
    rng = random.Random(8)
    names = list(op3_license_scan.TEMPLATES)
    texts = []
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = op3_license_scan.TEMPLATES[rng.choice(names)].split()
            if rng.random() < 0.5 and len(words) > 8:
                words[rng.randrange(len(words))] = "changed"
            parts.append(("\n" if rng.random() < 0.5 else " ").join(words))
            parts.append(" ".join(rng.choice(["river", "stone", "lamp"]) for _ in range(rng.randint(1, 60))))
        texts.append("\n\n".join(parts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*texts, None, "", "license " * 4000])], "doc_id long, text string, found string, license int")
    scanner = op3_license_scan.Scanner(op3_license_scan.TEMPLATES)
    for r in op3_license_scan.scan_licenses(docs).collect():
        if r.doc_id >= len(texts):
            assert not r.found
            continue
        text = texts[r.doc_id]
        for start, block in op3_license_scan.blocks(text, scanner.longest):
            spots = [m.span() for m in op3_license_scan._WORD.finditer(block)]
            have = [block[a:b].lower() for a, b in spots]
            for name in names:
                if fit := scanner.differences(have, name):
                    a, b = start + spots[fit[0]][0], start + spots[fit[1] - 1][1]
                    if scanner.saving(text[a:b], name) >= op3_license_scan.LEAST_SAVING:
                        assert any(x.start < b and a < x.start + x.length for x in r.found), (name, text[a:b])


def test_op8_clashing_columns(spark):
    text = "mail joe@mail.com or +1 377 555 0123 today"
    docs = spark.createDataFrame([(1, text, 5, 6, 7, 8), (2, None, 0, 0, 0, 0)], "doc_id long, text string, pii_base int, pii_seen int, PII_more int, pii_row int")
    found = op8_personal_data.personal_data(docs)
    assert found.columns[:6] == docs.columns and len(found.columns) == 8
    r = found.where("doc_id = 1").first()
    assert r[2] == 5 and {x.kind for x in r[6]} == {"email", "phone"}
    red = op8_personal_data.redacted(docs)
    assert red.columns == docs.columns and {(x.doc_id, x.text, x.pii_base) for x in red.collect()} == {(1, "mail [EMAIL] or [PHONE] today", 5), (2, None, 0)}


def test_op8_many_spans_of_a_long_text(spark):
    text = " ".join(f"a{i}@b.org" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = op8_personal_data.personal_data(docs).first()
    assert [(x.start, x.end) for x in r.pii_base] == [m.span() for m in re.finditer(r"\S+", text)]
    assert op8_personal_data.redacted(docs).select(F.length("text")).first()[0] == 3000 * 8 - 1
