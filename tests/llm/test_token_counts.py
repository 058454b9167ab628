"""Token counts and their cache against the libraries' own counts."""

import hashlib
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm import op12_token_counts as op
from tests.llm.fixtures import SCHEMA, empty, rows

SPECIAL = ["<|endoftext|>", "a <|startoftext|>b", "<|STARTOFTEXT|> x", "a\r\n\t  b    c d", "  lead and trail\n", "<|endoftext|>\n\n<|endoftext|>", "ﬁ é", "İstanbul ẞ"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        s = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(s.encode(t, num_threads=1))
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def table(spark):
    extra = [(2000 + i, t, "en", "s0", 1, 1, "x", "y") for i, t in enumerate(SPECIAL)]
    return spark.createDataFrame(rows() + extra, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, tmp_path, name):
    count = library(name)
    docs = table(spark)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(((r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in docs.collect()), key=key)
    got = op.count_tokens(docs, public_tokenizers.path(name), f"file://{tmp_path}/cache")
    assert sorted((tuple(r) for r in got.collect()), key=key) == want


def stored(spark, cache):
    return [len(list(d.glob("*.parquet"))) and spark.read.parquet(str(d)).count() for d in sorted(Path(cache).glob("version=*/batch-*"), key=lambda d: d.stat().st_mtime)]


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/cache"
    docs = table(spark)
    digest = lambda t: hashlib.sha256(__import__("re").sub("[ \t-\r]+", " ", t or "").encode()).digest()
    half = docs.where("doc_id % 2 = 0")
    op.count_tokens(half, path, f"file://{cache}").collect()
    op.count_tokens(docs, path, f"file://{cache}").collect()
    op.count_tokens(docs, path, f"file://{cache}").collect()
    one = {digest(r.text) for r in half.collect()}
    both = {digest(r.text) for r in docs.collect()}
    assert stored(spark, cache) == [len(one), len(both - one), 0]
    # A count found in the cache is not made again: a changed one shows.
    fake = op.cached(spark, f"file://{cache}", op.version(path)).withColumn("n_tokens", F.lit(7).cast("long"))
    op._store(fake, f"file://{tmp_path}/other", op.version(path))
    assert {r.n_tokens for r in op.count_tokens(docs, path, f"file://{tmp_path}/other").collect()} == {7}


def test_versions_do_not_mix(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = table(spark)
    a, b = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    first = {tuple(r) for r in op.count_tokens(docs, a, cache).collect()}
    second = {tuple(r) for r in op.count_tokens(docs, b, cache).collect()}
    assert first != second and {tuple(r) for r in op.count_tokens(docs, a, cache).collect()} == first


def test_query_and_empty_table(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op12_token_counts(spark, str(tmp_path)).collect()
    assert len(got) == len(rows()) + len(SPECIAL) and all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert op.count_tokens(empty(spark), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/none").collect() == []
