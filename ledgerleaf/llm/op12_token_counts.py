"""Token counts through a digest cache: stored counts are joined, only distinct misses are encoded and then stored.

The cache is a folder in the shared storage. Under ``version=<digest>``, named by the tokenizer's file and library, each
batch of misses is a Parquet folder of (digest, n_tokens). A batch is written elsewhere and renamed when it is whole, so
a lost job leaves nothing that counts; two jobs that store one digest store one count, and readers take it once.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C
from ledgerleaf.llm.tokens import Encoder

#: Names a cache that outlives the query; without it each call starts with an empty one.
CACHE_SETTING = "ledgerleaf.token.cache"
SCHEMA = "digest binary, n_tokens long"
_made: dict[str, Counter] = {}
C.forgets.append(_made.clear)


class Counter:
    """Counts of whole texts as the library for the file gives them, special strings by its default."""

    def __init__(self, path: str) -> None:
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Encoder(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        marked = [any(s in t for s in self.special) for t in texts]
        fast = iter(self.encoder.encode_batch([t for t, m in zip(texts, marked, strict=True) if not m]))
        whole = lambda t: len(self.plain.encode(t, add_special_tokens=False).ids)
        return [whole(t) if m else len(next(fast)) // 4 for t, m in zip(texts, marked, strict=True)]


def version(tokenizer: str) -> str:
    """A digest of what counts depend on: the vocabulary file, and the library with its version."""
    library = "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"
    with open(tokenizer, "rb") as f:  # a file of the installed package, here and on the executors
        return hashlib.sha256(f.read() + f"\n{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def drops_space(tokenizer: str) -> bool:
    """Whether the tokenizer itself makes each run of white space one space, before anything else can see it."""
    if not tokenizer.endswith(".json"):
        return False
    with open(tokenizer, encoding="utf-8") as f:
        found = json.load(f)
    steps = (found.get("normalizer") or {}).get("normalizers", [found.get("normalizer") or {}])
    return any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)


def normalised(text: Column, tokenizer: str) -> Column:
    """The text with all that cannot change its count taken away: runs of ASCII white space, for tokenizers that do so too."""
    return F.regexp_replace(text, "[ \\t-\\r]+", " ") if drops_space(tokenizer) else text


def cached(spark: SparkSession, cache: str, of: str) -> DataFrame | None:
    """The stored counts of one tokenizer version, one row for each digest; None where there are none yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(f"{cache}/version={of}")
    if not found.getFileSystem(conf).exists(found):
        return None
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{cache}/version={of}")
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _store(counts: DataFrame, cache: str, of: str) -> None:
    spark = counts.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = uuid.uuid4().hex
    staged, final = f"{cache}/_staged/{name}", f"{cache}/version={of}/batch-{name}"
    counts.write.option("compression", "zstd").parquet(staged)
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(final).getFileSystem(conf)
    fs.mkdirs(path(f"{cache}/version={of}"))
    if not fs.rename(path(staged), path(final)):
        raise RuntimeError(f"counts could not be moved to {final}")


def _count(tokenizer: str):
    def run(batches):
        C.at_work("op12")
        if tokenizer not in _made:
            _made[tokenizer] = Counter(tokenizer)
        for batch in batches:
            counts = pa.array(_made[tokenizer](batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["digest", "n_tokens"])
        C.rested()

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row, in no given order; misses are encoded and stored first.

    A null text is empty and has no tokens. Repeated rows and equal texts are encoded once and each get their row; a
    text that a third of all rows share becomes one row within each task before anything is shuffled. Very long texts
    are encoded whole. A null doc_id stays. An empty table stores nothing and gives no rows. Other columns, whatever
    their names, do not matter.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 1000)
    of = version(tokenizer)
    known = cached(spark, cache, of)
    rows = docs.select(F.col("doc_id"), C.text_of().alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), normalised(F.col("text"), tokenizer).alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # One row a digest, made within tasks before the shuffle; the stored counts meet it on the same key.
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    _store(misses.select("digest", "text").mapInArrow(_count(tokenizer), SCHEMA), cache, of)
    C.release(spark)
    counts = cached(spark, cache, of)
    return keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op12_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    cache = spark.conf.get(CACHE_SETTING, None) or C.fresh_path(spark, "token-counts")
    found = count_tokens(C.load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
