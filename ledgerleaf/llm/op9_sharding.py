"""Two-pass external shuffle, in DataFrame operations only.

Pass one scatters whole records into buckets by seeded hashes; each shard has so many buckets that each fits in
memory. Pass two gathers each bucket, puts it in a fixed order, shuffles it by Fisher-Yates in its first form (draw one
of those that are left, strike it out) with draws hashed from seed, shard, bucket and step, and writes it to its
shard's folder. A repeated task draws the same numbers, so it writes the same order. Shards are sets of buckets, so a
shard's slots follow from the buckets' counts.

The law is ``key``: rendezvous hashing of doc_id over the shards. Whatever other rows there are, a document
keeps its shard, and a further shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.llm import common as C

SHARDS, SEED = 8, 20240601
#: UTF-8 bytes of text, and records, that a bucket holds on average (whichever makes more buckets).
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 512
#: Copies of a repeated record that one row stands for before they are spread over tasks.
COPIES = 4096
#: Buckets up to which their counts, one row of three numbers each, are broadcast; beyond, Spark shuffles both sides.
BROADCAST_BUCKETS = 500_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the key is largest."""
    scores = F.array(*(F.struct(F.xxhash64(key, F.lit(seed + 7919 * s)).alias("score"), F.lit(s).alias("shard")) for s in range(shards)))
    return F.array_max(scores)["shard"]


def fisher_yates(n: Column, *draw_from: Column) -> Column:
    """A permutation of 0 to n - 1: for each step, one of the numbers left is drawn by a hash of ``draw_from`` and the step."""
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("left"), F.array().cast("array<int>").alias("out"))

    def strike(state: Column, step: Column) -> Column:
        left = state["left"]
        at = F.pmod(F.xxhash64(*draw_from, step), F.size(left)).cast("int")
        rest = F.concat(F.slice(left, F.lit(1), at), F.slice(left, at + 2, F.size(left)))
        return F.struct(rest.alias("left"), F.concat(state["out"], F.array(F.get(left, at))).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), n), start, strike, lambda state: state["out"])


def _numbered(slim: DataFrame) -> DataFrame:
    """Records with ``copy``, which numbers those that are equal as a whole.

    Only records whose hash repeats are grouped, each counted within its tasks before it is shuffled; one with very many
    copies is spread over tasks. Others are numbered 0 where they are. (Hashes that meet by chance change no number.)
    """
    keyed = slim.withColumn("key", F.xxhash64("doc_id", "text"))
    # A written table: Spark knows its size, broadcasts it below its own threshold and shuffles both sides beyond.
    keys, _ = C.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    once = keyed.join(keys, "key", "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("copy"))
    counted = keyed.join(keys, "key", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    runs = counted.select("doc_id", "text", "n", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")).alias("low")).repartition("doc_id", "low")
    copies = runs.select("doc_id", "text", F.explode(F.expr(f"sequence(low, least(low + {COPIES}L, n) - 1)")).alias("copy"))
    return once.unionByName(copies)


def external_shuffle(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS
) -> tuple[str, DataFrame]:
    """Write ``docs`` as shuffled records under shard= folders; return their path and the read-back records.

    The records are doc_id, text, size (UTF-8 bytes of the text, null: none, plus 1), shard, bucket, place (in
    the bucket) and slot (in the shard, gapless from 0). Null doc_ids share one shard, which then has more buckets, not
    larger ones. Rows that repeat doc_id share its shard; equal texts under several doc_ids are spread like any others,
    and so are rows that repeat as a whole, each by its number among them. A very long text is a record as any other.
    An empty table gives no records. Other columns, whatever their names, are not carried.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    shard = shard_of(F.col("doc_id"), shards, seed)
    # One row for each shard: its buckets hold so many bytes and rows on average, however large the corpus or the shard.
    totals = {r["shard"]: r for r in slim.groupBy(shard.alias("shard")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()}
    least = -(-C.partitions(spark) // shards)
    buckets = [max(least, -(-totals[s]["bytes"] // bucket_bytes), -(-totals[s]["n"] // bucket_rows)) if s in totals else 1 for s in range(shards)]
    rows = _numbered(slim).withColumn("shard", shard)
    within = F.get(F.array(*map(F.lit, buckets)), F.col("shard"))
    bucket = F.pmod(F.xxhash64("doc_id", "text", "copy", F.lit(seed)), within).cast("int")
    gathered = rows.groupBy("shard", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("doc_id", size.alias("size"), "text", "copy"))).alias("records"))
    order = fisher_yates(F.size("records"), F.lit(seed + 1), F.col("shard"), F.col("bucket"))
    shuffled = gathered.withColumn("order", order).select("shard", "bucket", F.posexplode(F.transform("order", lambda i: F.get("records", i))).alias("place", "r"))
    path = C.fresh_path(spark, "shards")
    records = shuffled.select("bucket", "place", "r.doc_id", "r.text", "r.size", "shard").sortWithinPartitions("shard", "bucket", "place")
    records.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    records = spark.read.schema("bucket int, place int, doc_id long, text string, size long, shard int").parquet(path)
    counts = records.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    small = F.broadcast(before) if sum(buckets) <= BROADCAST_BUCKETS else before
    return path, records.join(small, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("place")).drop("before")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = external_shuffle(C.load(spark, sf_dir, "documents"))
    return records.select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
