"""Queries over stores, indexing and events."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators import index
from ledgerleaf.plans.base import LINE_SQL, lines, query
from ledgerleaf.operators import hierarchy
from ledgerleaf.session import fresh_folder, table
from ledgerleaf.streaming import streams

_NEW = "select doc_id, case when doc_id % 7 = 0 then text || ' edited' else text end as text from documents where doc_id % 11 <> 0"
_OLD = "select doc_id, text from documents where doc_id % 13 <> 0"


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", "text")
    edited = F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    digest = lambda df: df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    return digest(d.where("doc_id % 11 <> 0").withColumn("text", edited)), digest(d.where("doc_id % 13 <> 0"))


@query(f"select case when o.doc_id is null then 'new' else 'changed' end as kind, count(*) as n from ({_NEW}) c left join ({_OLD}) o using (doc_id) where o.text is null or md5(o.text) <> md5(c.text) group by 1")
def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    now, old = _versions(spark, sf)
    fresh = index.changed(now, old, "doc_id", "text_hash").join(old.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return fresh.groupBy(F.when(F.col("known").isNull(), "new").otherwise("changed").alias("kind")).agg(F.count("*").alias("n"))


@query(f"select doc_id, md5(text) as text_hash from ({_NEW})")
def index_sync(spark: SparkSession, sf: str) -> DataFrame:
    now, old = _versions(spark, sf)
    return index.synced(now, old, "doc_id", "text_hash")


@query(f"select doc_id from ({_OLD}) where doc_id not in (select doc_id from ({_NEW}))")
def index_stale(spark: SparkSession, sf: str) -> DataFrame:
    now, old = _versions(spark, sf)
    return index.stale(now, old, "doc_id")


_KINDS = " ".join(f"when regexp_matches(line, '{p}') then '{k}'" for k, _, p, _, _ in hierarchy.LINES)
_ROUTES = ", ".join(f"('{k}', '{c}')" for k, c in index.COLLECTIONS.items())


@query(f"with r(k, c) as (values {_ROUTES}) select coalesce(c, 'sections') as collection, count(*) as n from (select case {_KINDS} end as k from ({LINE_SQL})) left join r using (k) group by 1")
def index_full_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = hierarchy.classify(F.col("line"))["node_type"]
    return lines(spark, sf).groupBy(index.collection_of(kind).alias("collection")).agg(F.count("*").alias("n"))


@query("select event_id, user_id, ts, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_wins_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return index.upserted(e, "user_id", [F.desc("ts"), F.desc("event_id")])


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 20")
def provenance_recent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 59999999 preceding and current row) as hits from events")
def rate_limit_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sliding_hits(table(spark, sf, "events")).select("event_id", "user_id", "hits")


@query()
def rate_limit_reset(spark: SparkSession, sf: str) -> DataFrame:
    return streams.reset_limiter(table(spark, sf, "events"))


@query("select event_type, count(*) as requests, round(sum(value), 4) as total, max(value) as largest, arg_max(value, {'ts': ts, 'event_id': event_id}) as latest from events group by event_type")
def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return streams.request_metrics(table(spark, sf, "events"))


@query("select 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type")
def metrics_exposition(spark: SparkSession, sf: str) -> DataFrame:
    return streams.exposition(streams.request_metrics(table(spark, sf, "events")))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def event_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts as a batch query, but through a stream that stops when it has read what there is."""
    spark.sql("DROP VIEW IF EXISTS event_windows")
    counts = streams.windowed_counts(streams.event_stream(spark, sf, "events.parquet"))
    out = streams.run_once(counts, "event_windows", fresh_folder(spark, "event-windows"))
    return out.select(F.to_timestamp_ntz(F.col("start").cast("string")).alias("start"), "event_type", "n")


@query("select doc_id, md5(text) as text_hash from documents where doc_id is not null and doc_id % 7 <> 3")
def incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index kept by streams: all documents, then a second stream that deletes some; what is left, by key."""
    path = fresh_folder(spark, "index-log")
    kept = index.IndexLog(spark, f"{path}/log", "doc_id long, text_hash string", "doc_id", "text_hash")
    hashed = F.md5(F.col("text").cast("binary")).alias("text_hash")
    docs = streams.table_stream(spark, f"{sf}/documents.parquet").where("doc_id is not null").select("doc_id", hashed)
    streams.index_stream(docs, kept.sync, f"{path}/first").awaitTermination()
    last = kept.log().agg(F.max("batch")).first()[0] or 0
    gone = docs.where("doc_id % 7 = 3").withColumn("deleted", F.lit(True))
    streams.index_stream(gone, lambda df, n: kept.sync(df, last + 1 + n), f"{path}/second").awaitTermination()
    return kept.current().select("doc_id", "text_hash")


@query("select doc_id, b as bucket, cast(sum(s) as bigint) as weight from (select doc_id, cast('0x' || left(md5(t), 8) as bigint) % 64 as b, case when (cast('0x' || left(md5(t), 8) as bigint) // 64) % 2 = 0 then 1 else -1 end as s from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents)) group by 1, 2")
def md5_embed(spark: SparkSession, sf: str) -> DataFrame:
    return index.md5_buckets(table(spark, sf, "documents"), "doc_id", "text")


@query()
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return index.embed_text(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("select p_partkey, md5(trim(concat_ws(' ', nullif(p_name, ''), nullif(p_type, '')))) as text_hash from part")
def node_text_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", index.payload_digest(F.col("p_name"), F.col("p_type")).alias("text_hash"))


@query()
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", index.point_id(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("point_id"))
