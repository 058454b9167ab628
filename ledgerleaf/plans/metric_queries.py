"""Queries that evaluate: ranking metrics, answers, latency, reports, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators import explain, metrics
from ledgerleaf.plans.base import query
from ledgerleaf.plans.ranking_queries import _HITS, _TOP, _bm25, _bm25_sql, _queries, _vectors
from ledgerleaf.operators import ranking
from ledgerleaf.session import table

K = 5
_EVAL = f"""with h as (select query_id, node_id, rank from (select *, {_TOP} as rank from ({_HITS})) where rank <= 10), r as (select q.vec_id as query_id, v.vec_id as node_id from embeddings q join embeddings v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
 j as (select h.*, case when r.node_id is null then 0 else 1 end as rel from h left join r using (query_id, node_id)), c as (select *, sum(rel) over (partition by query_id order by rank) as cum, row_number() over (partition by query_id order by rel desc, rank) as ideal from j),
 t as (select query_id, count(*) as n_rel from r group by 1), m as (select query_id, sum(case when rank <= {K} then rel else 0 end) as hits, min(case when rel = 1 then rank end) as first, sum(case when rel = 1 then cum / rank else 0 end) as precisions,
 sum(case when rank <= {K} then (pow(2, rel) - 1) / log2(rank + 1) else 0 end) as dcg, sum(case when ideal <= {K} then (pow(2, rel) - 1) / log2(ideal + 1) else 0 end) as idcg, any_value(coalesce(n_rel, 0)) as n_rel from c left join t using (query_id) group by 1),
 pq as (select query_id, case when n_rel = 0 then 0.0 else hits / n_rel end as recall, hits / {K} as "precision", case when hits > 0 then 1.0 else 0.0 end as hit, coalesce(1.0 / first, 0) as mrr, case when n_rel = 0 then 0.0 else precisions / n_rel end as ap, case when idcg = 0 then 0.0 else dcg / idcg end as ndcg from m)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.dense(_vectors(spark, sf), _queries(spark, sf).drop("query_language"), 11).where("query_id <> node_id").drop("rank")
    return ranking.top_k(found, 10).select("query_id", "node_id", "rank", F.lit("dense").alias("system"))


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return e.select(F.col("vec_id").alias("node_id"), "label").join(F.broadcast(q), "label").where("query_id <> node_id").select("query_id", "node_id")


def _per_query(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_query(_hits(spark, sf), _relevant(spark, sf), K)


@query(f'{_EVAL} select query_id, round(recall, 6) as recall, round("precision", 6) as "precision", hit from pq')
def recall_precision_hit(spark: SparkSession, sf: str) -> DataFrame:
    return _per_query(spark, sf).select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "hit")


@query(f"{_EVAL} select query_id, round(mrr, 6) as mrr, round(ap, 6) as ap from pq")
def mrr_map(spark: SparkSession, sf: str) -> DataFrame:
    return _per_query(spark, sf).select("query_id", F.round("mrr", 6).alias("mrr"), F.round("ap", 6).alias("ap"))


@query(f"{_EVAL} select query_id, round(ndcg, 6) as ndcg from pq")
def ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return _per_query(spark, sf).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f'{_EVAL} select \'dense\' as system, count(*) as items, round(avg(recall), 6) as recall, round(avg("precision"), 6) as "precision", round(avg(mrr), 6) as mrr, round(avg(ap), 6) as map, round(avg(ndcg), 6) as ndcg from pq')
def system_summary(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return _per_query(spark, sf).groupBy("system").agg(F.count("*").alias("items"), mean("recall", "recall"), mean("precision", "precision"), mean("mrr", "mrr"), mean("ap", "map"), mean("ndcg", "ndcg"))


@query("select event_type, round(avg(value), 4) as mean, round(median(value), 4) as p50, round(list_sort(list(value))[cast(least(count(value) - 1, floor(0.95 * count(value))) as int) + 1], 6) as p95, count(value) as n from events group by event_type")
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.latency(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 4).alias("mean"), F.round("p50", 4).alias("p50"), F.round("p95", 6).alias("p95"), "n")


_PAIRS = "select u.conv_id, u.turn, u.text as q, a.text as a from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant' and u.text is not null and a.text is not null"
_SET = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9'']+'))"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("text is not null")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return u.join(a, ["conv_id", "turn"])


def _set(name: str):
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9']+"), 0))


@query(f"select conv_id, turn, round(case when len(list_intersect(x, y)) = 0 then 0 else 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) end, 6) as f1 from (select conv_id, turn, {_SET.format('q')} as x, {_SET.format('a')} as y from ({_PAIRS}))")
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("conv_id", "turn", F.round(metrics.token_f1(_set("q"), _set("a")), 6).alias("f1"))


@query(f"select conv_id, turn, round(case when len(x) = 0 then 0 else len(list_intersect(x, y)) / len(x) end, 6) as coverage from (select conv_id, turn, {_SET.format('q')} as x, {_SET.format('a')} as y from ({_PAIRS}))")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("conv_id", "turn", F.round(metrics.coverage(_set("q"), _set("a")), 6).alias("coverage"))


@query(f"with s as (select conv_id, turn, {_SET.format('q')} as x, list_filter(regexp_split_to_array(a, '[.!?]\\s+'), lambda s: regexp_matches(s, '[a-zA-Z0-9]')) as ss from ({_PAIRS})) select conv_id, turn, round(case when len(ss) = 0 then 0 else len(list_filter(ss, lambda s: len(list_intersect({_SET.format('s')}, x)) > 0)) / len(ss) end, 6) as faithfulness from s")
def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    x = _set("q")
    ss = F.filter(F.split("a", r"[.!?]\s+"), lambda s: s.rlike("[a-zA-Z0-9]"))
    good = F.filter(ss, lambda s: F.arrays_overlap(F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9']+"), 0)), x))
    return _pairs(spark, sf).select("conv_id", "turn", F.round(F.when(F.size(ss) == 0, 0.0).otherwise(F.size(good) / F.size(ss)), 6).alias("faithfulness"))


@query("select p_partkey, round(len(list_filter(c, lambda x: cast(x as int) between 1 and p_size % 5)) / len(c), 6) as grounding from (select p_partkey, p_size, regexp_extract_all('see [1] and [' || (p_size % 7) || '] or [3]', '\\[\\s*(\\d{1,3})\\s*\\]', 1) as c from part)")
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat(F.lit("see [1] and ["), F.expr("p_size % 7").cast("string"), F.lit("] or [3]"))
    cited = F.regexp_extract_all(answer, F.lit(r"\[\s*(\d{1,3})\s*\]"), 1)
    valid = F.filter(cited, lambda x: x.cast("int").between(1, F.expr("p_size % 5")))
    return table(spark, sf, "part").select("p_partkey", F.round(F.size(valid) / F.size(cited), 6).alias("grounding"))


_BASE = f"with h as ({_bm25_sql('greatest(0, (n - df + 0.5) / (df + 0.5) + 1.0)')}), s as (select query_id, node_id, rank, score / max(score) over (partition by query_id) as score from h), b as (select query_id, sum(case when rank <= 5 then score * (1 - 0.15 * (rank - 1)) end) / sum(case when rank <= 5 then 1 - 0.15 * (rank - 1) end) as base, count(*) as n from s group by 1), c as (select query_id, n, 0.6 * base + 0.25 * ((query_id % 5) / 4.0) + 0.15 * least(1.0, n / 3.0) + case when query_id % 4 = 0 then 0.1 else 0 end as raw, query_id % 3 as n_counter from b), f as (select query_id, n, n_counter, round(greatest(0, least(1, raw)), 4) as confidence from c)"


def _confidence(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    h = _bm25(spark, sf, textbook=False).withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    c = explain.confidence(F.col("base"), F.expr("(query_id % 5) / 4.0D"), F.col("n"), F.expr("query_id % 4 = 0"))
    return explain.rank_weighted(h).select("query_id", "n", F.expr("query_id % 3").alias("n_counter"), F.round(c, 4).alias("confidence"))


@query(f"{_BASE} select query_id, confidence, case when confidence >= 0.7 then 'high' when confidence >= 0.45 then 'medium' else 'low' end as label from f")
def confidence_score(spark: SparkSession, sf: str) -> DataFrame:
    return _confidence(spark, sf).select("query_id", "confidence", explain.label(F.col("confidence")).alias("label"))


@query(f"{_BASE} select query_id, n >= 1 and confidence >= 0.45 as supported, n_counter > 0 as has_conflicts, not (n >= 1 and confidence >= 0.45) as insufficient, n >= 1 and confidence >= 0.45 and n_counter = 0 as is_valid from f")
def validity_flags(spark: SparkSession, sf: str) -> DataFrame:
    return explain.validity(_confidence(spark, sf)).select("query_id", "supported", "has_conflicts", "insufficient", "is_valid")


@query(f"{_BASE} select query_id, case when not (confidence >= 0.45) then '{explain.GUARD}' else 'Answer to: q' || query_id || ' ' || list_aggregate(list_transform(range(1, n + 1), lambda i: '[SOURCE ' || i || ']'), 'string_agg', ' ') end as answer from f")
def guard_answer(spark: SparkSession, sf: str) -> DataFrame:
    v = explain.validity(_confidence(spark, sf))
    said = explain.echo_answer(F.concat(F.lit("q"), F.col("query_id").cast("string")), F.col("n").cast("int"))
    return v.select("query_id", explain.guarded(said, F.col("insufficient")).alias("answer"))


@query("with h as (" + _bm25_sql("greatest(0, (n - df + 0.5) / (df + 0.5) + 1.0)") + ") select query_id, string_agg('[SOURCE ' || rank || '] ' || left(text, 500), chr(10) order by rank) as prompt from h join documents on doc_id = node_id group by query_id")
def prompt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text")
    return explain.prompt_blocks(_bm25(spark, sf, textbook=False).join(d, "node_id"))


@query("select o_orderpriority, o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean, grouping(o_orderpriority) as g1, grouping(o_orderstatus) as g2 from orders group by grouping sets ((o_orderpriority), (o_orderstatus), ())")
def metrics_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    g = o.groupingSets([[o.o_orderpriority], [o.o_orderstatus], []], o.o_orderpriority, o.o_orderstatus)
    return g.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.grouping("o_orderpriority").cast("long").alias("g1"), F.grouping("o_orderstatus").cast("long").alias("g2"))


_ROWS = "select o_orderkey, (o_orderkey % 4) / 3.0 as recall, (o_orderkey % 3) / 2.0 as hierarchy, (o_orderkey % 5) / 4.0 as faithfulness, (o_orderkey % 7) / 6.0 as hallucination, (o_orderkey % 11) / 10.0 as confidence, o_totalprice / 20 as ms from orders"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda m, d, n: F.expr(f"(o_orderkey % {m}) / {d}.0D").alias(n)
    return table(spark, sf, "orders").select("o_orderkey", part(4, 3, "recall"), part(3, 2, "hierarchy"), part(5, 4, "faithfulness"), part(7, 6, "hallucination"), part(11, 10, "confidence"), (F.col("o_totalprice") / 20).alias("ms"))


@query(
    " union all ".join(f"select '{n}' as category, count(*) filter ({c}) as n from ({_ROWS})" for n, c in (("section_miss", "recall = 0"), ("hierarchy_miss", "hierarchy < 1"), ("low_faithfulness", "faithfulness < 0.5"), ("high_hallucination", "hallucination > 0.5"), ("low_confidence", "confidence < 0.45"), ("slow_query", "ms > 5000")))
)
def failure_categories(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.failures(_rows(spark, sf))


@query(f"select o_orderkey, round(1 - recall + hallucination + 1 - faithfulness, 4) as failure from ({_ROWS}) order by failure desc, o_orderkey limit 5")
def top_failures(spark: SparkSession, sf: str) -> DataFrame:
    f = F.round(1 - F.col("recall") + F.col("hallucination") + 1 - F.col("faithfulness"), 4)
    return _rows(spark, sf).select("o_orderkey", f.alias("failure")).orderBy(F.desc("failure"), "o_orderkey").limit(5)


@query(f"select round(0.4 * avg(recall) + 0.4 * avg(faithfulness) + 0.2 * avg(greatest(0, 1 - ms / 5000)), 6) as overall from ({_ROWS})")
def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.composite(F.avg("recall"), F.avg("faithfulness"), F.avg(metrics.latency_score(F.col("ms"))))
    return _rows(spark, sf).agg(F.round(c, 6).alias("overall"))


@query(f"select round(avg(ms), 3) as mean_latency, round(sum(o_orderkey % 3) / sum(o_orderkey % 3 + 5), 6) as removal_rate, round(avg(case when o_orderkey % 2 = 0 then o_orderkey % 4 + 4 end), 6) as mean_budget, round(avg(confidence), 6) as mean_confidence from ({_ROWS})")
def research_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).agg(
        F.round(F.avg("ms"), 3).alias("mean_latency"), F.round(F.sum(F.expr("o_orderkey % 3")) / F.sum(F.expr("o_orderkey % 3 + 5")), 6).alias("removal_rate"),
        F.round(F.avg(F.expr("case when o_orderkey % 2 = 0 then o_orderkey % 4 + 4 end")), 6).alias("mean_budget"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


@query("select 'missing_label' as problem, doc_id from documents anti join labels using (doc_id) union all select 'orphan_label', doc_id from labels anti join documents using (doc_id) union all select 'duplicate_label', doc_id from labels group by doc_id having count(*) > 1")
def dataset_validate(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    missing = d.join(lab, "doc_id", "left_anti").select(F.lit("missing_label").alias("problem"), "doc_id")
    orphan = lab.join(d, "doc_id", "left_anti").select(F.lit("orphan_label").alias("problem"), "doc_id")
    return missing.unionByName(orphan).unionByName(lab.groupBy("doc_id").count().where("count > 1").select(F.lit("duplicate_label").alias("problem"), "doc_id"))


@query("select lang, source, count(*) as n, count(quality) as labelled, cast(coalesce(sum(toxic), 0) as bigint) as toxic from documents left join labels using (doc_id) group by lang, source")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


_MD5 = "cast('0x' || left(md5(t), 8) as bigint)"


@query(
    f"""with p as (select p_partkey, lower(trim(p_name || ' ' || p_type)) as a, lower(trim(p_type || ' ' || p_brand || case when p_size % 3 = 0 then ' ' || p_name else '' end)) as b from part),
 x as (select a as s from p union select b from p), t as (select s, unnest(regexp_extract_all(s, '[a-z0-9]+')) as t from x),
 v as materialized (select s, {_MD5} % 64 as k, sum(case when ({_MD5} // 64) % 2 = 0 then 1 else -1 end) as w from t group by 1, 2), n as materialized (select s, sum(w * w) as n from v group by 1),
 d as (select a, b, sum(va.w * vb.w) as dot from (select distinct a, b from p) q join v va on va.s = a join v vb on vb.s = b and vb.k = va.k group by 1, 2),
 c as (select p_partkey, case when na.n > 0 and nb.n > 0 then coalesce(dot, 0) / sqrt(cast(na.n as double) * nb.n) else 0 end as cosine from p left join d using (a, b) left join n na on na.s = a left join n nb on nb.s = b)
 select p_partkey, round(cosine, 6) as cosine, round(greatest(0, cosine), 6) as relevance from c"""
)
def semantic_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of two descriptions of each part, each distinct text embedded once."""
    from ledgerleaf.operators.index import md5_buckets

    part = table(spark, sf, "part")
    more = F.when(F.expr("p_size % 3 = 0"), F.concat(F.lit(" "), "p_name")).otherwise("")
    pairs = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a"), F.concat("p_type", F.lit(" "), "p_brand", more).alias("b"))
    out = metrics.semantic_similarity(pairs, "p_partkey", "a", "b", md5_buckets)
    return out.select("p_partkey", F.round("cosine", 6).alias("cosine"), F.round("relevance", 6).alias("relevance"))


@query("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def containment_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a benchmark passage word for word."""
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    return metrics.contained(items.select("item_id", "text"), docs.select("doc_id", "text"), "item_id", "doc_id")


@query(
    """with i as (select item_id, lower(text) as t from benchmark union all select 'short:' || item_id, lower(left(text, 40)) from benchmark),
 d as (select doc_id, lower(text) as t from documents union all select -1 - doc_id, lower(substr(text, 1, 60)) from documents where doc_id % 3 = 0)
 select i.item_id, doc_id, contains(d.t, i.t) as in_document from i join d on contains(d.t, i.t) or contains(i.t, d.t)"""
)
def relevance_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant (item, document) pairs: either text, in lower case, contains the other. Openings of both stand beside the whole ones."""
    items, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    low = lambda c: F.lower(c).alias("text")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), low("text")).unionByName(
        items.select(F.concat(F.lit("short:"), "item_id").alias("item_id"), low(F.substring("text", 1, 40)))
    )
    docs = docs.select("doc_id", low("text")).unionByName(docs.where("doc_id % 3 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), low(F.substring("text", 1, 60))))
    within = metrics.contained(items, docs, "item_id", "doc_id").withColumn("in_document", F.lit(True))
    around = metrics.contained(docs, items, "doc_id", "item_id").withColumn("in_document", F.lit(False))
    return within.unionByName(around.join(within.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti"))


@query("select p_partkey, cast(case when p_size > 5 then 1 else 0 end + case when p_brand is not null then 1 else 0 end + case when p_type <> '' then 1 else 0 end as double) / 3 as completeness from part")
def provenance_completeness(spark: SparkSession, sf: str) -> DataFrame:
    present = [F.col("p_size") > 5, F.col("p_brand").isNotNull(), F.col("p_type") != ""]
    return table(spark, sf, "part").select("p_partkey", (sum((F.when(c, 1).otherwise(0) for c in present), F.lit(0)) / F.lit(3)).alias("completeness"))
