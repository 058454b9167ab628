"""Queries over evidence: text-bearing nodes, paths, citations, ranking signals and their correctness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators import evidence, graph, hierarchy
from ledgerleaf.plans.base import EDGES_SQL, NODES_SQL, TREE_SQL, edges, nodes, outline, query
from ledgerleaf.session import fresh_folder, table
from ledgerleaf.sources import files

#: A third of an order's lines carry text; scores tie often.
_TEXTS = "case when (doc_id + seq) % 3 = 0 then repeat('x', seq % 3 + 1) else ' ' end as text, (doc_id * seq) % 2 / 2.0 as text_score, seq % 2 as citation_score"
_BELOW = "b.doc_id = a.doc_id and b.seq > a.seq and b.seq < a.after"


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = outline(spark, sf)
    return lines, graph.ancestors(hierarchy.nested_set(lines), "doc_id")


@query(f"select node_id, label from ({NODES_SQL}) where label = 'Nation' union all select node_id, label from ({NODES_SQL}) where node_id = 's1'")
def find_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    return evidence.find(n, "Nation").unionByName(evidence.find(n, node_id="s1"))


@query(f"{TREE_SQL} select a.doc_id, a.seq as node, b.seq as descendant, b.depth - a.depth as distance from tree a join tree b on {_BELOW} where b.depth - a.depth <= 2")
def descendant_ids(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.descendants(_tree(spark, sf)[1], "doc_id", 2)


@query(
    f"""{TREE_SQL}, t as (select *, {_TEXTS} from tree) select a.doc_id, a.seq as node, case when trim(a.text) <> '' then a.seq else (select b.seq from t b where {_BELOW} and trim(b.text) <> ''
 order by b.text_score desc, b.citation_score desc, length(b.text) desc, b.depth, b.seq limit 1) end as evidence from t a"""
)
def text_bearing_nodes(spark: SparkSession, sf: str) -> DataFrame:
    lines, closure = _tree(spark, sf)
    return evidence.text_bearing(lines.selectExpr("doc_id", "seq", *_split(_TEXTS)), closure, "doc_id")


def _split(columns: str) -> list[str]:
    text, rest = columns.split(" as text, ")
    return [f"{text} as text", *rest.split(", ")]


_PATHS = f"""{TREE_SQL}, paths as (select a.doc_id, a.seq as node, string_agg(b.seq || ':' || b.level || ':' || b.numbering, '>' order by b.seq) as path from tree a join tree b on b.doc_id = a.doc_id and b.seq <= a.seq and b.after > a.seq group by all)"""


@query(f"{_PATHS} select * from paths where node <= 6")
def evidence_paths(spark: SparkSession, sf: str) -> DataFrame:
    lines, closure = _tree(spark, sf)
    return evidence.root_paths(lines.select("doc_id", F.col("seq").alias("node"), F.col("seq").alias("rank")), lines, closure, "doc_id")


@query(f"{_PATHS} select doc_id, round(avg(case when (doc_id + node) % 4 = 0 then 0 else 1 end), 4) as correct from paths group by doc_id")
def hierarchy_correctness(spark: SparkSession, sf: str) -> DataFrame:
    lines, closure = _tree(spark, sf)
    true = evidence.root_paths(lines.select("doc_id", F.col("seq").alias("node"), F.lit(1).alias("rank")), lines, closure, "doc_id")
    reported = true.withColumn("path", F.when(F.expr("(doc_id + node) % 4 = 0"), F.concat("path", F.lit(">0:0:0"))).otherwise(F.col("path")))
    return evidence.path_correctness(reported, true, "doc_id")


_CITED = "case p_partkey % 3 when 0 then '' when 1 then 'Section' else 'Article' end as label, case when p_partkey % 4 = 0 then '' else cast(p_size as varchar(10)) end as numbering, case when p_partkey % 5 = 0 then '' else p_name end as title"


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part")
    pick = lambda n, x: F.when(F.expr(f"p_partkey % {n} = 0"), "").otherwise(x)
    return t.select("p_partkey", "p_size", pick(3, F.when(F.expr("p_partkey % 3 = 1"), "Section").otherwise("Article")).alias("label"), pick(4, F.col("p_size").cast("string")).alias("numbering"), pick(5, F.col("p_name")).alias("title"))


@query(
    f"""with c as (select p_partkey, {_CITED} from part) select p_partkey, case when numbering = '' and title = '' then cast(p_partkey as varchar) when numbering = '' then '"' || title || '"'
 else (case when label = '' then 'Section' else label end) || ' ' || numbering || case when title = '' then '' else ', "' || title || '"' end end as citation_text from c"""
)
def source_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _cited(spark, sf).select("p_partkey", evidence.citation_text(F.col("label"), F.col("numbering"), F.col("title"), F.col("p_partkey").cast("string")).alias("citation_text"))


@query(
    f"""with c as (select p_partkey, p_size, {_CITED} from part), k as (select p_partkey, 'section' || p_size as g1, 'section' || p_size || '0' as g2,
 translate(lower(title), ' ,.;:()[]{{}}''"-–—_/\\', '') as cited, lower(label) || numbering as anchor from c),
 m as (select p_partkey, case when contains(cited, g1) or contains(g1, cited) or (anchor <> '' and (contains(anchor, g1) or contains(g1, anchor))) then 1 else 0 end as m1,
 case when contains(cited, g2) or contains(g2, cited) or (anchor <> '' and (contains(anchor, g2) or contains(g2, anchor))) then 1 else 0 end as m2 from k) select p_partkey, (m1 + m2) / 2.0 as accuracy from m"""
)
def citation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    gold = F.array(F.concat(F.lit("Section "), "p_size"), F.concat(F.lit("section-"), "p_size"), F.concat(F.lit("Section "), "p_size", F.lit("0")))
    anchor = F.array(F.concat_ws(" ", "label", "numbering"))
    return _cited(spark, sf).select("p_partkey", evidence.citation_accuracy(gold, F.array("title"), anchor).alias("accuracy"))


@query(
    f"""with e as ({EDGES_SQL}), u as (select src as node from e where rel_type in ('CITES', 'REFERENCES') union all select dst from e where rel_type in ('CITES', 'REFERENCES')), f as (select node, count(*) as n from u group by node),
 c as (select l_orderkey as query_id, 's' || l_suppkey as node, max(l_discount) as d, max(l_tax) as g from lineitem group by all), j as (select c.*, coalesce(n, 0) as n from c left join f using (node))
 select query_id, node, round(d * 0.5 / 0.8, 6) as dense, round(g * 0.3 / 0.8, 6) as graph, case when max(n) over (partition by query_id) > 0 then round(n / max(n) over (partition by query_id), 6) else 0 end as citation from j"""
)
def fused_signals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("s"), "l_suppkey").alias("node"))
    rows = rows.agg(F.max("l_discount").cast("double").alias("dense"), F.max("l_tax").cast("double").alias("graph"), F.lit(0.0).alias("hierarchy"))
    out = evidence.with_citations(evidence.scaled(rows, {"dense": 0.5, "graph": 0.3}), edges(spark, sf), "query_id", "node")
    return out.select("query_id", "node", F.round("dense", 6).alias("dense"), F.round("graph", 6).alias("graph"), F.round("citation", 6).alias("citation"))


@query(
    f"""{TREE_SQL}, k as (select doc_id, parent, string_agg('n_' || lpad(cast(seq as varchar), 4, '0'), ' ' order by seq) as kids from tree group by 1, 2)
 select cast(t.doc_id as varchar) as document_id, 'n_' || lpad(cast(t.seq as varchar), 4, '0') as node_id, case when t.parent = 0 then 'root' else 'n_' || lpad(cast(t.parent as varchar), 4, '0') end as parent_id,
 coalesce(kids, '') as children, t."left", t."right" from tree t left join k on k.doc_id = t.doc_id and k.parent = t.seq union all
 select cast(doc_id as varchar), 'root', null, kids, 1, 2 * (select count(*) from tree t where t.doc_id = k.doc_id) + 2 from k where parent = 0"""
)
def nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested hierarchy records, written as JSON, read again and shown node by node."""
    path = fresh_folder(spark, "hierarchies")
    files.write_hierarchies(hierarchy.nested_documents(outline(spark, sf)), path)
    nodes = files.read_hierarchies(spark, path).select("document_id", F.explode("nodes").alias("n"))
    return nodes.select("document_id", "n.node_id", "n.parent_id", F.array_join("n.children", " ").alias("children"), "n.left", "n.right")


@query("select 'query_type' as kind, o_orderstatus as name, count(*) as n from orders group by all union all select 'difficulty', o_orderpriority, count(*) from orders group by all")
def benchmark_counts(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda kind, c: table(spark, sf, "orders").groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return one("query_type", "o_orderstatus").unionByName(one("difficulty", "o_orderpriority"))


@query("select doc_id, doc_id % 3 > 0 and length(trim(coalesce(text, ''))) <= 50 as scanned from documents")
def pages_scanned(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", evidence.page_scanned(F.col("text"), F.expr("doc_id % 3")).alias("scanned"))
