"""Queries over the property graph and its traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.operators import graph, index
from ledgerleaf.plans.base import EDGES_SQL, LEGAL_SQL, NODES_SQL, edges, legal, nodes, query
from ledgerleaf.session import table

_E = f"with e as ({EDGES_SQL}), nd as ({NODES_SQL}), u as (select src as node, dst as other, rel_type from e union all select dst, src, rel_type from e)"


@query(f"{_E} select src as node_id, min(dst) as parent from e where rel_type = 'PART_OF' group by src")
def tree_parent(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).where("rel_type = 'PART_OF'").groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("parent"))


@query(f"{_E} select dst as node_id, count(*) as children, min(src) as first_child from e where rel_type = 'PART_OF' group by dst")
def tree_children(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).where("rel_type = 'PART_OF'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("children"), F.min("src").alias("first_child"))


@query(f"{_E} select node, count(distinct other) as neighbors from u group by node")
def tree_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbors(edges(spark, sf)).groupBy("node").agg(F.count("*").alias("neighbors"))


@query(f"{_E} select round(avg(coalesce(d, 0)), 6) as avg_degree, max(d) as max_degree from nd left join (select node, count(distinct other) as d from u group by node) on node = node_id")
def degree_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree_stats(edges(spark, sf), nodes(spark, sf))


@query(f"{_E} select 'node' as kind, label as name, count(*) as n from nd group by all union all select 'edge', rel_type, count(*) from e group by all")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return n.unionByName(edges(spark, sf).groupBy(F.lit("edge").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n")))


@query(f"{_E} select node, count(*) as citations from u where rel_type in ('CITES', 'REFERENCES') group by node")
def citation_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.citation_frequency(edges(spark, sf))


@query(f"{_E} select src as node, count(*) as n_cited, 0 as n_citing from e where rel_type <> 'PART_OF' group by src union all select dst, 0, count(*) from e where rel_type <> 'PART_OF' group by dst")
def cited_by(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("rel_type <> 'PART_OF'")
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_cited"), F.lit(0).alias("n_citing"))
    return out.unionByName(e.groupBy(F.col("dst").alias("node")).agg(F.lit(0).cast("long").alias("n_cited"), F.count("*").alias("n_citing")))


@query(
    f"with recursive e as ({EDGES_SQL}), w(start, node, hops) as (select distinct src, src, 0 from e where rel_type = 'CITES' union select w.start, e.dst, hops + 1 from w join e on e.src = w.node and rel_type in ('CITES', 'REFERENCES') where hops < 5) select start, node, min(hops) as hops from w group by all"
)
def citation_chain_bfs(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("rel_type in ('CITES', 'REFERENCES')")
    starts = e.where("rel_type = 'CITES'").select(F.col("src").alias("start")).distinct()
    return graph.reached(e, starts, 5)


@query(
    f"with recursive e as ({EDGES_SQL}), s as (select src, dst from e where src like 's%' and dst like 's%' union select dst, src from e where src like 's%' and dst like 's%'), w(start, node, hops) as (select distinct src, src, 0 from s union select w.start, s.dst, hops + 1 from w join s on s.src = w.node where hops < 6) select start, node, min(hops) as hops from w group by all"
)
def shortest_path_hops(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("src like 's%' and dst like 's%'")
    starts = e.select(F.explode(F.array("src", "dst")).alias("start")).distinct()
    return graph.reached(e, starts, 6, directed=False)


@query(
    f"""with c as (select distinct lower(regexp_extract(txt, 'AIR\\s+\\d{{4}}\\s+[A-Z]{{2,10}}\\s+\\d+')) as raw, regexp_extract(txt, 'AIR\\s+\\d{{4}}\\s+([A-Z]{{2,10}})', 1) as court from ({LEGAL_SQL}))
 select 'case_' || left(regexp_replace(raw, '[^a-z0-9]+', '_', 'g'), 50) as src, 'court_' || lower(court) as dst, 'PART_OF' as rel_type from c where court <> ''"""
)
def case_courts(spark: SparkSession, sf: str) -> DataFrame:
    """Cases as parts of the courts that decided them."""
    return graph.courts(graph.citations(legal(spark, sf), "p_partkey", "txt"), "p_partkey")[1]


_STREETS_SQL = """select 's' || s_suppkey as src, 's' || (s_suppkey * 7 % (select count(*) from supplier) + 1) as dst from supplier
 union select 's' || s_suppkey, 's' || (s_suppkey * 3 % (select count(*) from supplier) + 1) from supplier"""


@query(
    f"""with recursive e as materialized (select distinct src, dst from ({_STREETS_SQL}) where src <> dst union select dst, src from ({_STREETS_SQL}) where src <> dst),
 p as (select 's' || s_suppkey as source, 's' || ((s_suppkey * 13 + 7) % (select count(*) from supplier) + 1) as target from supplier),
 w(source, target, node, path) as (select source, target, source, [source] from p union all
 select source, target, dst, list_append(path, dst) from w join e on e.src = w.node where node <> target and len(path) <= 6 and not list_contains(path, dst))
 select source, target, len(path) - 1 as hops, array_to_string(path, '>') as path from w where node = target qualify row_number() over (partition by source, target order by len(path), path) = 1"""
)
def shortest_path_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A shortest path of each pair, with its nodes."""
    s = table(spark, sf, "supplier")
    n = F.broadcast(s.agg(F.count("*").alias("n")))  # one row
    to = lambda x: F.concat(F.lit("s"), F.expr(x))
    rows = s.join(n).select(to("s_suppkey").alias("src"), to("s_suppkey * 7 % n + 1").alias("a"), to("s_suppkey * 3 % n + 1").alias("b"), to("(s_suppkey * 13 + 7) % n + 1").alias("target"))
    e = rows.select("src", F.explode(F.array("a", "b")).alias("dst"), F.lit("CITES").alias("rel_type"))
    found = graph.shortest_paths(e, rows.select(F.col("src").alias("source"), "target"))
    return found.select("source", "target", "hops", F.array_join("path", ">").alias("path"))


_NAMES = "select 'p' || p_partkey as node_id, case when p_partkey % 2 = 0 then '  ' || upper(p_name) else p_name end as name from part"


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.when(F.expr("p_partkey % 2 = 0"), F.concat(F.lit("  "), F.upper("p_name"))).otherwise(F.col("p_name")).alias("name"))


_GROUPS = f"select node_id, min(node_id) over (partition by k) as keeper from (select node_id, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as k from ({_NAMES})) where k <> '' qualify count(*) over (partition by k) > 1"


@query(_GROUPS)
def entity_dups(spark: SparkSession, sf: str) -> DataFrame:
    return graph.duplicate_groups(_names(spark, sf), "name")


@query(
    f"with g as ({_GROUPS}), e as (select distinct 'p' || l_partkey as src, 'p' || (l_partkey * 3 % 200 + 1) as dst from lineitem) select count(*) as n, count(distinct src) as sources from (select coalesce(a.keeper, src) as src, coalesce(b.keeper, dst) as dst from e left join g a on a.node_id = src left join g b on b.node_id = dst) where src <> dst"
)
def entity_merge_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("p"), F.expr("l_partkey * 3 % 200 + 1")).alias("dst"), F.lit("REL").alias("rel_type")).distinct()
    return graph.merge_nodes(e, graph.duplicate_groups(_names(spark, sf), "name")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


@query(f"{_E} select label, count(*) as n from nd where node_id not in (select 'c' || c_custkey from customer where c_acctbal < 0) group by label")
def graph_delete_nodes(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    n, _ = index.delete_nodes(nodes(spark, sf), edges(spark, sf), gone)
    return n.groupBy("label").agg(F.count("*").alias("n"))


@query(f"{_E} select coalesce(n.node_id, x.node_id) as node_id, coalesce(x.label, n.label) as label from nd n full join (select 'c' || c_custkey as node_id, 'Debtor' as label from customer where c_acctbal < 0 union all select 'x1', 'New') x on n.node_id = x.node_id")
def graph_merge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    up = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.lit("Debtor").alias("label"))
    up = up.unionByName(spark.range(1).select(F.lit("x1").alias("node_id"), F.lit("New").alias("label")))
    return index.merge_nodes_table(nodes(spark, sf), up)


_PATHS = "select cast(c_custkey % 20 as bigint) as query_id, c_custkey as path_no, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey] as path from customer join nation on c_nationkey = n_nationkey"


@query(f"with p as ({_PATHS}), s as (select query_id, path_no, unnest(path) as node, unnest([0, 1, 2]) as depth, unnest([null, path[1], path[2]]) as parent from p), f as (select query_id, node, arg_min({{'path_no': path_no, 'depth': depth, 'parent': parent}}, path_no) as f from s group by all) select query_id, node, f.parent as parent, f.depth as depth, f.depth * 260 as x, 110 * (row_number() over (partition by query_id, f.depth order by f.path_no, node) - 1) as y from f")
def result_tree_layout(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerleaf.operators.explain import tree_layout

    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.array(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "c_custkey"))
    return tree_layout(c.select(F.expr("c_custkey % 20").alias("query_id"), F.col("c_custkey").alias("path_no"), path.alias("path")))


@query(f"{_E} select nd.node_id, nd.label from nd where node_id not in (select 'c' || c_custkey from customer where c_nationkey < 5) and node_id not in (select 's' || s_suppkey from supplier where s_nationkey < 5)")
def pruned_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that are not below a collapsed nation."""
    up = edges(spark, sf).where("rel_type = 'PART_OF'")
    hidden = table(spark, sf, "nation").where("n_nationkey < 5").select(F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    below = up.join(hidden, "dst", "left_semi").select(F.col("src").alias("node_id"))
    return nodes(spark, sf).join(below, "node_id", "left_anti")


@query(f"{_E} select src, dst, rel_type, 'edge' as kind from e where src like 's%' union all select node_id, null, label, 'node' from nd where label = 'Supplier'")
def result_graph_elements(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("src like 's%'").select("src", "dst", "rel_type", F.lit("edge").alias("kind"))
    n = nodes(spark, sf).where("label = 'Supplier'").select(F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("label").alias("rel_type"), F.lit("node").alias("kind"))
    return e.unionByName(n)


@query(f"{_E} select node_id, coalesce(d, 0) + 0.1 * coalesce(b, 0) as importance from nd left join (select node, count(*) as d from u group by node) on node = node_id left join (select dst, count(*) as b from e where rel_type = 'PART_OF' group by dst) x on x.dst = node_id where label in ('Nation', 'Supplier')")
def structural_importance(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    deg = graph.both_ways(e).groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("d"))
    below = e.where("rel_type = 'PART_OF'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("b"))
    rows = nodes(spark, sf).where("label in ('Nation', 'Supplier')").join(deg, "node_id", "left").join(below, "node_id", "left")
    return rows.select("node_id", (F.coalesce("d", F.lit(0)) + F.lit(0.1) * F.coalesce("b", F.lit(0))).alias("importance"))
