"""Registration of queries, and tables that several of them derive from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A legal sentence and a structural line for each part, the same in both dialects.
LEGAL_SQL = "select p_partkey, concat('Section ', p_size, ' of the ', p_brand, ' Act. AIR ', 1950 + p_size, ' SC ', p_partkey, '. See Article ', p_size % 7 + 1, case when p_partkey % 5 = 0 then ' which was overruled later' when p_partkey % 7 = 0 then ' and shall not apply here' else '' end) as txt from part"
LINE_SQL = """select p_partkey, case p_partkey % 14 when 0 then 'CHAPTER II Of ' || p_type when 1 then 'Section ' || p_size || ' ' || p_name when 2 then p_size || '. ' || p_name
 when 3 then '(' || p_size || ') ' || p_name when 4 then '(a) ' || p_name when 5 then '(ii) ' || p_name when 6 then 'Explanation: ' || p_name when 7 then 'PART ' || (p_size % 9 + 1)
 when 8 then 'SCHEDULE' when 9 then '(c) ' || p_name when 10 then 'Proviso ' || p_name when 11 then 'APPENDIX B' when 12 then 'Section ' || p_size || '-A ' || p_name else p_name end as line from part"""


def legal(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part")
    tail = F.when(F.expr("p_partkey % 5 = 0"), " which was overruled later").when(F.expr("p_partkey % 7 = 0"), " and shall not apply here").otherwise("")
    return t.select("p_partkey", F.concat(F.lit("Section "), "p_size", F.lit(" of the "), "p_brand", F.lit(" Act. AIR "), F.expr("1950 + p_size"), F.lit(" SC "), "p_partkey", F.lit(". See Article "), F.expr("p_size % 7 + 1"), tail).alias("txt"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part")
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("CHAPTER II Of "), "p_type"), F.concat(F.lit("Section "), size, F.lit(" "), name), F.concat(size, F.lit(". "), name), F.concat(F.lit("("), size, F.lit(") "), name),
        F.concat(F.lit("(a) "), name), F.concat(F.lit("(ii) "), name), F.concat(F.lit("Explanation: "), name), F.concat(F.lit("PART "), F.expr("p_size % 9 + 1")), F.lit("SCHEDULE"),
        F.concat(F.lit("(c) "), name), F.concat(F.lit("Proviso "), name), F.lit("APPENDIX B"), F.concat(F.lit("Section "), size, F.lit("-A "), name),
    ]
    line = name
    for i, form in enumerate(forms):
        line = F.when(F.expr(f"p_partkey % 14 = {i}"), form).otherwise(line)
    return t.select("p_partkey", line.alias("line"))


#: A tree of levels for each order: lines in a fixed order with levels 1 to 9. Lines that tie in all of it are alike in what is shown.
_PLACE = "l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"
OUTLINE_SQL = f"""select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by {_PLACE}) as int) as seq,
 cast(1 + l_partkey % 9 as int) as level, cast(l_suppkey % 4 as varchar) as numbering from lineitem"""


def outline(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    # By the name that later windows have, so that these need no shuffle of their own.
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(*_PLACE.split(", ")))
    level, numbering = F.expr("cast(1 + l_partkey % 9 as int)"), F.expr("cast(l_suppkey % 4 as string)")
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return rows.select("doc_id", seq.alias("seq"), level.alias("level"), numbering.alias("numbering"))


#: The oracle's tree, by joins within a document instead of windows.
TREE_SQL = f"""with o as materialized ({OUTLINE_SQL}),
 p as materialized (select o.doc_id, o.seq, o.level, o.numbering, coalesce(max(b.seq) filter (b.seq < o.seq and b.level < o.level), 0) as parent,
 coalesce(min(b.seq) filter (b.seq > o.seq and b.level <= o.level), max(b.seq) + 1) as after from o join o b on b.doc_id = o.doc_id group by all),
 d as materialized (select p.doc_id, p.seq, p.level, p.numbering, p.parent, p.after, 1 + count(*) filter (b.seq < p.seq and b.after > p.seq) as depth
 from p join p b on b.doc_id = p.doc_id group by all),
 tree as (select *, 2 * seq - depth + 1 as "left", 2 * seq - depth + 1 + 2 * (after - seq - 1) + 1 as "right" from d)"""

#: region - nation - customer as PART_OF edges, orders citing each other through their clerks' keys.
EDGES_SQL = """select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'PART_OF' as rel_type from nation union all select 'c' || c_custkey, 'n' || c_nationkey, 'PART_OF' from customer
 union all select 's' || s_suppkey, 'n' || s_nationkey, 'PART_OF' from supplier union all select 's' || s_suppkey, 's' || (s_suppkey * 7 % (select count(*) from supplier) + 1), 'CITES' from supplier
 union all select 'c' || c_custkey, 's' || (c_custkey % (select count(*) from supplier) + 1), 'REFERENCES' from customer"""
NODES_SQL = "select 'r' || r_regionkey as node_id, 'Region' as label from region union all select 'n' || n_nationkey, 'Nation' from nation union all select 'c' || c_custkey, 'Customer' from customer union all select 's' || s_suppkey, 'Supplier' from supplier"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    n, c, s = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    many = F.broadcast(s.agg(F.count("*").alias("n_suppliers")))  # one row
    link = lambda df, a, x, b, y, rel: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(rel).alias("rel_type"))
    out = link(n, "n", F.col("n_nationkey"), "r", F.col("n_regionkey"), "PART_OF")
    for more in (
        link(c, "c", F.col("c_custkey"), "n", F.col("c_nationkey"), "PART_OF"), link(s, "s", F.col("s_suppkey"), "n", F.col("s_nationkey"), "PART_OF"),
        link(s.join(many), "s", F.col("s_suppkey"), "s", F.expr("s_suppkey * 7 % n_suppliers + 1"), "CITES"), link(c.join(many), "c", F.col("c_custkey"), "s", F.expr("c_custkey % n_suppliers + 1"), "REFERENCES"),
    ):
        out = out.unionByName(more)
    return out


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t, key, prefix, label in (("region", "r_regionkey", "r", "Region"), ("nation", "n_nationkey", "n", "Nation"), ("customer", "c_custkey", "c", "Customer"), ("supplier", "s_suppkey", "s", "Supplier")):
        one = table(spark, sf, t).select(F.concat(F.lit(prefix), key).alias("node_id"), F.lit(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out
