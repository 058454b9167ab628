"""Property graphs as node and edge tables: citations, building, traversal, propagation, entity resolution, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.text import provisions
from ledgerleaf.session import settled

# Formats of cases, with the year and the court as groups.
CASES = (
    r"AIR\s+(\d{4})\s+([A-Z]{2,10})\s+\d+",
    r"\((\d{4})\)\s+\d+\s+(SCC|SCR|AIR|Cri)\s+\d+",
    r"(\d{4})\s+(SCC|SCR|AIR|Cri)\s*\(\w+\)\s+\d+",
)
CITING = ("CITES", "REFERENCES")
# Label of a node type.
LABELS = {
    "document": "Document", "act_title": "Document", "preamble": "Document", "chapter": "Chapter", "part": "Part",
    "section": "Section", "sub_section": "Section", "explanation": "Section", "illustration": "Section", "proviso": "Section",
    "clause": "Clause", "sub_clause": "Clause", "schedule": "Schedule", "appendix": "Schedule",
}


def citations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, citation_type, raw_text, ref_number, act_name, court, year, start, end, position): every citation, once for each type and raw text.

    They go by format and place. ``start`` and ``end`` are code points of the raw text's first occurrence.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.lit("").alias("act_name")
    each = [F.transform(provisions(t), lambda c: F.struct(c["citation_type"].alias("citation_type"), c["raw_text"].alias("raw_text"), c["ref_number"].alias("ref_number"), c["act_name"].alias("act_name"), F.lit("").alias("court"), F.lit("").alias("year")))]
    for pattern in CASES:
        found = F.arrays_zip(*(F.regexp_extract_all(t, F.lit(pattern), i).alias(f"g{i}") for i in range(3)))
        each.append(F.transform(found, lambda x: F.struct(F.lit("case").alias("citation_type"), F.trim(x["g0"]).alias("raw_text"), F.lit("").alias("ref_number"), none, x["g2"].alias("court"), x["g1"].alias("year"))))
    rows = docs.select(key, t.alias("t_"), F.posexplode(F.array_distinct(F.concat(*each))).alias("position", "c"))
    start = F.expr("instr(t_, c.raw_text)") - 1
    return rows.select(key, "c.*", start.alias("start"), (start + F.length("c.raw_text")).alias("end"), "position")


def courts(cites: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Court nodes (node_id, label, title) and the PART_OF edges of cases to them."""
    case = F.concat(F.lit("case_"), F.substring(F.regexp_replace(F.lower("raw_text"), r"[^a-z0-9]+", "_"), 1, 50))
    court = F.concat(F.lit("court_"), F.lower("court"))
    rows = cites.where("court <> ''").select(case.alias("src"), court.alias("dst"), "court")
    nodes = rows.select(F.col("dst").alias("node_id"), F.lit("Court").alias("label"), F.col("court").alias("title")).distinct()
    return nodes, rows.select("src", "dst", F.lit("PART_OF").alias("rel_type")).distinct()


def label_of(node_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, node_type), F.lit("Section"))


def part_of_edges(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, src, dst, rel_type): each node to its parent, where the parent comes before it."""
    up = nodes.select(doc, F.col("seq").alias("dst"))
    return nodes.select(doc, F.col("seq").alias("src"), F.col("parent").alias("dst")).where("dst < src").join(up, [doc, "dst"]).select(doc, "src", "dst", F.lit("PART_OF").alias("rel_type"))


def citation_graph(cites: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of citations: cases are cited, other provisions referred to; ids derive from the text, so they never dangle."""
    kind = F.col("citation_type") == "case"
    target = F.concat(F.when(kind, "case_").otherwise("concept_"), F.substring(F.regexp_replace(F.lower("raw_text"), r"[^a-z0-9]+", "_"), 1, 50))
    edges = cites.select(F.col(key).cast("string").alias("src"), target.alias("dst"), F.when(kind, "CITES").otherwise("REFERENCES").alias("rel_type")).distinct()
    nodes = edges.select(F.col("dst").alias("node_id"), F.when(F.col("rel_type") == "CITES", "Case").otherwise("LegalConcept").alias("label")).distinct()
    return nodes, edges


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, as (node, other, rel_type)."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel_type").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "rel_type"))


def neighbors(edges: DataFrame, rel_types=None) -> DataFrame:
    out = both_ways(edges if rel_types is None else edges.where(F.col("rel_type").isin(*rel_types)))
    return out.select("node", "other").distinct()


def degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """avg_degree and max_degree by distinct neighbours, over all nodes."""
    d = neighbors(edges).groupBy("node").agg(F.count("*").alias("degree"))
    every = nodes.join(d, nodes["node_id"] == d["node"], "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return every.agg(F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").cast("long").alias("max_degree"))


def citation_frequency(edges: DataFrame) -> DataFrame:
    return both_ways(edges.where(F.col("rel_type").isin(*CITING))).groupBy("node").agg(F.count("*").alias("citations"))


def reached(edges: DataFrame, starts: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(start, node, hops): the fewest hops to every node within ``depth``; starts has one column, start.

    A frontier at a time: each step joins the newest nodes with the edges and leaves out what was reached
    before. Each frontier is written out, so the plan stays short.
    """
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    if not directed:
        steps = steps.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")))
    steps = steps.distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        front = front.join(steps, "node").select("start", F.col("to").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        front = settled(front, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 6) -> DataFrame:
    """(source, target, hops, path) of the pairs that are joined within ``depth`` edges, in either direction of an edge.

    Frontiers grow from both ends in turn, each row with its predecessor, until a pair's frontiers have met; a pair leaves as
    soon as it has, so neither side goes deeper than half the way. Of equally short paths the one whose nodes come
    first, from the source on, is taken. A pair of one node is a path of it alone; pairs that are not joined have no row.
    ``pairs``: source, target; repeated pairs count once.
    """
    steps = both_ways(edges).select("node", "other").where("node <> other").distinct()
    keys = ["source", "target"]
    todo = settled(pairs.select(*keys).distinct(), "pairs")
    # All nodes within reach of an end, with the hops to it; several predecessors lead to one node, the walk chooses.
    seen = {end: todo.select(*keys, F.col(end).alias("node"), F.lit(0).alias("hops")) for end in keys}
    front = dict(seen)
    met = todo.where("source = target").select(*keys, F.lit(0).alias("length"))
    todo = todo.where("source <> target")
    sides = dict.fromkeys(keys, 0)
    for total in range(1, depth + 1):
        end = keys[(total - 1) % 2]
        sides[end] += 1
        grown = front[end].join(todo, keys, "left_semi").join(steps, "node").select(*keys, F.col("other").alias("node")).distinct()
        grown = grown.join(seen[end].select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("hops", F.lit(sides[end]))
        front[end] = settled(grown, "front")
        seen[end] = seen[end].unionByName(front[end])
        # Frontiers that meet for the first time do so at the newest rows of both sides.
        other = keys[total % 2]
        now = front[end].select(*keys, "node").join(front[other].select(*keys, "node"), [*keys, "node"], "left_semi")
        now = settled(now.select(*keys).distinct().withColumn("length", F.lit(total)), "met")
        met = met.unionByName(now)
        todo = settled(todo.join(now, keys, "left_anti"), "pairs")
        if todo.isEmpty() or front[end].isEmpty():
            break
    # Back along both sides: a node at h hops from the source and length - h from the target lies on a shortest path.
    near = seen["source"].select(*keys, "node", F.col("hops").alias("at"))
    far = seen["target"].select(*keys, "node", F.col("hops").alias("left"))
    lengths = settled(met, "lengths")
    known = near.join(lengths, keys).select(*keys, "node", "at", (F.col("length") - F.col("at")).alias("left"), "length")
    behind = far.join(lengths, keys).select(*keys, "node", (F.col("length") - F.col("left")).alias("at"), "left", "length")
    on_way = settled(known.unionByName(behind).groupBy(*keys, "node", "at").agg(F.max("length").alias("length")), "on-way")
    # Nodes that one side alone has reached lie on a way only if the next node does; the walk starts where both are known.
    last = lengths.select(*keys, "length", F.col("target").alias("node")).withColumn("at", F.col("length"))
    alive = last
    layer = last
    for _ in range(depth):
        layer = layer.join(steps.withColumnRenamed("node", "n2"), layer["node"] == F.col("n2")).select(*keys, "length", F.col("other").alias("node"), (F.col("at") - 1).alias("at"))
        layer = settled(layer.distinct().join(on_way.select(*keys, "node", "at"), [*keys, "node", "at"], "left_semi"), "layer")
        if layer.isEmpty():
            break
        alive = alive.unionByName(layer)
    alive = settled(alive, "alive")
    path = lengths.select(*keys, "length", F.col("source").alias("node"), F.array("source").alias("path"))
    out = path.where("length = 0")
    path = path.where("length > 0")
    for at in range(1, depth + 1):
        after = path.join(steps, "node").select(*keys, "length", "path", F.col("other").alias("node"))
        after = after.join(alive.where(F.col("at") == at).select(*keys, "node"), [*keys, "node"], "left_semi")
        path = after.groupBy(*keys, "length").agg(F.min("node").alias("node"), F.first("path").alias("path"))
        path = settled(path.withColumn("path", F.concat("path", F.array("node"))), "paths")
        if path.isEmpty():
            break
        out = out.unionByName(path.where(F.col("length") == at).select(*out.columns))
        path = path.where(F.col("length") > at)
    return out.select(*keys, F.col("length").alias("hops"), "path")


def ancestors(nested: DataFrame, doc: str) -> DataFrame:
    """(doc, node, ancestor, distance) of nested sets, by one window.

    In reading order a node's ancestor at a depth is the last node before it of that depth, so each node meets its own
    ancestors only, not its document's other nodes. The least and greatest depth, two numbers, bound the columns.
    """
    top, deepest = nested.agg(F.min("depth"), F.max("depth")).first()
    before = Window.partitionBy(doc).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.struct(F.lit(d).alias("d"), F.last(F.when(F.col("depth") == d, F.col("seq")), True).over(before).alias("ancestor")) for d in range(top or 0, deepest or 0)]
    if not above:
        return nested.select(doc, F.col("seq").alias("node"), F.col("seq").alias("ancestor"), F.col("depth").alias("distance")).where("false")
    rows = nested.select(doc, F.col("seq").alias("node"), "depth", F.array(*above).alias("above"))
    found = rows.select(doc, "node", "depth", F.explode(F.filter("above", lambda x: (x["d"] < F.col("depth")) & x["ancestor"].isNotNull())).alias("x"))
    return found.select(doc, "node", F.col("x.ancestor").alias("ancestor"), (F.col("depth") - F.col("x.d")).alias("distance"))


UP, DOWN, LEAST = 0.6, 0.4, 1e-4


def propagate(seeds: DataFrame, closure: DataFrame, doc: str) -> DataFrame:
    """(doc, node, strength): seeds 1, ancestors UP^k, descendants DOWN^k, summed over seeds and capped at 1; weaker than LEAST stops."""
    own = seeds.select(doc, "node", F.lit(1.0).alias("s"))
    # A closure without ``doc`` serves all of them: seeds meet only their own rows of it.
    on = [doc] if doc in closure.columns else []
    up = seeds.join(closure, [*on, "node"]).select(doc, F.col("ancestor").alias("node"), F.pow(F.lit(UP), F.col("distance")).alias("s"))
    down = seeds.withColumnRenamed("node", "ancestor").join(closure, [*on, "ancestor"]).select(doc, "node", F.pow(F.lit(DOWN), F.col("distance")).alias("s"))
    return own.unionByName(up).unionByName(down).where(F.col("s") > LEAST).groupBy(doc, "node").agg(F.least(F.lit(1.0), F.sum("s")).alias("strength"))


def normalized_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def duplicate_groups(nodes: DataFrame, name: str) -> DataFrame:
    """(node_id, keeper): nodes whose normalised name occurs again, with the smallest id of the name; blank names never match."""
    keyed = nodes.select("node_id", normalized_name(F.col(name)).alias("key")).where("key <> ''")
    groups = keyed.groupBy("key").agg(F.min("node_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, "key").select("node_id", "keeper")


def merge_nodes(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with losers replaced by keepers; an edge between a keeper and its own loser goes."""
    m = groups.where("node_id <> keeper")
    src = m.select(F.col("node_id").alias("src"), F.col("keeper").alias("s2"))
    dst = m.select(F.col("node_id").alias("dst"), F.col("keeper").alias("d2"))
    out = edges.join(src, "src", "left").join(dst, "dst", "left")
    return out.select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"), "rel_type").where("src <> dst")
