"""Evidence around a ranked node: where its text comes from, its path from the root, its citation, and how right these are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions.text import normalize_citation
from ledgerleaf.operators import graph

#: Paths shown for a result, best evidence first.
PATHS = 6


def find(nodes: DataFrame, label: str | None = None, **properties) -> DataFrame:
    """Nodes of a label, of given properties, of both, or all; filters reach the scan."""
    out = nodes if label is None else nodes.where(F.col("label") == label)
    for name, value in properties.items():
        out = out.where(F.col(name) == value)
    return out


def descendants(closure: DataFrame, doc: str, depth: int | None = None) -> DataFrame:
    """(doc, node, descendant, distance) down to ``depth`` levels, or all."""
    rows = closure.select(doc, F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")
    return rows if depth is None else rows.where(F.col("distance") <= depth)


def text_bearing(nodes: DataFrame, closure: DataFrame, doc: str) -> DataFrame:
    """(doc, node, evidence): a node with text is its own evidence; else its descendant best by text score, citation score and length.

    ``nodes``: doc, seq, text, text_score, citation_score. Ties go to the nearer one, then to the earlier in reading order, as
    a breadth-first walk meets them. A blank node without such a descendant has null. The best is a running maximum, so the
    root of a large document is not gathered.
    """
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    own = nodes.select(doc, F.col("seq").alias("node"), F.when(has, F.col("seq")).alias("own"))
    below = nodes.where(has).select(doc, F.col("seq").alias("node"), "text_score", "citation_score", F.length("text").alias("size"))
    key = F.struct("text_score", "citation_score", "size", (-F.col("distance")).alias("near"), (-F.col("node")).alias("early"))
    blank = own.where("own is null").select(doc, F.col("node").alias("ancestor"))
    best = closure.join(below, [doc, "node"]).join(blank, [doc, "ancestor"], "left_semi").groupBy(doc, "ancestor").agg((-F.max(key)["early"]).alias("best"))
    return own.join(best.withColumnRenamed("ancestor", "node"), [doc, "node"], "left").select(doc, "node", F.coalesce("own", "best").alias("evidence"))


def root_paths(evidence: DataFrame, nodes: DataFrame, closure: DataFrame, doc: str, paths: int = PATHS) -> DataFrame:
    """(doc, node, path): root to node, of the ``paths`` best pieces of evidence (doc, node, rank); entries are seq:level:numbering."""
    top = evidence.where(F.col("rank") <= paths).select(doc, "node")
    steps = top.join(closure, [doc, "node"]).select(doc, "node", F.col("ancestor").alias("seq"), "distance")
    steps = steps.unionByName(top.select(doc, "node", F.col("node").alias("seq"), F.lit(0).alias("distance")))
    entry = F.struct((-F.col("distance")).alias("at"), F.concat_ws(":", "seq", "level", "numbering").alias("entry"))
    return steps.join(nodes.select(doc, "seq", "level", "numbering"), [doc, "seq"]).groupBy(doc, "node").agg(F.array_join(F.sort_array(F.collect_list(entry))["entry"], ">").alias("path"))


def citation_text(label: Column, numbering: Column, title: Column, node_id: Column) -> Column:
    """``Label 12, "Title"``; a number without a label is a section's, and what has neither number nor title is called by its id."""
    label, numbering, title = (F.coalesce(c, F.lit("")) for c in (label, numbering, title))
    number = F.when((label != "") & (numbering != ""), F.concat(label, F.lit(" "), numbering)).when(numbering != "", F.concat(F.lit("Section "), numbering))
    text = F.concat_ws(", ", number, F.when(title != "", F.concat(F.lit('"'), title, F.lit('"'))))
    return F.when(text == "", node_id).otherwise(text)


def scaled(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The three signals times their share of the weights; weights that sum to 0 leave nothing."""
    names = ("dense", "graph", "hierarchy")
    total = sum(weights.get(n, 0.0) for n in names) or 1.0
    return candidates.withColumns({n: F.col(n) * F.lit(weights.get(n, 0.0) / total) for n in names})


def with_citations(candidates: DataFrame, edges: DataFrame, query: str, node: str) -> DataFrame:
    """``citation``: how often a candidate is joined by citing edges, against the most of its query's candidates."""
    often = graph.citation_frequency(edges).select(F.col("node").alias(node), "citations")
    most = Window.partitionBy(query)
    rows = candidates.join(often, node, "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    rows = rows.withColumn("most", F.max("citations").over(most))
    return rows.withColumn("citation", F.when(F.col("most") > 0, F.col("citations") / F.col("most")).otherwise(0.0)).drop("citations", "most")


def citation_accuracy(gold: Column, cited: Column, anchors: Column) -> Column:
    """Share of the distinct gold keys that a citation's key, or a node's non-empty one, contains or is contained in. No gold: 0."""
    keys = F.array_distinct(F.transform(gold, normalize_citation))
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    met = lambda k: F.exists(F.transform(cited, normalize_citation), lambda c: either(c, k)) | F.exists(F.transform(anchors, normalize_citation), lambda a: (a != "") & either(a, k))
    return F.when(F.size(keys) == 0, 0.0).otherwise(F.round(F.size(F.filter(keys, met)) / F.size(keys), 4))


def path_correctness(reported: DataFrame, true: DataFrame, doc: str) -> DataFrame:
    """(doc, correct): share of evidence (doc, node, path) whose path is the true one; unknown nodes are wrong."""
    both = reported.select(doc, "node", "path").join(true.select(doc, "node", F.col("path").alias("true_path")), [doc, "node"], "left")
    return both.groupBy(doc).agg(F.round(F.avg(F.when(F.col("path") == F.col("true_path"), 1.0).otherwise(0.0)), 4).alias("correct"))


def page_scanned(text: Column, images: Column) -> Column:
    """A page with images and at most 50 characters of text."""
    return (images > 0) & (F.length(F.trim(F.coalesce(text, F.lit("")))) <= 50)
