"""Structure of legal documents: lines, their classes, bodies, parents, nested sets and checks, as window plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Roman numerals from I to XXX.
ROMAN = r"(?:X{0,2}(?:IX|IV|VI{0,3}|I{1,3})|X{1,3})"
# Line patterns in order of priority: type, level, pattern, group of the number, group of the title.
LINES = (
    ("schedule", 1, r"(?i)^(?:SCHEDULE|SCHEDULE\s+\d+|[A-Z]\.\s*SCHEDULE)$", 0, 0),
    ("appendix", 1, r"(?i)^(?:APPENDIX|APPENDIX\s+[A-Z]|APPENDIX\s+\d+)$", 0, 0),
    ("part", 3, rf"(?i)^PART\s+(?:{ROMAN}|[A-Z]|\d+)$", 0, 0),
    ("chapter", 4, rf"(?i)^CHAPTER\s+(?:{ROMAN}|\d+)\s*[-–—]?\s*(.*)$", 1, 0),
    ("section", 5, r"(?i)^(?:Section|Sec\.?|S\.)\s+(\d+[A-Za-z]*(?:\s*[-–]\s*[A-Z])?)\s*(.*)$", 1, 2),
    ("section", 5, r"^(\d+[A-Za-z]*)\.\s+(.*)$", 1, 2),
    ("sub_section", 6, r"^\((\d+)\)\s*(.*)$", 1, 2),
    ("sub_clause", 8, r"(?i)^\(([ivxlcdm]+)\)\s*(.*)$", 1, 2),
    ("clause", 7, r"^\(([a-z])\)\s*(.*)$", 1, 2),
    ("explanation", 9, r"(?i)^Explanation\s*(?:\d+)?\.?\s*:?\s*(.*)$", 1, 0),
    ("illustration", 9, r"(?i)^Illustration\s*(?:\d+)?\.?\s*:?\s*(.*)$", 1, 0),
    ("proviso", 9, r"(?i)^Proviso\s*(?:\d+)?\.?\s*:?\s*(.*)$", 1, 0),
)
ROOT = 0


def line_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line): the non-blank lines, stripped, numbered from 0 in the text's order."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    return lines.select(doc, "line_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line")).where("line <> ''")


def classify(line: Column) -> Column:
    """struct(node_type, level, numbering, title) of the first pattern that fits; null for body text."""
    out = None
    for kind, level, pattern, number, title in LINES:
        num = F.trim(F.regexp_extract(line, pattern, number)) if number else line
        num = F.when(num != "", num).otherwise(line)
        head = F.trim(F.regexp_extract(line, pattern, title)) if title else F.lit("")
        hit = F.struct(F.lit(kind).alias("node_type"), F.lit(level).alias("level"), num.alias("numbering"), F.when(head != "", head).otherwise(line).alias("title"))
        out = F.when(line.rlike(pattern), hit) if out is None else out.when(line.rlike(pattern), hit)
    return out


def body_merge(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Nodes (doc, seq, node_type, level, numbering, title, text): body lines join the structural line before; lines before the first go."""
    kinds = lines.withColumn("k", classify(F.col("line")))
    order = Window.partitionBy(doc).orderBy("line_no")
    grouped = kinds.withColumn("seq", F.sum(F.when(F.col("k").isNotNull(), 1).otherwise(0)).over(order)).where("seq > 0")
    merged = grouped.groupBy(doc, "seq").agg(
        F.max("k").alias("k"), F.array_sort(F.collect_list(F.when(F.col("k").isNull(), F.struct("line_no", "line")))).alias("body")
    )
    return merged.select(doc, F.col("seq").cast("int").alias("seq"), "k.*", F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("text"))


def parents(nodes: DataFrame, doc: str = "doc_id", top: int = 9) -> DataFrame:
    """Adds parent (seq of the nearest earlier node of a smaller level, ROOT if none) and after (seq of the next node that is not below)."""
    w = Window.partitionBy(doc).orderBy("seq")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    parent, after = F.lit(None), F.lit(None)
    for level in range(1, top + 1):
        own = F.col("level") == level
        parent = F.when(own, F.max(F.when(F.col("level") < level, F.col("seq"))).over(before)).otherwise(parent)
        after = F.when(own, F.min(F.when(F.col("level") <= level, F.col("seq"))).over(behind)).otherwise(after)
    last = F.max("seq").over(Window.partitionBy(doc)) + 1
    return nodes.withColumns({"parent": F.coalesce(parent, F.lit(ROOT)), "after": F.coalesce(after, last)})


def nested_set(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds depth, left and right. The root has depth 0 and left 1; with position i and s nodes below, left = 2i - depth + 1 and right = left + 2s + 1."""
    tree = parents(nodes, doc)
    # A node's depth is the number of nodes whose interval is open at it: opened before, less those closed by then.
    # Openings and closings are counted in one order, where closings come first; rows stay where their document's windows have them.
    event = F.array(*(F.struct(F.col(at).cast("long").alias("at"), F.lit(step).alias("step")) for at, step in (("after", -1), ("seq", 1))))
    w = Window.partitionBy(doc).orderBy("event.at", "event.step").rowsBetween(Window.unboundedPreceding, 0)
    events = tree.withColumn("event", F.explode(event)).withColumn("depth", F.sum("event.step").over(w))
    out = events.where("event.step = 1").drop("event")
    left = 2 * F.col("seq") - F.col("depth") + 1
    return out.withColumns({"left": left, "right": left + 2 * (F.col("after") - F.col("seq") - 1) + 1})


def warnings(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, warning_type, seq): missing parents, numbers that repeat under one parent and level, children not below their parent."""
    keys = nodes.select(F.col(doc), F.col("seq").alias("parent"), F.col("level").alias("parent_level"))
    missing = nodes.where(f"parent <> {ROOT}").join(keys, [doc, "parent"], "left_anti").select(doc, F.lit("missing_parent").alias("warning_type"), "seq")
    again = F.row_number().over(Window.partitionBy(doc, "parent", "numbering", "level").orderBy("seq"))
    repeated = nodes.where("numbering <> ''").withColumn("n", again).where("n > 1").select(doc, F.lit("duplicate_numbering").alias("warning_type"), "seq")
    broken = nodes.join(keys, [doc, "parent"]).where("level <= parent_level").select(doc, F.lit("broken_nesting").alias("warning_type"), "seq")
    return missing.unionByName(repeated).unionByName(broken)


def node_id(seq: Column) -> Column:
    return F.format_string("n_%04d", seq)


HIERARCHY = (
    "document_id string, root_id string, title string, "
    "nodes array<struct<node_id: string, parent_id: string, level: int, numbering: string, children: array<string>, left: long, right: long, depth: int>>"
)


def nested_documents(nodes: DataFrame, titles: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """One nested record a document (``HIERARCHY``): its root, then its nodes in reading order, each with its children and interval.

    ``nodes`` has doc, seq, level and numbering; ``titles`` (doc, title) name the roots, else they are called Document. A
    document is one value, so it is as large as a row may be; all before that, children included, works node by node.
    """
    tree = nested_set(nodes, doc)
    name = lambda c: F.when(c == ROOT, "root").otherwise(node_id(c))
    # A node's own row and those of its children meet under its number. The rows of a document already lie together: nothing is shuffled again.
    own = F.struct("parent", "level", "numbering", "left", "right", "depth")
    nothing = F.lit(None).cast(tree.select(own.alias("x")).schema["x"].dataType)
    seq = F.col("seq").cast("int")
    both = F.array(
        F.struct(seq.alias("at"), own.alias("own"), F.lit(None).cast("int").alias("child")),
        F.struct(F.col("parent").cast("int").alias("at"), nothing.alias("own"), seq.alias("child")),
    )
    met = tree.select(doc, F.explode(both).alias("e")).select(doc, "e.*")
    met = met.groupBy(doc, "at").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("child")).alias("children"))
    lists = met.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("at", "own", "children"))).alias("r"))

    def record(r: Column) -> Column:
        x, root = r["own"], r["at"] == ROOT
        cols = {
            "node_id": (name(r["at"]), "string"), "parent_id": (F.when(~root, name(x["parent"])), "string"), "level": (F.when(root, 0).otherwise(x["level"]), "int"),
            "numbering": (F.when(root, "").otherwise(x["numbering"]), "string"), "children": (F.transform(r["children"], node_id), "array<string>"), "left": (F.when(root, 1).otherwise(x["left"]), "long"),
            "right": (F.when(root, 2 * F.size("r")).otherwise(x["right"]), "long"), "depth": (F.when(root, 0).otherwise(x["depth"]), "int"),
        }
        return F.struct(*(c.cast(kind).alias(n) for n, (c, kind) in cols.items()))

    lists = lists.select(doc, F.transform("r", record).alias("nodes"))
    title = F.lit("Document")
    if titles is not None:
        lists = lists.join(titles.select(doc, F.col("title").alias("own_title")), doc, "left")
        title = F.coalesce(F.nullif("own_title", F.lit("")), title)
    return lists.select(F.col(doc).cast("string").alias("document_id"), F.lit("root").alias("root_id"), title.alias("title"), "nodes")


def flat_documents(documents: DataFrame) -> DataFrame:
    """Back from nested records: document_id, seq, level, numbering and parent (seq, ROOT at the top) of all nodes but roots."""
    rows = documents.select("document_id", F.posexplode("nodes").alias("seq", "n")).where("seq > 0")
    number = lambda c: F.when(c == "root", ROOT).otherwise(F.regexp_extract(c, r"([0-9]+)$", 1).cast("int"))
    return rows.select("document_id", "seq", "n.level", "n.numbering", number(F.col("n.parent_id")).alias("parent"))
