"""Evidence, counter-authority, confidence, validity, prompts and guarded answers, for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Counter-authority groups with their phrases, in order; the strong groups.
MARKERS = {
    "overruled": ("overruled", "overrule"), "superseded": ("superseded", "supersede"), "repealed": ("repealed",), "overridden": ("overridden",),
    "invalid": ("void ab initio", "declared void", "not enforceable", "invalid"), "inoperative": ("inoperative", "no longer operative"),
    "not_applicable": ("does not apply", "shall not apply", "not applicable"),
}
STRONG = ("overruled", "superseded", "repealed", "overridden")
STAGES = ("parse", "intent", "budget", "expansion", "dense", "graph", "hierarchy", "fusion", "ranking", "deduplication", "evidence", "provenance", "answer")
GUARD = "The retrieved material does not support an answer to this question."
HIGH, MEDIUM = 0.7, 0.45


def counter_authority(evidence: DataFrame, node: str, text: str) -> DataFrame:
    """(node, marker, phrase, context): the first phrase of each group that a text has, with 40 characters before and 80 after."""
    low = F.lower(F.col(text))
    first = [
        F.struct(F.lit(group).alias("marker"), F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases)).alias("phrase")) for group, phrases in MARKERS.items()
    ]
    found = evidence.select(node, text, F.explode(F.filter(F.array(*first), lambda x: x["phrase"].isNotNull())).alias("m")).select(node, text, "m.*")
    at = F.expr(f"instr(lower({text}), phrase)")
    start = F.greatest(F.lit(1), at - 40)
    return found.select(node, "marker", "phrase", F.col(text).substr(start, at - start + F.length("phrase") + 80).alias("context"))


def confidence(base: Column, covered: Column, n: Column, cited: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.6 * base + 0.25 * covered + 0.15 * F.least(F.lit(1.0), n / 3.0) + F.when(cited, 0.1).otherwise(0.0)))


def rank_weighted(evidence: DataFrame) -> DataFrame:
    """(query_id, base, n): mean score of the first five ranks, weighted 1, 0.85, 0.7, 0.55, 0.4, and the evidence count."""
    weight = 1.0 - 0.15 * (F.col("rank") - 1)
    inside = F.col("rank") <= 5
    return evidence.groupBy("query_id").agg((F.sum(F.when(inside, F.col("score") * weight)) / F.sum(F.when(inside, weight))).alias("base"), F.count("*").alias("n"))


def label(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def validity(rows: DataFrame, threshold: float = MEDIUM) -> DataFrame:
    """Adds supported, has_conflicts, insufficient and is_valid from n, confidence and n_counter."""
    supported = (F.col("n") >= 1) & (F.col("confidence") >= threshold)
    return rows.withColumns({"supported": supported, "has_conflicts": F.col("n_counter") > 0, "insufficient": ~supported, "is_valid": supported & (F.col("n_counter") == 0)})


def prompt_blocks(evidence: DataFrame, chars: int = 500) -> DataFrame:
    """(query_id, prompt): numbered evidence by rank."""
    block = F.concat(F.lit("[SOURCE "), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, chars))
    rows = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return rows.select("query_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n").alias("prompt"))


def echo_answer(question: Column, n: Column) -> Column:
    """The stand-in for a language model: repeats the question and lists the sources."""
    sources = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("[SOURCE "), i.cast("string"), F.lit("]"))), " ")
    return F.concat(F.lit("Answer to: "), question, F.lit(" "), F.when(n > 0, sources).otherwise(""))


def guarded(answer: Column, insufficient: Column) -> Column:
    return F.when(insufficient, GUARD).otherwise(answer)


def tree_layout(paths: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, node, parent, depth, x, y) from root-to-node paths: the first parent seen wins, y counts within a depth."""
    steps = paths.select(query, "path_no", F.posexplode("path").alias("depth", "node"))
    parent = F.lag("node").over(Window.partitionBy(query, "path_no").orderBy("depth"))
    seen = steps.withColumn("parent", parent)
    first = seen.groupBy(query, "node").agg(F.min(F.struct("path_no", "depth", "parent")).alias("f")).select(query, "node", "f.*")
    at = F.row_number().over(Window.partitionBy(query, "depth").orderBy("path_no", "node")) - 1
    return first.select(query, "node", "parent", "depth", (F.col("depth") * 260).alias("x"), (at * 110).alias("y"))
