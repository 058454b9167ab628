"""Compared systems over one batch of questions, ablations of the full one, and their report.

All systems answer from the tables of one ``Explained``: what was retrieved once serves each of them, and their hits are
one long table, so metrics of all systems, arms and groups of questions come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.operators import explain, metrics, ranking
from ledgerleaf.operators.explanation import Explained
from ledgerleaf.session import settled

SYSTEMS = ("hhgr", "dense", "bm25", "graph", "naive_rag")
# The arms and their weights of dense, graph and hierarchy; without explanation, the fused list itself is the answer.
ARMS = {
    "full": {"dense": 0.40, "graph": 0.35, "hierarchy": 0.25},
    "no_graph": {"dense": 0.40, "graph": 0.0, "hierarchy": 0.25},
    "no_hierarchy": {"dense": 0.40, "graph": 0.35, "hierarchy": 0.0},
    "no_dense": {"dense": 0.0, "graph": 0.35, "hierarchy": 0.25},
    "no_explainability": None,
}
HIT = ("query_id", "node_id", "score", "rank")


def _evidence(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "node_id", F.col("final_score").alias("score"), F.col("index").alias("rank"))


def system_hits(e: Explained, k: int = 5) -> DataFrame:
    """(system, query_id, node_id, score, rank) of the five systems; ``naive_rag`` reads what ``dense`` finds and only then answers."""
    texts = e.nodes.select("node_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    bm25 = ranking.bm25(texts, e.asked.select("query_id", "text"), k, node="node_id", query="query_id")
    found = {"hhgr": _evidence(e.evidence), "dense": e.dense, "bm25": bm25, "graph": e.graph, "naive_rag": e.dense}
    out = None
    for name in SYSTEMS:
        one = found[name].select(F.lit(name).alias("system"), *HIT).where(F.col("rank") <= k)
        out = one if out is None else out.unionByName(one)
    return out


def arm_hits(e: Explained, k: int = 5) -> DataFrame:
    """The same for the arms: the full system, each signal left out, and no explanation."""
    out = None
    for name, weights in ARMS.items():
        rows = e.fused.select(*HIT) if weights is None else _evidence(e.evidence if name == "full" else e.variant(weights))
        one = rows.select(F.lit(name).alias("system"), *HIT).where(F.col("rank") <= k)
        out = one if out is None else out.unionByName(one)
    return out


def rag_prompts(e: Explained, k: int = 5) -> DataFrame:
    """(query_id, prompt): what the naive system hands to a model, its hits' texts in order."""
    rows = e.dense.where(F.col("rank") <= k).join(e.nodes.select("node_id", "text"), "node_id")
    return explain.prompt_blocks(rows.select("query_id", "rank", "text"))


def report(suites: dict[str, DataFrame], asked: DataFrame, relevant: DataFrame, k: int = 5, total: DataFrame | None = None) -> DataFrame:
    """(suite, system, intent, queries, recall, precision, mrr, map, ndcg): intent is null for all questions together.

    A question that a system finds nothing for counts as 0. ``suites`` are tables of hits, ``relevant`` has distinct
    (query_id, node_id), with ``total`` (query_id, n_rel) at least those that were hit. One pass of grouping sets gives the groups.
    """
    names = {"recall": "recall", "precision": "precision", "mrr": "mrr", "ap": "map", "ndcg": "ndcg"}
    hits = None
    for suite, rows in suites.items():
        one = rows.select(F.lit(suite).alias("suite"), "system", "query_id", "node_id", "rank")
        hits = one if hits is None else hits.unionByName(one)
    hits = settled(hits, "all-hits")
    scored = metrics.per_query(hits, relevant, k, by=("suite", "system"), total=total)
    every = hits.select("suite", "system").distinct()  # some ten rows
    grid = asked.select("query_id", "intent").join(F.broadcast(every))
    rows = grid.join(scored, ["suite", "system", "query_id"], "left").fillna(0.0, list(names))
    mean = [F.round(F.avg(c), 6).alias(n) for c, n in names.items()]
    keys = ["suite", "system", "intent"]
    return rows.groupingSets([keys[:2], keys], *keys).agg(F.count("*").alias("queries"), *mean)
