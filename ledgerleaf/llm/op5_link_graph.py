"""Link-graph propagation: personalised PageRank from trusted hosts, reversed distrust from blocked ones.

Trust runs along host edges from the hosts that an allow rule fits; distrust runs against them, from the
hosts that a block rule fits as a whole, not only below some path, to those that link to them. Both start with mass 1 shared by their seeds and
return to the seeds with probability 1 - DAMPING and from hosts without edges. A host is blocked when its
distrust exceeds THRESHOLD times its trust plus a floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, STEPS, THRESHOLD, FLOOR = 0.85, 20, 2.0, 1e-9
#: Verdicts compare distrust with THRESHOLD times trust plus FLOOR: together the errors of both stay a hundredth of FLOOR.
TOLERANCE = FLOOR / 100 / (1 + THRESHOLD)
#: Rounds between two written tables of a rank that goes on to its limit.
ROUNDS = 8
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^\"'\s>/?#]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.translate(rest, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def best_rule(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, by the rule's whole length; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        domain, _, tail = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + tail))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst, weight) between different hosts, counted before they are shuffled; weight is the number of links."""
    links = pages.select(host_of(F.coalesce("url", F.lit(""))).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _limit(edges: list[tuple[str, str, float]], seeds: dict[str, float], damping: float, tolerance: float) -> list[tuple[str, float]]:
    """The limit on the driver; edges are (src, dst, share)."""
    import numpy as np

    names = sorted({x for s, d, _ in edges for x in (s, d)} | set(seeds))
    at = {x: i for i, x in enumerate(names)}
    src, dst = (np.array([at[e[k]] for e in edges]) for k in (0, 1))
    share = np.array([e[2] for e in edges])
    seed = np.array([seeds.get(x, 0.0) for x in names])
    now, change = seed, np.inf
    while change * damping / (1 - damping) > tolerance:
        moved = damping * np.bincount(dst, now[src] * share, len(names))
        new = moved + seed * (1.0 - moved.sum())
        now, change = new, np.abs(new - now).sum()
    return [(x, v) for x, v in zip(names, now.tolist(), strict=True) if v]


def _series(share: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, score): the limit, as the sum of what the seeds send along 0, 1, 2 ... edges, divided by its total.

    (Mass that returns to the seeds only scales that sum.) The hosts' sums are written every ROUNDS rounds; what they have
    grown by bounds what is still to come, since each further edge passes on ``damping`` of the mass at most.
    """
    start = seeds.select("host", F.col("mass").alias("score"))
    now, at = C.written(start, "rank")
    total, later = now.agg(F.sum("score")).first()[0] or 0.0, damping**ROUNDS
    while total:
        new = now
        for _ in range(ROUNDS):
            sent = new.join(share, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
            new = sent.unionByName(start).groupBy("host").agg(F.sum("score").alias("score"))
        new, new_at = C.written(new, "rank")
        before, total = total, new.agg(F.sum("score")).first()[0]
        C.dropped(share.sparkSession, at)
        now, at = new, new_at
        # Scores and their total each miss this much at most.
        if 2 * (total - before) * later / (1 - later) <= tolerance * total:
            break
    return now.select("host", (F.col("score") / F.lit(total or 1.0)).alias("score"))


def personalised_rank(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = STEPS, tolerance: float = TOLERANCE, small: int = 0
) -> DataFrame:
    """(host, score) from ``seeds`` (host, mass) after ``steps`` rounds; None goes on until all scores together are
    within ``tolerance`` of their limit. Edges are (src, dst, weight). ``small``: with None and neither more edges nor more
    seeds than that, the limit is found on the driver; at 0, which ``judge_urls`` uses, always by Spark.

    A host's score goes out along its edges by weight. Hosts that nothing reaches have no row; mass at a host
    without edges returns to the seeds. The sum of scores stays 1. Lineage is cut by a written table.
    """
    spark = edges.sparkSession
    totals, totals_at = C.written(edges.groupBy("src").agg(F.sum("weight").alias("total")), "totals")
    share, share_at = C.written(edges.join(totals, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "share")
    now, at = C.written(seeds.select("host", F.col("mass").alias("score")), "rank")
    if share.isEmpty():
        return now
    if steps is None:
        if small and seeds.count() <= small and share.count() <= small:
            limit = _limit(sorted(map(tuple, share.collect())), {r.host: r.mass for r in seeds.collect()}, damping, tolerance)
            now = spark.createDataFrame(limit, "host string, score double")
        else:
            now = _series(share, seeds, damping, tolerance)
        C.dropped(spark, totals_at, share_at, at)
        return now
    for _ in range(steps):
        moved = now.join(share, F.col("host") == F.col("src")).groupBy("dst").agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
        moved, moved_at = C.written(moved, "moved")
        arrived = moved.agg(F.sum("score")).first()[0] or 0.0
        back = seeds.select("host", (F.col("mass") * (1.0 - arrived)).alias("score"))
        new, new_at = C.written(moved.select(F.col("dst").alias("host"), "score").unionByName(back).groupBy("host").agg(F.sum("score").alias("score")), "rank")
        change = now.withColumnRenamed("score", "was").join(new, "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        C.dropped(spark, at, moved_at)
        now, at = new, new_at
        # Each round's change is at most ``damping`` times the last one's: what is still to come sums to less than this.
        if change * damping / (1 - damping) <= tolerance:
            break
    C.dropped(spark, totals_at, share_at)
    return now


def _seeds(found: DataFrame) -> DataFrame:
    found, _ = C.written(found, "seeds")
    n = found.count()
    return found.withColumn("mass", F.lit(1.0 / n if n else 0.0))


def _trusted(judged: DataFrame) -> DataFrame:
    """Hosts of pages that an allow rule fits."""
    return judged.where("host <> '' and judged.verdict = 'allow'").select("host")


def _whole(hosts: DataFrame, verdict: str, rules) -> DataFrame:
    """Hosts that a rule without a path decides, whether a page of theirs is given or they are only linked to."""
    judged = hosts.where("host <> ''").withColumn("judged", best_rule(F.col("host"), F.lit("/"), rules))
    return judged.where(f"judged.verdict = '{verdict}' and judged.rule like '%/' and judged.rule not like '%/%/'").select("host")


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    A rule that fits a url decides it. Other urls follow their host: blocked where distrust is above
    ``threshold`` times trust and the floor. A url that is null or has no ``://`` has an empty host and path,
    fits no rule and is allowed; null html has no links. Repeated rows each give their row and their links
    count each time. Hosts on no edge and in no seed have scores of 0. An empty table gives no rows.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("judged", best_rule(F.col("host"), F.col("path"), rules))
    edges, _ = C.written(host_edges(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))), "host-edges")
    hosts = judged.select("host").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    trust = personalised_rank(edges, _seeds(_trusted(judged).unionByName(_whole(hosts, "allow", rules)).distinct()), steps=None)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(back, _seeds(_whole(hosts, "block", rules)), steps=None)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    scores, _ = C.written(scores, "host-scores")
    zero = F.lit(0.0)
    out = judged.join(scores, "host", "left").select("page_id", "host", "path", "judged", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
    by_method = F.when(F.col("distrust") > threshold * F.col("trust") + FLOOR, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), F.coalesce("judged.verdict", by_method).alias("verdict"), "trust", "distrust")


def op5_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(C.load(spark, sf_dir, "pages"))
