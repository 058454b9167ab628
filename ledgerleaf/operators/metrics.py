"""Ranking, grounding and latency metrics as grouped aggregations over long tables of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.session import settled


def judged(hits: DataFrame, relevant: DataFrame, by=("system",)) -> DataFrame:
    """Hits (…, query_id, node_id, rank) with rel 0/1; ``relevant`` has distinct (query_id, node_id)."""
    # Relevant pairs grow with the square of the tables, hits do not: only those that were hit are joined.
    met = relevant.join(hits.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi").withColumn("rel", F.lit(1))
    return hits.join(met, ["query_id", "node_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(hits: DataFrame, relevant: DataFrame, k: int, by=("system",), total: DataFrame | None = None) -> DataFrame:
    """recall, precision, hit, mrr, ap and ndcg of each query at k. Precision divides by k, AP by all relevant; the ideal gain is of the retrieved items.

    With ``total`` (query_id, n_rel), ``relevant`` need have no more than the pairs that were hit.
    """
    w = Window.partitionBy(*by, "query_id").orderBy("rank")
    best = Window.partitionBy(*by, "query_id").orderBy(F.desc("rel"), "rank")
    rows = judged(settled(hits, "hits"), relevant, by).withColumns({"cum": F.sum("rel").over(w), "ideal": F.row_number().over(best)})
    gain = lambda at: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col(at) + 1.0)
    inside = F.col("rank") <= k
    agg = rows.groupBy(*by, "query_id").agg(
        F.sum(F.when(inside, F.col("rel")).otherwise(0)).alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("cum") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(inside, gain("rank")).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain("ideal")).otherwise(0.0)).alias("idcg"),
    )
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel")) if total is None else total
    out = agg.join(total, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return out.select(
        *by, "query_id", share("hits", "n_rel").alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), share("precisions", "n_rel").alias("ap"), share("dcg", "idcg").alias("ndcg"),
    )


def nearest_rank_p95(value: Column) -> Column:
    """The element at position floor(0.95 n) of the sorted values, not interpolated."""
    values = F.sort_array(F.collect_list(value))
    return F.get(values, F.least(F.size(values) - 1, F.floor(0.95 * F.size(values))).cast("int"))


def p95(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The same by ranks, for groups of any size: no group is gathered."""
    w, n = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(w).alias("r"), F.count("*").over(n).alias("n"))
    return ranked.where(F.col("r") == F.least(F.col("n"), F.floor(0.95 * F.col("n")) + 1)).select(*by, F.col(value).alias("p95"))


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    agg = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("p50"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return agg.join(p95(rows, by, value), by)


def token_f1(reference: Column, answer: Column) -> Column:
    """F1 of the distinct tokens."""
    same = F.size(F.array_intersect(reference, answer))
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(reference) + F.size(answer)))


def coverage(wanted: Column, had: Column) -> Column:
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, had)) / F.size(wanted))


def composite(retrieval: Column, generation: Column, performance: Column) -> Column:
    return 0.4 * retrieval + 0.4 * generation + 0.2 * performance


def latency_score(ms: Column, budget: float = 5000.0) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - ms / budget)


def failures(rows: DataFrame) -> DataFrame:
    """Counts of failure categories over per-query rows (recall, hierarchy, faithfulness, hallucination, confidence, ms)."""
    cats = {
        "section_miss": F.col("recall") == 0, "hierarchy_miss": F.col("hierarchy") < 1, "low_faithfulness": F.col("faithfulness") < 0.5,
        "high_hallucination": F.col("hallucination") > 0.5, "low_confidence": F.col("confidence") < 0.45, "slow_query": F.col("ms") > 5000,
    }
    wide = rows.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in cats.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in cats))).alias("x")).select("x.*")


def semantic_similarity(pairs: DataFrame, key: str, a: str, b: str, embed) -> DataFrame:
    """(key, cosine, relevance): of the embeddings of two texts; relevance is never below 0, and a text without tokens has none.

    Texts count by the digest of their trimmed lower-case form, and each distinct one is embedded once. ``embed`` turns
    (digest, text) into a sparse table (digest, bucket, weight), which is written and serves both sides.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    digest = lambda c: F.md5(plain(F.col(c)).cast("binary"))
    rows = pairs.select(key, digest(a).alias("da"), digest(b).alias("db"))
    texts = pairs.select(F.explode(F.array(plain(F.col(a)), plain(F.col(b)))).alias("text")).distinct()
    vectors = settled(embed(texts.select(F.md5(F.col("text").cast("binary")).alias("digest"), "text"), "digest", "text").where("weight <> 0"), "embedded")
    norms = vectors.groupBy("digest").agg(F.sum(F.col("weight") * F.col("weight")).cast("double").alias("n"))
    want = rows.select("da", "db").distinct()
    side = lambda d, w: vectors.select(F.col("digest").alias(d), "bucket", F.col("weight").alias(w))
    dots = want.join(side("da", "wa"), "da").join(side("db", "wb"), ["db", "bucket"]).groupBy("da", "db").agg(F.sum(F.col("wa") * F.col("wb")).cast("double").alias("dot"))
    dots = dots.join(norms.select(F.col("digest").alias("da"), F.col("n").alias("na")), "da").join(norms.select(F.col("digest").alias("db"), F.col("n").alias("nb")), "db")
    cosine = F.coalesce(F.col("dot") / F.sqrt(F.col("na") * F.col("nb")), F.lit(0.0))
    return rows.join(dots, ["da", "db"], "left").select(key, cosine.alias("cosine"), F.greatest(F.lit(0.0), cosine).alias("relevance"))


def contained(needles: DataFrame, texts: DataFrame, needle: str, key: str) -> DataFrame:
    """(needle, key) where a text contains a needle's text as a substring; both have their ``text``.

    The words of a needle other than its first and last stand whole in any text that contains it. So a needle meets only
    texts that have its rarest run of three of them (of all of them, if they are fewer), and is looked for there. A needle
    of one or two words has no such run and is looked for in every text. Null texts contain and are contained in nothing.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), 0)
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    # What is longer than the longest text is in none: one number.
    longest = texts.agg(F.coalesce(F.max(F.length("text")), F.lit(-1))).first()[0]
    needles = needles.where(F.length("text") <= longest)
    inner = needles.select(needle, "text", words(F.col("text")).alias("w"))
    inner = inner.select(needle, "text", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))).alias("w")).withColumn("n", F.least(F.lit(3), F.size("w")))
    short = inner.where("n = 0").select(needle, F.col("text").alias("needle_text"))
    keyed = inner.where("n > 0").select(needle, "n", F.explode(F.array_distinct(runs(F.col("w"), F.col("n")))).alias("run"))
    keyed = settled(keyed, "needle-runs")
    sizes = [r.n for r in keyed.select("n").distinct().collect()]  # 1, 2 and 3 at most
    held = None
    for n in sorted(sizes):
        w = texts.where("text is not null").select(key, words(F.col("text")).alias("w")).where(F.size("w") >= n)
        one = w.select(key, F.lit(n).alias("n"), F.explode(F.array_distinct(runs(F.col("w"), F.lit(n)))).alias("run"))
        held = one if held is None else held.unionByName(one)
    out = texts.join(F.broadcast(short) if short.count() <= SHORT else short, F.contains("text", "needle_text")).select(needle, key)
    if held is None:
        return out
    held = settled(held.join(keyed.select("n", "run").distinct(), ["n", "run"], "left_semi"), "text-runs")
    often = held.groupBy("n", "run").agg(F.count("*").alias("often"))
    # A needle with a run that no text has is in none.
    rare = keyed.join(often, ["n", "run"], "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "n", "run")).alias("x"))
    rare = rare.where("x.often > 0").select(needle, "x.n", "x.run")
    near = held.join(rare, ["n", "run"]).select(needle, key)
    near = near.join(needles.select(needle, F.col("text").alias("needle_text")), needle).join(texts.select(key, "text"), key)
    return out.unionByName(near.where(F.contains("text", "needle_text")).select(needle, key))


#: Needles of one or two words that are broadcast at most.
SHORT = 10_000
