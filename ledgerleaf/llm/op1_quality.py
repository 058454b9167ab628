"""Quality rules: base counts, then robust multivariate outliers by minimum covariance determinant.

Every document's counts become a vector of transformed statistics. For each language and source, for each
language and for all together, concentration steps look for the three quarters of the distinct vectors whose
covariance determinant is least: distances from the present centre, their quantile, then mean and covariance
of the vectors within it. They begin at several deterministic estimates and go on until the determinant no
longer falls; of the ends, the one with the least determinant counts. A document is judged by the finest of
the three groups with enough vectors, and rejected when its squared Mahalanobis distance exceeds a chi-square
quantile. All of it is DataFrame aggregation; nothing per document leaves the executors, and no step gathers a
group.

Five-word windows are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Transformed statistics with the least standard deviation that counts: smaller spread is not evidence of an outlier.
VECTOR = {
    "x_length": ("ln(1 + n_words)", 0.5),
    "x_word": ("ln((word_chars + 10.0) / (n_words + 2.0))", 0.1),
    "x_symbols": ("sqrt(n_symbols / (n_words + 20.0))", 0.12),
    "x_lines": ("sqrt(n_dup_lines / (n_lines + 5.0))", 0.15),
    "x_repeat": ("sqrt(n_repeat_words / (n_words + 20.0))", 0.12),
    "x_upper": ("sqrt(n_upper / (word_chars + 50.0))", 0.12),
}
DIMS = list(VECTOR)
#: The tail and the least deviations go by what is lost of clean documents. On sf0.1, of those that pass the base rules,
#: a tail of 0.01 rejects 2 of 3330 labelled clean, 293 of 301 labelled bad and 202 of 203 'w | w | w' ones; with half
#: the deviations it rejects 70 clean and 297 bad ones, with a tenth 359 and 299.
CORE, MIN_GROUP, TAIL = 0.75, 200, 0.01
#: Concentration steps at most, and the fall of the determinant's logarithm that counts as one.
STEPS, FALL = 40, 1e-3
#: Groups are broadcast up to so many rows of some thirty numbers; beyond, Spark shuffles both sides.
BROADCAST_GROUPS = 20_000


def _windows(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds ``name``: a hash for each five words in a row, put together from hashes of one, two and four.

    Each step is a column of its own, since an expression that is used twice inside another would be evaluated twice.
    """
    one, two, four = (C.unused(df, f"{name}_{k}") for k in (1, 2, 4))
    n = F.size(words)
    pair = lambda a, b: F.xxhash64(a, b)
    cut = lambda x, first, less: F.slice(F.col(x), F.lit(first), F.greatest(n - less, F.lit(0)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(one, F.when(n >= 6, F.transform(words, lambda w: F.xxhash64(w))).otherwise(none))
    df = df.withColumn(two, F.when(n >= 6, F.zip_with(cut(one, 1, 1), cut(one, 2, 1), pair)).otherwise(none))
    df = df.withColumn(four, F.when(n >= 6, F.zip_with(cut(two, 1, 3), cut(two, 3, 3), pair)).otherwise(none))
    return df.withColumn(name, F.when(n >= 6, F.zip_with(cut(four, 1, 4), cut(one, 5, 4), pair)).otherwise(none)).drop(one, two, four)


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs again: of the windows in order of their hashes, those beside an equal one."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    beside = F.zip_with(
        placed, F.concat(F.array(F.lit(None).cast("bigint")), F.slice(placed["h"], F.lit(1), n - 1)), lambda x, before: F.struct(x["h"].alias("h"), x["i"].alias("i"), before.alias("b"))
    )
    beside = F.zip_with(beside, F.concat(F.slice(placed["h"], F.lit(2), n - 1), F.array(F.lit(None).cast("bigint"))), lambda x, after: F.when((x["h"] == x["b"]) | (x["h"] == after), x["i"]))
    at = F.sort_array(F.filter(beside, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
    return F.aggregate(at, start, lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")))["n"]


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (long)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    q, a, b, d = (C.unused(docs, n) for n in ("q", "q_words", "q_windows", "q_lines"))
    bare = F.btrim(t, F.lit(WHITE))
    out = docs.withColumn(a, F.when(bare != "", F.split(bare, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>")))
    w = F.col(a)
    out = _windows(out, a, b)
    out = out.withColumn(d, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    windows, lines = F.col(b), F.col(d)
    # Most documents repeat nothing: their windows are as many as their distinct windows, and are not sorted.
    covered = F.when(F.size(F.array_distinct(windows)) < F.size(windows), _covered(windows)).otherwise(F.lit(0))
    return out.withColumn(
        q,
        F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        ),
    ).drop(a, b, d)


def chi_square_quantile(tail: float, dims: int) -> float:
    """By bisection on the survival function of an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        if chi_square_tail(x, dims) > tail:
            low = x
        else:
            high = x
    return high


def chi_square_tail(x: float, dims: int) -> float:
    half = x / 2
    return math.exp(-half) * sum(half**k / math.factorial(k) for k in range(dims // 2))


def _consistency(core: float, dims: int) -> float:
    """Factor by which the core's covariance falls short of a normal population's."""
    q = chi_square_quantile(1 - core, dims)
    return core / (1 - chi_square_tail(q, dims + 2))


def _with_factor(groups: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor l_i_j of the covariance v_i_j, its diagonal held up by the least deviations."""
    for i, di in enumerate(DIMS):
        cols = {}
        for j in range(i):
            inner = reduce(lambda x, y: x + y, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)], F.lit(0.0))
            groups = groups.withColumn(f"l_{i}_{j}", (F.col(f"v_{i}_{j}") - inner) / F.col(f"l_{j}_{j}"))
        inner = reduce(lambda x, y: x + y, [F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}") for k in range(i)], F.lit(0.0))
        floor = VECTOR[di][1] ** 2
        cols[f"l_{i}_{i}"] = F.sqrt(F.greatest(F.col(f"v_{i}_{i}") + floor - inner, F.lit(floor)))
        groups = groups.withColumns(cols)
    keep = [*KEYS, "start", "size", *(f"m_{i}" for i in range(len(DIMS))), *(f"l_{i}_{j}" for i in range(len(DIMS)) for j in range(i + 1))]
    logdet = reduce(lambda x, y: x + y, [2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(DIMS))])
    return groups.select(*keep, logdet.alias("logdet"))


def _squared_distance(df: DataFrame, name: str) -> DataFrame:
    """Forward substitution, a column a step, then the sum of squares."""
    for i, d in enumerate(DIMS):
        inner = reduce(lambda x, y: x + y, [F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)], F.lit(0.0))
        df = df.withColumn(f"z_{i}", (F.col(d) - F.col(f"m_{i}") - inner) / F.col(f"l_{i}_{i}"))
    total = reduce(lambda x, y: x + y, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(DIMS))])
    return df.withColumn(name, total)


KEYS = ["grp_level", "grp_lang", "grp_source"]


def _moments(near: DataFrame, centre: dict[str, Column]) -> DataFrame:
    """Size, mean m_i and covariance v_i_j of each group and start, by sums of products around a centre."""
    off = {i: (F.col(d) - centre[d]) for i, d in enumerate(DIMS)}
    aggs = [F.count("*").alias("size"), *(F.sum(off[i]).alias(f"s_{i}") for i in off), *(F.first(centre[d]).alias(f"c_{i}") for i, d in enumerate(DIMS))]
    aggs += [F.sum(off[i] * off[j]).alias(f"p_{i}_{j}") for i in off for j in range(i + 1)]
    sums = near.groupBy(*KEYS, "start").agg(*aggs)
    mean = [(F.col(f"c_{i}") + F.col(f"s_{i}") / F.col("size")).alias(f"m_{i}") for i in off]
    cov = [(F.col(f"p_{i}_{j}") / F.col("size") - F.col(f"s_{i}") / F.col("size") * F.col(f"s_{j}") / F.col("size")).alias(f"v_{i}_{j}") for i in off for j in range(i + 1)]
    return _with_factor(sums.select(*KEYS, "start", "size", *mean, *cov))


def _small(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _first_estimates(rows: DataFrame, middle: DataFrame) -> DataFrame:
    """Three starts for each group, all of its coordinates put on their median and median deviation.

    "diagonal": no correlation; "tanh": the correlation of hyperbolic tangents; "sign": that of directions.
    """
    n = len(DIMS)
    spread = rows.join(_small(middle), KEYS).groupBy(*KEYS).agg(*(F.percentile_approx(F.abs(F.col(d) - F.col(f"m_{i}")), 0.5, 2000).alias(f"s_{i}") for i, d in enumerate(DIMS)))
    scale = {i: F.sqrt(F.pow(F.col(f"s_{i}") * 1.4826, 2) + VECTOR[d][1] ** 2) for i, d in enumerate(DIMS)}
    known, _ = C.written(middle.join(spread, KEYS).select(*middle.columns, *(x.alias(f"k_{i}") for i, x in scale.items())), "spreads")
    z = rows.join(_small(known), KEYS).select(*KEYS, *((F.col(d) - F.col(f"m_{i}")).alias(f"y_{i}") for i, d in enumerate(DIMS)), *(f"k_{i}" for i in range(n)))
    z = z.select(*KEYS, *((F.col(f"y_{i}") / F.col(f"k_{i}")).alias(f"z_{i}") for i in range(n)))
    norm = F.sqrt(reduce(lambda x, y: x + y, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(n)]))
    z = z.withColumns({"norm": norm, **{f"t_{i}": F.tanh(F.col(f"z_{i}")) for i in range(n)}})
    z = z.withColumns({f"u_{i}": F.when(F.col("norm") > 0, F.col(f"z_{i}") / F.col("norm")).otherwise(0.0) for i in range(n)})
    products = z.groupBy(*KEYS).agg(*(F.sum(F.col(f"{x}_{i}") * F.col(f"{x}_{j}")).alias(f"{x}_{i}_{j}") for x in "tu" for i in range(n) for j in range(i + 1)))
    wide = known.join(products, KEYS)

    def start(name: str, x: str | None) -> DataFrame:
        r = lambda i, j: F.col(f"{x}_{i}_{j}") / F.sqrt(F.greatest(F.col(f"{x}_{i}_{i}") * F.col(f"{x}_{j}_{j}"), F.lit(1e-300)))
        v = lambda i, j: (F.lit(1.0) if i == j else 0.98 * r(i, j) if x else F.lit(0.0)) * F.col(f"k_{i}") * F.col(f"k_{j}")
        cols = [v(i, j).alias(f"v_{i}_{j}") for i in range(n) for j in range(i + 1)]
        return wide.select(*KEYS, F.lit(name).alias("start"), "size", *(f"m_{i}" for i in range(n)), *cols)

    return _with_factor(start("diagonal", None).unionByName(start("tanh", "t")).unionByName(start("sign", "u")))


#: A quantile's summary for each group and start is kept by hash, not by sorting all rows (a task's summaries hold its
#: rows' numbers at most), and code that is too long for the JVM's compiler is not joined into one method.
FIT_CONF = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096", "spark.sql.codegen.hugeMethodLimit": "8000"}


def fit(stats: DataFrame, core: float = CORE, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """Centre and Cholesky factor for each language and source, each language ('' as source) and all.

    ``stats`` has q_lang, q_source and the vector. Distinct vectors count once in a group, so copies do not
    shrink its scatter. Groups of fewer than ``min_group`` distinct vectors are left out. Each start of a group
    goes on while its determinant falls; the least determinant of a group's starts is kept.
    """
    conf = stats.sparkSession.conf
    before = {k: conf.get(k) for k in FIT_CONF}
    try:
        for k, v in FIT_CONF.items():
            conf.set(k, v)
        return _fitted(stats, core, steps, min_group)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _fitted(stats: DataFrame, core: float, steps: int, min_group: int) -> DataFrame:
    spark = stats.sparkSession
    each = stats.select("q_lang", "q_source", *DIMS).distinct()
    level = F.explode(F.array(*(F.struct(F.lit(n).alias("grp_level"), lang.alias("grp_lang"), source.alias("grp_source")) for n, lang, source in ((0, F.lit(""), F.lit("")), (1, F.col("q_lang"), F.lit("")), (2, F.col("q_lang"), F.col("q_source"))))))
    rows = each.select(level.alias("g"), *DIMS).select("g.*", *DIMS)
    rows, rows_at = C.written(rows, "vectors")
    # The first centre and scale of each coordinate are its median and median absolute deviation.
    middle = rows.groupBy(*KEYS).agg(F.count("*").alias("size"), *(F.percentile_approx(d, 0.5, 2000).alias(f"m_{i}") for i, d in enumerate(DIMS))).where(F.col("size") >= min_group)
    middle, middle_at = C.written(middle, "medians")
    now, at = C.written(_first_estimates(rows, middle), "groups")
    ends, paths = [], [rows_at, middle_at]
    shape = [c for c in now.columns if c not in (*KEYS, "start")]
    for step in range(steps):
        near = _squared_distance(rows.join(_small(now), KEYS), "d2")
        edge, edge_at = C.written(near.groupBy(*KEYS, "start").agg(F.percentile_approx("d2", core, 2000).alias("edge")), "edges")
        inside = near.join(_small(edge), [*KEYS, "start"]).where("d2 <= edge")
        new = _moments(inside, {d: F.col(f"m_{i}") for i, d in enumerate(DIMS)})
        before = now.select(*KEYS, "start", F.col("logdet").alias("was"))
        moved, moved_at = C.written(new.join(before, [*KEYS, "start"]).withColumn("falls", F.lit(step == 0) | (F.col("logdet") < F.col("was") - FALL)), "groups")
        paths += [at, edge_at, moved_at]
        last = step == steps - 1
        ends.append(moved.select(*KEYS, *shape) if last else moved.where(~F.col("falls")).select(*KEYS, *shape))
        now, at = moved.where("falls").drop("was", "falls"), moved_at
        if last or now.isEmpty():
            break
    found = reduce(DataFrame.unionByName, ends)
    best = found.groupBy(*KEYS).agg(F.min(F.struct("logdet", *(c for c in shape if c != "logdet"))).alias("x"))
    out, _ = C.written(best.select(*KEYS, *(F.col(f"x.{c}").alias(c) for c in shape if c != "logdet")), "fit")
    C.dropped(spark, *dict.fromkeys(paths))
    return out


def judge(docs: DataFrame, carry: list[str], tail: float = TAIL) -> DataFrame:
    """The columns of ``docs`` in ``carry``, and a struct q with counts, distance, base_failed and kept.

    Null or empty texts, and texts without words, have counts of 0 and fail. Null languages or sources form a
    group of their own. Where no group has enough vectors nothing is rejected beyond the base rules. Rows that
    repeat are each judged, alike. Vectors at equal distances are within the core together. A very long text is one
    row as any other. ``carry`` may hold columns of any name, also those used here. An empty table gives no rows.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) if c in docs.columns else F.lit("\x00") for c in ("lang", "source"))
    slim = docs.select(*carry, *([] if "text" in carry else ["text"]), lang.alias("q_lang_"), source.alias("q_source_"))
    counted = base_counts(slim)
    q = next(c for c in counted.columns if c not in slim.columns)
    kept = [F.col(c).alias(f"c{i}_") for i, c in enumerate(carry)]
    counted = counted.select(*kept, F.col("q_lang_").alias("q_lang"), F.col("q_source_").alias("q_source"), F.col(f"{q}.*"))
    counted = counted.withColumns({d: F.expr(e) for d, (e, _) in VECTOR.items()})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted, _ = C.written(counted.withColumn("base_failed", failed), "quality")
    groups = fit(counted.where("n_words > 0"))
    factor = _consistency(CORE, len(DIMS))
    cols = [c for c in groups.columns if c not in KEYS]
    shape = F.struct(*cols)
    one = lambda level: groups.where(F.col("grp_level") == level)
    fine = one(2).select(F.col("grp_lang").alias("q_lang"), F.col("grp_source").alias("q_source"), shape.alias("g2"))
    coarse = one(1).select(F.col("grp_lang").alias("q_lang"), shape.alias("g1"))
    whole = one(0).select(shape.alias("g0"))
    # All groups of a document at once, so that one join on language and source serves the three levels.
    pairs = counted.select("q_lang", "q_source").distinct().join(fine, ["q_lang", "q_source"], "left").join(coarse, "q_lang", "left").join(F.broadcast(whole), how="left")
    pairs, _ = C.written(pairs.select("q_lang", "q_source", F.coalesce("g2", "g1", "g0").alias("g")), "groups-of")
    joined = _squared_distance(counted.join(pairs, ["q_lang", "q_source"], "left").select("*", "g.*").drop("g"), "raw")
    distance = F.coalesce(F.col("raw") / factor, F.lit(0.0))
    limit = chi_square_quantile(tail, len(DIMS))
    return joined.select(
        *(F.col(f"c{i}_").alias(c) for i, c in enumerate(carry)),
        F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (distance <= limit)).alias("kept"), distance.alias("distance")).alias(C.unused(docs, "q")),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, without the rows that the rules reject."""
    judged = judge(docs, docs.columns)
    q = C.unused(docs, "q")
    return judged.where(F.col(f"{q}.kept")).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    judged = judge(docs, ["doc_id"])
    return judged.select("doc_id", f"{judged.columns[-1]}.*")
