"""Personal data by weak supervision, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; looser patterns find candidates
for more. Four labelers vote for, against or not at all on each: the strict patterns with their checks, the
candidate's shape, gazetteers (top-level domains, calling codes and trunk prefixes, address blocks, issuer
prefixes) and cue words before it. Votes are counted by pattern, a table of at most KINDS x 81 x 9 rows whatever
the corpus; on it expectation-maximisation estimates how reliable each labeler is and how likely each pattern is
private, and a logistic classifier is trained on these soft labels, one weight for each kind, vote and feature that
no labeler sees: what stands beside the span and how it is grouped. It scores every candidate as a column expression.
Base spans stay; a candidate is added when its score reaches THRESHOLD, a cue or a gazetteer speaks for it, no strict
check has refused all of it and it overlaps no base span. A refused fragment refuses nothing longer than itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C

#: Kinds in their order. The patterns are those of the task in a form that never backtracks far: a match can only
#: begin where a run of its first characters begins, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?|\.)[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){5,7}+|(?=[0-9A-Fa-f:]{0,39}::)(?=:*+[0-9A-Fa-f])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\(0?[0-9]{2,4}\)|0[0-9]{2,4}|[0-9]{3})[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,5}(?![0-9])",
}
KINDS = list(BASE)
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_HINT = {"email": r"(?i)[\[({]at[\])}]|[\[({ ]dot[\])} ]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]|::", "card": r"[0-9][ ./_-]?[0-9]", "phone": r"[0-9)][ ./-][0-9]"}
# Gazetteers: fixed values.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|jp|in"
CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|62"
TRUNK = r"\(?0[1-9][0-9]{1,3}\)?[ ./-]"
BLOCKS = "fe80|f[cd][0-9a-f]{2}|2[0-9a-f]{3}|64:ff9b|::"
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|courriel|correo|kontakt)",
    "ip": r"(?i)(\bip\b|ipv6|address|host|server|login|adresse|direcci)",
    "card": r"(?i)(card|visa|master|amex|credit|debit|karte|carte|tarjeta|pan\b)",
    "phone": r"(?i)(phone|tel\b|tel[.:]|telef|t[ée]l[ée]phone|call|mobile|cell|fax|whatsapp|anruf|llam|\bring\b|\bdial|number is|rufnummer)",
}
AGAINST = r"(?i)(version|isbn|issn|doi|page|section|fig|order|invoice|serial|price|\bid\b|\bno\b|\bnr\b|[$€£#])\W{0,3}$"
LABELERS = ("strict", "shape", "gazetteer", "context")
#: What the classifier sees and no labeler does: the characters beside the span, and its grouping.
FEATURES = ("beside", "grouped")
THRESHOLD, BEFORE = 0.8, 24
PRIOR_VOTES = 20.0
#: Matches of a text that are placed before their spans are put to the others.
RUN = 64


def _found(df: DataFrame, text: Column, name: str, pattern: str, hint: str) -> DataFrame:
    """Adds ``name``: the leftmost matches that do not overlap, as structs (start, end, value) in code points."""
    none = F.array().cast("array<string>")
    some = F.regexp_like(text, F.lit(hint))
    df = df.withColumn(f"{name}_h", F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none))
    hits = F.col(f"{name}_h")
    df = df.withColumn(f"{name}_p", F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(none))
    both = F.zip_with(hits, F.slice(F.col(f"{name}_p"), F.lit(1), F.size(hits)), lambda v, p: F.struct(v.alias("v"), F.length(p).alias("gap")))
    none_yet = F.array().cast("array<struct<start: int, end: int, value: string>>")
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + F.length(x["v"])).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + F.length(x["v"])).alias("end"), x["v"].alias("value")))).alias("out"),
    )
    # Runs of RUN matches: within one the spans so far are copied at each match, beyond it only once a run.
    runs = F.transform(F.sequence(F.lit(0), F.expr("0") + ((F.size(hits) - 1) / RUN).cast("int")), lambda i: F.slice(both, i * RUN + 1, F.lit(RUN)))
    inner = lambda s, run: F.aggregate(run, F.struct(s["at"].alias("at"), none_yet.alias("out")), step)
    outer = lambda s, r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start: int, end: int, value: string>>>").alias("out"))
    spans = F.when(F.size(hits) > 0, F.flatten(F.aggregate(runs, start, lambda s, run: outer(s, inner(s, run)), lambda s: s["out"]))).otherwise(none_yet)
    return df.withColumn(name, spans).drop(f"{name}_h", f"{name}_p")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: digits.substr(n - i, F.lit(1)).cast("int")
    one = lambda i: F.when(i % 2 == 0, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _candidate(text: Column, kind: str, x: Column, strict: Column) -> Column:
    v, digits = x["value"], F.regexp_replace(x["value"], "[^0-9]", "")
    before = F.substring(text, F.greatest(F.lit(1), x["start"] - (BEFORE - 1)), F.least(x["start"], F.lit(BEFORE)))
    n = F.length(digits)
    shape = {
        "email": _vote(F.length(v).between(6, 80), F.length(v) > 120), "ip": _vote(v.rlike(r"^[0-9A-Fa-f:.]{7,39}$"), F.length(v) > 45),
        "card": _vote(n.between(13, 19) & luhn(digits), ~n.between(13, 19) | ~luhn(digits)), "phone": _vote(n.between(9, 13) & v.rlike("[ ().-]"), ~n.between(8, 15)),
    }[kind]
    gaz = {
        "email": _vote(v.rlike(rf"(?i)(?:\.|dot[\])}}]? ?)(?:{DOMAINS})$"), F.lit(False)), "ip": _vote(v.rlike(f"(?i)^(?:{BLOCKS})"), v.rlike(r"^(?:0|127|255)\.")),
        "card": _vote(digits.rlike(f"^(?:{ISSUERS})"), ~digits.rlike("^[2-6]")), "phone": _vote(v.rlike(rf"^(?:\+(?:{CODES})|{TRUNK})"), v.rlike(r"^\+0")),
    }[kind]
    context = _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
    after = F.substring(text, x["end"] + 1, 1)
    open_, shut = r"[\s(\[{<\"':;,=]$", r"^[\s)\]}>\"':;,.!?]"
    left, right = (before == "") | before.rlike(open_), (after == "") | after.rlike(shut)
    groups = F.size(F.split(v, r"[ ./()_:@-]+"))
    features = (_vote(left & right, ~left & ~right).alias("beside"), _vote(groups.between(2, 5), groups > 8).alias("grouped"))
    votes = (strict.alias("strict"), shape.alias("shape"), gaz.alias("gazetteer"), context.alias("context"))
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *votes, *features)


def _judged(text: Column, kind: str, strict: bool):
    def vote(v: Column) -> Column:
        yes = F.when(_holds(kind, v), 1)
        if kind == "card":  # the check knows 16 to 19 digits only and says nothing of the shorter cards
            digits = F.regexp_replace(v, "[^0-9]", "")
            yes = yes.when(F.length(digits).between(13, 15) & luhn(digits), 0)
        return yes.otherwise(-1)

    return lambda x: _candidate(text, kind, x, vote(x["value"]) if strict else F.lit(0))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """pii_row, the columns of ``docs`` as a struct, and pii_base, pii_more, pii_refused: arrays of structs (kind, start, end, and the four votes), by kind and start."""
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("pii_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("pii_text"))
    t = F.col("pii_text")
    for kind in KINDS:
        out = _found(out, t, f"pii_b_{kind}", BASE[kind], HINT[kind])
        out = _found(out, t, f"pii_l_{kind}", LOOSE[kind], LOOSE_HINT[kind])
    base, more = [], []
    for kind in KINDS:
        base.append(F.transform(F.col(f"pii_b_{kind}"), _judged(t, kind, strict=True)))
        more.append(F.transform(F.col(f"pii_l_{kind}"), _judged(t, kind, strict=False)))
    keep = [F.col("pii_row")]
    out = out.select(*keep, F.concat(*base).alias("pii_seen"), F.concat(*more).alias("pii_loose"))
    seen = F.col("pii_seen")
    base = F.filter(seen, lambda x: x["strict"] == 1)
    # A candidate lies apart from every base span, and not within what the strict check of its own kind has refused.
    meets = lambda b, x: (b["strict"] == 1) & (b["start"] < x["end"]) & (x["start"] < b["end"])
    within = lambda b, x: (b["strict"] == -1) & (b["kind"] == x["kind"]) & (b["start"] <= x["start"]) & (x["end"] <= b["end"])
    apart = lambda x: ~F.exists(seen, lambda b: meets(b, x) | within(b, x))
    return out.select(*keep, base.alias("pii_base"), F.filter(F.col("pii_loose"), apart).alias("pii_more"), F.filter(seen, lambda x: x["strict"] == -1).alias("pii_refused"))


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> dict[tuple, float]:
    """Expectation-maximisation over (kind, votes, count): how likely each (kind, votes) is private.

    Votes are taken as independent given the truth, and a labeler that does not vote says nothing. It starts
    as right in 0.8 of its votes, with the weight of PRIOR_VOTES, and is never taken to be worse than chance.
    Whatever the strict patterns and their checks accept is private, and what they refuse is not.
    """
    prior = dict.fromkeys({k for k, _, _ in counts}, 0.5)
    # table[i][truth]: how often labeler i votes for, when it votes
    table = [[0.2, 0.8] for _ in LABELERS]
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, votes, _n in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for t, v in zip(table, votes[: len(LABELERS)], strict=True):
                if v:
                    odds += math.log(t[1] / t[0]) if v > 0 else math.log((1 - t[1]) / (1 - t[0]))
            posterior[kind, votes] = 1.0 if votes[0] > 0 else 0.0 if votes[0] < 0 else 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for kind in prior:
            rows = [(n, posterior[k, v]) for k, v, n in counts if k == kind]
            prior[kind] = (PRIOR_VOTES / 2 + sum(n * p for n, p in rows)) / (PRIOR_VOTES + sum(n for n, _ in rows))
        for i, t in enumerate(table):
            for truth in (0, 1):
                cast = [(n * (posterior[k, v] if truth else 1 - posterior[k, v]), v[i] > 0) for k, v, n in counts if v[i]]
                t[truth] = (PRIOR_VOTES * (0.8 if truth else 0.2) + sum(n for n, yes in cast if yes)) / (PRIOR_VOTES + sum(n for n, _ in cast))
            if t[1] < t[0]:
                t[0] = t[1] = (t[0] + t[1]) / 2
    return posterior


def train(counts: list[tuple[str, tuple[int, ...], int]], posterior: dict[tuple, float], rounds: int = 400, rate: float = 0.5, decay: float = 0.01) -> dict:
    """Logistic regression on the soft labels; keys are kinds and (labeler, vote). Gradient steps over the counted patterns."""
    weight: dict = {}
    total = sum(c for _, _, c in counts) or 1
    rows = [((k, *((name, v) for name, v in zip(LABELERS + FEATURES, vs, strict=True) if v)), c / total, posterior[k, vs]) for k, vs, c in counts]
    for _ in range(rounds):
        slope: dict = {}
        for keys, share, y in rows:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weight.get(x, 0.0) for x in keys)))))
            for x in keys:
                slope[x] = slope.get(x, 0.0) + share * (p - y)
        for x, g in slope.items():
            weight[x] = weight.get(x, 0.0) - rate * 4 * (g + decay * weight.get(x, 0.0) / len(rows))
    return weight


def score(x: Column, weight: dict) -> Column:
    total = F.lit(0.0)
    for kind in KINDS:
        total = total + F.when(x["kind"] == kind, F.lit(float(weight.get(kind, 0.0)))).otherwise(0.0)
    for name in LABELERS + FEATURES:
        for v in (-1, 1):
            total = total + F.when(x[name] == v, F.lit(float(weight.get((name, v), 0.0)))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def personal_data(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with pii_base and pii_added, arrays of structs (kind, start, end) by kind as listed, then start.

    Where ``docs`` has columns of these names, in any case, the new ones have a line after theirs.

    Offsets count code points, the end is exclusive. Null and empty texts have no spans; very long ones are read whole. Each
    row is judged by itself, so repeated rows get the same spans. A table without candidates, or without rows, adds none.
    """
    seen = candidates(docs, text)
    every = seen.select(F.explode(F.concat("pii_base", "pii_refused", "pii_more")).alias("x"))
    names = LABELERS + FEATURES
    counts = every.groupBy("x.kind", *(f"x.{n}" for n in names)).agg(F.count("*").alias("n")).collect()  # at most 4 x 81 x 9 rows
    rows = sorted((r["kind"], tuple(r[n] for n in names), r["n"]) for r in counts)
    weight = train(rows, estimate(rows)) if rows else {}
    wanted = F.filter(F.col("pii_more"), lambda x: ((x["context"] == 1) | (x["gazetteer"] == 1)) & (score(x, weight) >= threshold))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    names = [C.unused(docs, n) for n in ("pii_base", "pii_added")]
    return seen.select(*(F.col("pii_row")[c].alias(c) for c in docs.columns), bare(F.col("pii_base")).alias(names[0]), bare(wanted).alias(names[1]))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns; each span's text becomes ``[KIND]``, and n_chars follows where there is one.

    Spans of several kinds that overlap are replaced as one, by the first one's kind.
    """
    found = personal_data(docs)
    base, added = (F.col(c) for c in found.columns[-2:])
    spans = F.array_sort(F.transform(F.concat(base, added), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    row = found.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("pii_row"), F.col("text").cast("string").alias("pii_text"), spans.alias("pii_spans"))
    t, spans, n = F.col("pii_text"), F.col("pii_spans"), F.size("pii_spans")
    # The farthest end of the spans so far, by running maxima: a span may lie inside an earlier one.
    top = lambda s, x: F.greatest(s, x["end"])
    runs = F.transform(F.sequence(F.lit(0), ((n - 1) / RUN).cast("int")), lambda i: F.slice(spans, i * RUN + 1, F.lit(RUN)))
    far = F.transform(runs, lambda run: F.array_max(F.transform(run, lambda x: x["end"])))
    upto = lambda k: F.aggregate(F.slice(far, F.lit(1), k), F.lit(0), lambda s, e: F.greatest(s, e))
    ends = F.flatten(F.transform(runs, lambda run, k: F.transform(run, lambda x, i: F.aggregate(F.slice(run, F.lit(1), i + 1), upto(k), top))))
    before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), n - 1))
    piece = lambda x, at: F.when(x["start"] < at, F.lit("")).otherwise(F.concat(F.substring(t, at + 1, x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = F.substring(t, F.element_at(ends, -1) + 1, F.length(t))
    text = F.when(n == 0, t).otherwise(F.concat(F.array_join(F.zip_with(spans, before, piece), ""), tail))
    out = row.select("pii_row", n.alias("pii_n"), text.alias("pii_new"))
    new = {"text": F.col("pii_new").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("pii_n") > 0, F.length("pii_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("pii_row")["n_chars"])
    return out.select(*((new[c] if c in new else F.col("pii_row")[c]).alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed and then start."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(C.load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.concat("pii_base", "pii_added")).alias("spans"))
