"""Column functions over text: cleaning, detection, tokens, query understanding. All stay in the JVM unless named *_udf."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that are page furniture, case-insensitive.
NOISE = (
    r"^[-\s]*page\s+\d+\s*(?:of\s+\d+)?[-\s]*$",
    r"^\s*[-–—]\s*\d+\s*[-–—]\s*$",
    r"^\s*\d+\s*/\s*\d+\s*$",
    r"downloaded from\s+\w",
    r"©.*?reserved",
    r"this is an? (?:computer|electronic)",
    r"^before the hon'?ble",
    r"^in the (?:supreme|high|district|sessions) court",
    r"^writ petition no",
)
# Unicode blocks by language, in the order that breaks ties.
SCRIPTS = (("hi", "ऀ", "ॿ"), ("bn", "ঀ", "৿"), ("ta", "஀", "௿"), ("te", "ఀ", "౿"), ("kn", "ಀ", "೿"), ("ml", "ഀ", "ൿ"))
# Words that carry no retrieval signal.
STOPWORDS = tuple(
    "a an the and or but of in on at to for with under per vs v act section sec sections article articles rule rules order orders "
    "what which who whom how does do did is are was were be been being about provide provides provided provisions provision means mean "
    "explain explains define defines definition according shall may not any all each".split()
)
# Intents in order of priority with their markers.
INTENTS = (
    ("case_law", ("supreme court", "high court", "judgment", "judgement", "precedent", "case law", "landmark", "air", "scc", "scr")),
    ("definition", ("define", "defined", "definition", "meaning", "means", "mean", "interpretation", "interpret", "construed")),
    ("punishment", ("punish", "punishment", "penalty", "penal", "offence", "offense", "imprison", "imprisonment", "fine", "guilty", "criminal")),
    ("constitutional", ("constitution", "constitutional", "fundamental right", "fundamental rights", "directive principle")),
    ("comparison", ("compare", "comparison", "difference", "differ", "distinguish", "distinction", "versus", "vs", "differentiate", "similar")),
    ("procedural", ("procedure", "procedural", "process", "how to", "how do", "file a", "filed", "complaint", "summon", "summons", "appeal", "jurisdiction", "limitation", "pleading", "pleadings", "evidence act")),
)
BUDGETS = {"definition": 4, "section_lookup": 4, "explanation": 4, "punishment": 7, "procedural": 7, "comparison": 7, "constitutional": 7}
# Surface phrases with the concepts that they stand for, terms and sections by concept.
PHRASES = {
    "forced to sign": ("coercion", "free_consent", "voidable_agreement"),
    "forced to": ("coercion", "free_consent", "voidable_agreement"),
    "threatened": ("coercion", "free_consent", "voidable_agreement"),
    "threatening": ("coercion", "free_consent", "voidable_agreement"),
    "threat": ("coercion", "free_consent", "voidable_agreement"),
    "threats": ("coercion", "free_consent", "voidable_agreement"),
    "duress": ("coercion", "free_consent", "voidable_agreement"),
    "coercion": ("coercion", "free_consent", "voidable_agreement"),
    "false statements": ("fraud", "misrepresentation"),
    "false statement": ("fraud", "misrepresentation"),
    "lied": ("fraud", "misrepresentation"),
    "lies": ("fraud", "misrepresentation"),
    "lying": ("fraud", "misrepresentation"),
    "deceived": ("fraud", "misrepresentation"),
    "deceit": ("fraud", "misrepresentation"),
    "fraud": ("fraud",),
    "offered": ("proposal",),
    "offers": ("proposal",),
    "offer": ("proposal",),
    "proposal": ("proposal",),
    "without consideration": ("consideration",),
    "no consideration": ("consideration",),
    "consideration": ("consideration",),
    "unable to understand": ("capacity",),
    "capacity to contract": ("capacity",),
    "sound mind": ("capacity",),
    "unsound mind": ("capacity",),
    "incompetent": ("capacity",),
    "minor": ("capacity",),
    "position to dominate": ("undue_influence",),
    "undue influence": ("undue_influence",),
    "dominant party": ("undue_influence",),
    "fiduciary": ("undue_influence",),
    "pressured": ("undue_influence",),
    "pressure": ("undue_influence",),
}
CONCEPTS = {
    "coercion": (("coercion",), (15,)), "free_consent": (("free consent",), (14,)), "voidable_agreement": (("voidable agreement", "voidable"), (19, 2)),
    "fraud": (("fraud",), (17,)), "misrepresentation": (("misrepresentation",), (18,)), "proposal": (("proposal",), (2,)), "consideration": (("consideration",), (25, 2)),
    "capacity": (("capacity", "sound mind", "competent"), (11, 12)), "undue_influence": (("undue influence",), (16,)),
}
_ESCAPE = str.maketrans({c: "\\" + c for c in r"\.[]{}()*+?^$|-"})


def clean_noise_lines(text: Column) -> Column:
    """Lines that are headers, footers or page numbers go; blank lines stay."""
    noisy = lambda line: reduce(lambda a, b: a | b, (F.trim(line).rlike("(?i)" + p) for p in NOISE))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~(noisy(line) & (F.trim(line) != ""))), "\n")


def rejoin_numbering(text: Column) -> Column:
    """Numbers such as ``12.`` and ``(a)`` at a line's start rejoin the line before."""
    return F.regexp_replace(F.regexp_replace(text, r"\n(\d+[A-Za-z]*\.)", " $1"), r"\n\(([a-zA-Z0-9]+)\)", " ($1)")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), r"^\s+|\s+$", "")


def nfkc_udf():
    """Unicode normalisation has no built-in: an Arrow UDF, a batch at a time."""
    @F.pandas_udf("string")
    def nfkc(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return nfkc


def clean_text(text: Column) -> Column:
    return collapse_whitespace(rejoin_numbering(clean_noise_lines(nfkc_udf()(text))))


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def script_language(text: Column) -> Column:
    """The language of the Unicode block with most characters; null where none of the blocks occurs.

    Runs of all other characters go first, at one pass; each block is counted in what is left, mostly nothing.
    """
    low, high = min(a for _, a, _ in SCRIPTS), max(b for _, _, b in SCRIPTS)

    def most(t: Column) -> Column:
        counts = F.array(*(F.regexp_count(t, F.lit(f"[{a}-{b}]")) for _, a, b in SCRIPTS))
        names = F.array(*(F.lit(lang) for lang, _, _ in SCRIPTS))
        first = once(counts, lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))))
        return F.when(F.length(t) > 0, first)

    return once(F.regexp_replace(text, f"[^{low}-{high}]+", ""), most)


#: Frequent words of languages in Latin script, for the vote that stands in for a statistical detector.
COMMON = {"en": "the and of to in is that for", "de": "der die und das ist von mit den", "fr": "le la les des et est une que", "es": "el los las del que una por con"}


def detect_language(text: Column) -> Column:
    """Script first, then a vote of frequent words, then English; blank texts are English."""
    every = sorted({w for words in COMMON.values() for w in words.split()})
    known = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t.isin(every))

    def vote(tokens: Column) -> Column:
        votes = F.array(*(_votes(tokens, words.split()) for words in COMMON.values()))
        names = F.array(*(F.lit(lang) for lang in COMMON))
        return once(votes, lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int"))))

    return F.coalesce(script_language(text), once(known, vote), F.lit("en"))


def _votes(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(words)))


def document_id(path: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit(":"), F.substring(text, 1, 500)), 256), 1, 16)


def title_of(text: Column, fallback: Column) -> Column:
    """The first of the first five non-blank lines whose length is between 6 and 199, else the fallback."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 5)
    return F.coalesce(F.get(F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 200)), F.lit(0)), fallback)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


# Fixed value: what is stripped from the ends of a token of a text that is not ASCII.
OUTER = " \t.,;:!?()[]{}<>\"'‘’“”–—-"


def tokenize(text: Column) -> Column:
    """Lower-case tokens: runs of letters and digits of an ASCII text; of any other, white-space parts without outer punctuation."""
    low = F.lower(text)
    ascii_tokens = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)
    other = F.filter(F.transform(F.split(low, r"(?U)\s+"), lambda t: F.btrim(t, F.lit(OUTER))), lambda t: t != "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(ascii_tokens)


def keywords(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(tokenize(text), lambda t: ~F.array_contains(stop, t)))


# Citation formats by type, in their order; the act clause is common to all provisions.
_ACT = r"(?:\s+(?:of|under)\s+((?:the\s+)?[A-Z][\w\s,]*))?"
_NUMBER = r"(\d+[A-Za-z]*(?:\s*[-–]\s*\d*[A-Za-z]*)?)"
PROVISIONS = (
    ("section", r"(?iU)(?:Sections?|Sec\.?|S\.)\s+" + _NUMBER + _ACT),
    ("rule", r"(?iU)Rules?\s+" + _NUMBER + _ACT),
    ("article", r"(?iU)Articles?\s+(\d+[A-Za-z]*)" + _ACT),
    ("order", r"(?iU)Orders?\s+([IVXLC]+)\s+Rules?\s+(\d+[A-Za-z]*)" + _ACT),
)
#: Any of them, for tests of presence.
SECTION_REF = r"(?iU)(?:Sections?|Sec\.?|S\.|Rules?|Articles?)\s+\d|Orders?\s+[IVXLC]+\s+Rules?\s+\d"


def provisions(text: Column) -> Column:
    """Array of structs (citation_type, raw_text, ref_number, act_name) of all cited provisions, by type and place, each raw text of a type once."""
    out = []
    for kind, pattern in PROVISIONS:
        n = 3 if kind == "order" else 2
        found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), i).alias(f"g{i}") for i in range(n + 1)))
        out.append(F.transform(found, _provision(kind, n)))
    return F.array_distinct(F.concat(*out))


def _provision(kind: str, act: int):
    number = lambda x: F.concat(F.lit("Order "), x["g1"], F.lit(" Rule "), x["g2"]) if kind == "order" else x["g1"]
    return lambda x: F.struct(F.lit(kind).alias("citation_type"), F.trim(x["g0"]).alias("raw_text"), number(x).alias("ref_number"), F.trim(F.coalesce(x[f"g{act}"], F.lit(""))).alias("act_name"))


def section_refs(text: Column) -> Column:
    """``section 12``, ``rule 3`` and so on, one for each provision cited."""
    return F.transform(provisions(text), _reference)


def _reference(cite: Column) -> Column:
    return F.trim(F.concat(cite["citation_type"], F.lit(" "), cite["ref_number"]))


def parsed_query(text: Column) -> Column:
    """struct(section_refs, section_numbers, citation_texts, keywords, is_empty) of a question; numbers are the first parts of references."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    cites, words = provisions(raw), keywords(raw)
    refs = F.transform(cites, _reference)
    numbers = F.filter(F.transform(cites, lambda c: F.get(F.split(F.trim(c["ref_number"]), r"\s+"), F.lit(0))), lambda n: n != "")
    return F.struct(
        refs.alias("section_refs"), numbers.alias("section_numbers"), F.transform(cites, lambda c: c["raw_text"]).alias("citation_texts"),
        words.alias("keywords"), ((F.size(words) == 0) & (F.size(cites) == 0)).alias("is_empty"),
    )


def _has(raw: Column, markers) -> Column:
    words = [m for m in markers if " " not in m]
    found = raw.rlike(r"\b(?:" + "|".join(words) + r")\b") if words else F.lit(False)
    return reduce(lambda a, m: a | F.contains(raw, F.lit(m)), (m for m in markers if " " in m), found)


def intent(text: Column) -> Column:
    """Section references win, then the intents in their order; explanation is the rest."""
    raw = F.lower(text)
    out = F.when(text.rlike(SECTION_REF), "section_lookup")
    for name, markers in INTENTS:
        out = out.when(_has(raw, markers), name)
    return out.otherwise("explanation")


def budget(intent_col: Column) -> Column:
    out = F.lit(12)
    for name, k in BUDGETS.items():
        out = F.when(intent_col == name, k).otherwise(out)
    return out


def matched_phrases(text: Column) -> Column:
    raw = F.lower(text)
    hits = F.array(*(F.when(_has(raw, (p,)), F.lit(p)) for p in PHRASES))
    return F.array_sort(F.filter(hits, lambda x: x.isNotNull()))


def expanded(text: Column, sections_at_hand: Column) -> Column:
    """(phrases, concepts, terms, available, omitted) of a query; sections count only if the corpus has them."""
    phrases = matched_phrases(text)
    table = F.create_map(*(y for p, cs in PHRASES.items() for y in (F.lit(p), F.array(*map(F.lit, cs)))))
    terms = F.create_map(*(y for c, (ts, _) in CONCEPTS.items() for y in (F.lit(c), F.array(*map(F.lit, ts)))))
    refs = F.create_map(*(y for c, (_, ns) in CONCEPTS.items() for y in (F.lit(c), F.array(*(F.lit(str(n)) for n in ns)))))
    concepts = F.array_sort(F.array_distinct(F.flatten(F.transform(phrases, lambda p: table[p]))))
    wanted = F.array_sort(F.array_distinct(F.flatten(F.transform(concepts, lambda c: refs[c]))))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(concepts, lambda c: terms[c]))))
    return F.struct(
        phrases.alias("phrases"), concepts.alias("concepts"), found.alias("terms"),
        F.array_intersect(wanted, sections_at_hand).alias("available"), F.array_except(wanted, sections_at_hand).alias("omitted"),
    )


SECTION_KEY = r"(?i)(?<![\d.])(\d{1,3}(?:[a-z](?![\w.])|\([a-z0-9]+\))?)(?!\d)"


def section_keys(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SECTION_KEY), 1), F.lower))


def normalize_section(text: Column) -> Column:
    """``Section 12A`` and ``s. 12a`` become ``12a``."""
    found = F.regexp_extract(text, r"(?i)(?:section|sec\.?|s\.?)\s*(\d{1,3}(?:[a-z]|\([a-z0-9]+\))?)", 1)
    return F.lower(F.when(found != "", found).otherwise(F.regexp_replace(F.lower(text), "[^a-z0-9]", "")))


def section_matches(expected: Column, keys: Column) -> Column:
    """A bare number covers its sub-clauses: 10 matches 10 and 10(a), not 101."""
    return F.exists(keys, lambda k: (k == expected) | (expected.rlike(r"^\d+$") & (F.regexp_extract(k, r"^(\d+)", 1) == expected)))


PUNCTUATION = " ,.;:()[]{}'\"-–—_/\\"


def normalize_citation(text: Column) -> Column:
    return F.lower(F.translate(text, PUNCTUATION, ""))


def bigrams(text: Column) -> Column:
    """Distinct character pairs, white space collapsed; a text too short for one stands for itself, so that only an equal one is similar."""
    t = F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"\s+", " ")
    chars = F.split(t, "")  # once a row: cutting each bigram from the text is quadratic in its length
    n = F.length(t) - 1
    return F.when(F.length(t) < 2, F.array(F.concat(F.lit("\x00"), t))).otherwise(F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), F.greatest(n, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, b))))


def dice(a: Column, b: Column) -> Column:
    """Of two arrays of distinct bigrams."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def highlight_matches(text: Column, keys: list[str]) -> Column:
    """Non-overlapping keyword hits, the earliest first and the longest of those, ignoring case; keys of two characters or more."""
    usable = sorted({k for k in keys if len(k) >= 2}, key=lambda k: (-len(k), k))
    if not usable:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit("(?i)" + "|".join(k.translate(_ESCAPE) for k in usable)), 0)
