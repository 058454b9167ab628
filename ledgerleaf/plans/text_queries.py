"""Queries over text functions and document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.operators import explain, graph, hierarchy, index
from ledgerleaf.plans.base import EDGES_SQL, LEGAL_SQL, LINE_SQL, TREE_SQL, legal, lines, outline, query
from ledgerleaf.session import table
from ledgerleaf.sources import files

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = "case when regexp_matches(text, '[^\\x00-\\x7F]') then list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda t: trim(t, ' .,;:!?()[]{}<>\"''‘’“”–—-')), lambda t: t <> '') else regexp_extract_all(lower(text), '[a-z0-9]+') end"
_NOISE = " or ".join(f"regexp_matches(trim(x), '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in T.NOISE)


@query(f"select doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: not (trim(x) <> '' and ({_NOISE}))), chr(10)) as cleaned from (select doc_id, 'Page ' || (doc_id % 9 + 1) || ' of 10' || chr(10) || text || chr(10) || '- 3 -' || chr(10) || 'Downloaded from site' as t from documents)")
def clean_noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    t = F.concat(F.lit("Page "), F.expr("doc_id % 9 + 1").cast("string"), F.lit(" of 10\n"), "text", F.lit("\n- 3 -\nDownloaded from site"))
    return d.select("doc_id", T.clean_noise_lines(t).alias("cleaned"))


@query(r"select doc_id, regexp_replace(regexp_replace(text, '[\t\x0b\x0c\r ]+', ' ', 'g'), '^\s+|\s+$', '', 'g') as collapsed from documents")
def clean_collapse_ws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("collapsed"))


@query(r"select p_partkey, regexp_replace(regexp_replace(t, '\n(\d+[A-Za-z]*\.)', ' \1', 'g'), '\n\(([a-zA-Z0-9]+)\)', ' (\1)', 'g') as rejoined from (select p_partkey, p_name || chr(10) || p_size || '. see' || chr(10) || '(a) ' || p_type as t from part)")
def rejoin_numbering(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("p_name", F.lit("\n"), F.col("p_size").cast("string"), F.lit(". see\n(a) "), "p_type")
    return table(spark, sf, "part").select("p_partkey", T.rejoin_numbering(t).alias("rejoined"))


@query()
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("select doc_id, case doc_id % 4 when 0 then 'hi' when 1 then 'bn' when 2 then 'ta' end as script from documents")
def script_language(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.expr("doc_id % 4 = 0"), "अनुबंध").when(F.expr("doc_id % 4 = 1"), "চুক্তি").when(F.expr("doc_id % 4 = 2"), "ஒப்பந்தம்").otherwise("")
    return table(spark, sf, "documents").select("doc_id", T.script_language(F.concat("text", tail)).alias("script"))


@query()
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", T.detect_language(F.col("text")).alias("detected"))


@query("select doc_id, coalesce(list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5], lambda x: length(x) > 5 and length(x) < 200)[1], 'untitled') as title from documents")
def title_from_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.title_of(F.col("text"), F.lit("untitled")).alias("title"))


@query("select doc_id, left(sha256('src/' || source || ':' || left(text, 500)), 16) as document_id from documents")
def doc_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.document_id(F.concat(F.lit("src/"), "source"), F.col("text")).alias("document_id"))


@query("select doc_id, case when length(text) > 80 then left(text, 77) || '...' else text end as short from documents")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.truncated(F.col("text"), 80).alias("short"))


@query("select count(*) as docs, count(*) filter (length(text) > 50) as keep_text, count(*) filter (length(trim(text)) < 50) as scanned from documents")
def page_scan_checks(spark: SparkSession, sf: str) -> DataFrame:
    page = F.struct(F.lit(1).alias("page_number"), F.col("text"), F.lit(False).alias("is_scanned"))
    d = table(spark, sf, "documents").select("text", F.array(page).alias("pages"))
    return d.agg(F.count("*").alias("docs"), F.count(F.when(F.length("text") > 50, 1)).alias("keep_text"), F.count(F.when(files.scanned(F.col("pages")), 1)).alias("scanned"))


@query(f"select conv_id, turn, len(tk) as n_tokens, len(list_distinct(tk)) as n_distinct from (select conv_id, turn, {_TOKENS} as tk from conversations where text is not null)")
def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    tk = T.tokenize(F.col("text"))
    return table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.size(tk).cast("long").alias("n_tokens"), F.size(F.array_distinct(tk)).cast("long").alias("n_distinct"))


@query(f"select item_id, array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda t: t not in ({_STOP})))), ' ') as keywords from benchmark")
def keyword_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(T.keywords(F.col("text"))), " ").alias("keywords"))


def _markers_sql(raw: str, markers) -> str:
    return "(" + " or ".join(f"contains({raw}, '{m}')" if " " in m else f"regexp_matches({raw}, '\\b{m}\\b')" for m in markers) + ")"


_QUESTIONS_SQL = "select p_partkey, case p_partkey % 9 when 0 then 'define ' || p_name when 1 then 'what is the punishment for ' || p_type when 2 then 'compare ' || p_name when 3 then 'Section ' || p_size || ' of the act' when 4 then 'how do I file a complaint' when 5 then 'supreme court on ' || p_name when 6 then 'fundamental rights and ' || p_type when 7 then 'he was forced to sign under pressure' else p_name end as q from part"
_INTENT_SQL = "case when regexp_matches(q, '(?i)(sections?|sec\\.?|s\\.|rules?|articles?)\\s+\\d') then 'section_lookup' " + " ".join(f"when {_markers_sql('lower(q)', ms)} then '{n}'" for n, ms in T.INTENTS) + " else 'explanation' end"
_BUDGET_SQL = "case when i in ('definition', 'section_lookup', 'explanation') then 4 when i in ('punishment', 'procedural', 'comparison', 'constitutional') then 7 else 12 end"


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    name, kind = F.col("p_name"), F.col("p_type")
    forms = [
        F.concat(F.lit("define "), name), F.concat(F.lit("what is the punishment for "), kind), F.concat(F.lit("compare "), name), F.concat(F.lit("Section "), "p_size", F.lit(" of the act")),
        F.lit("how do I file a complaint"), F.concat(F.lit("supreme court on "), name), F.concat(F.lit("fundamental rights and "), kind), F.lit("he was forced to sign under pressure"),
    ]
    q = name
    for i, form in enumerate(forms):
        q = F.when(F.expr(f"p_partkey % 9 = {i}"), form).otherwise(q)
    return table(spark, sf, "part").select("p_partkey", q.alias("q"))


@query(f"select p_partkey, {_INTENT_SQL} as intent from ({_QUESTIONS_SQL})")
def intent_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("p_partkey", T.intent(F.col("q")).alias("intent"))


@query(f"select i as intent, {_BUDGET_SQL} as budget, count(*) as n from (select {_INTENT_SQL} as i from ({_QUESTIONS_SQL})) group by all")
def adaptive_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = _questions(spark, sf).select(T.intent(F.col("q")).alias("intent"))
    return rows.groupBy("intent", T.budget(F.col("intent")).alias("budget")).agg(F.count("*").alias("n"))


_PHRASE_ROWS = ", ".join(f"('{p}', '{c}')" for p, cs in T.PHRASES.items() for c in cs)
_SECTION_ROWS = ", ".join(f"('{c}', '{n}')" for c, (_, ns) in T.CONCEPTS.items() for n in ns)


@query(
    f"""with q as ({_QUESTIONS_SQL}), ph(p, c) as (values {_PHRASE_ROWS}), se(c, n) as (values {_SECTION_ROWS}), have as (select distinct cast(p_size as varchar) as n from part where p_size <> 15),
 m as (select distinct p_partkey, c from q join ph on case when contains(p, ' ') then contains(lower(q), p) else regexp_matches(lower(q), '\\b' || p || '\\b') end),
 s as (select distinct p_partkey, n from m join se using (c))
 select p_partkey, (select string_agg(c, ',' order by c) from m where m.p_partkey = q.p_partkey) as concepts, (select string_agg(n, ',' order by n) from s where s.p_partkey = q.p_partkey and n in (select n from have)) as available,
 (select string_agg(n, ',' order by n) from s where s.p_partkey = q.p_partkey and n not in (select n from have)) as omitted from q"""
)
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "part").where("p_size <> 15").agg(F.collect_set(F.col("p_size").cast("string")).alias("have"))
    x = T.expanded(F.col("q"), F.col("have"))
    join = lambda c: F.nullif(F.array_join(F.col(f"x.{c}"), ","), F.lit("")).alias(c)
    return _questions(spark, sf).join(F.broadcast(have)).select("p_partkey", x.alias("x")).select("p_partkey", join("concepts"), join("available"), join("omitted"))


@query("select p_partkey, lower(regexp_extract(txt, '(?i)(?:section|sec\\.?|s\\.?)\\s*(\\d{1,3}(?:[a-z]|\\([a-z0-9]+\\))?)', 1)) as section, cast(p_partkey as varchar) = lower(regexp_extract(txt, '(?i)section\\s*(\\d{1,3})', 1)) as same from (" + LEGAL_SQL + ")")
def section_normalize(spark: SparkSession, sf: str) -> DataFrame:
    key = T.normalize_section(F.col("txt"))
    return legal(spark, sf).select("p_partkey", key.alias("section"), T.section_matches(F.col("p_partkey").cast("string"), F.array(key)).alias("same"))


@query("select p_partkey, lower(regexp_replace(txt, '[ ,.;:()\\[\\]{}''\"\\-–—_/\\\\]', '', 'g')) as key from (" + LEGAL_SQL + ")")
def citation_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return legal(spark, sf).select("p_partkey", T.normalize_citation(F.col("txt")).alias("key"))


@query("select doc_id, count(*) as n_lines, cast(sum(length(line)) as bigint) as chars, max(i) as last_line from (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from documents) where line <> '' group by doc_id")
def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.line_blocks(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").cast("long").alias("last_line"))


#: The classes that the forms of ``lines`` have by definition, one for each remainder.
_CLASSES = [
    ("chapter", 4, "'Of ' || p_type"), ("section", 5, "cast(p_size as varchar)"), ("section", 5, "cast(p_size as varchar)"), ("sub_section", 6, "cast(p_size as varchar)"), ("clause", 7, "'a'"), ("sub_clause", 8, "'ii'"),
    ("explanation", 9, "p_name"), ("part", 3, "line"), ("schedule", 1, "line"), ("sub_clause", 8, "'c'"), ("proviso", 9, "p_name"), ("appendix", 1, "line"), ("section", 5, "p_size || '-A'"),
]
_FORMS_SQL = f"select p_partkey, line, p_size, p_name, p_type from part join ({LINE_SQL}) using (p_partkey)"
_KIND_SQL = "p_partkey % 14 < 13"


def _class_sql(i: int) -> str:
    return "case p_partkey % 14 " + " ".join(f"when {k} then {repr(c[i]) if i == 0 else c[i]}" for k, c in enumerate(_CLASSES)) + " end"


@query(f"select p_partkey, {_class_sql(0)} as node_type, coalesce({_class_sql(1)}, 0) as level, {_class_sql(2)} as numbering from ({_FORMS_SQL})")
def line_classify(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("p_partkey", hierarchy.classify(F.col("line")).alias("x")).select("p_partkey", "x.node_type", F.coalesce("x.level", F.lit(0)).alias("level"), "x.numbering")


@query(
    f"""with l as (select p_partkey % 50 as doc_id, p_partkey as line_no, line, {_KIND_SQL} as s from ({LINE_SQL})),
 g as (select *, sum(case when s then 1 else 0 end) over (partition by doc_id order by line_no) as seq from l)
 select doc_id, cast(seq as int) as seq, coalesce(string_agg(line, chr(10) order by line_no) filter (not s), '') as text from g where seq > 0 group by doc_id, seq"""
)
def body_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select(F.expr("p_partkey % 50").alias("doc_id"), F.col("p_partkey").alias("line_no"), "line")
    return hierarchy.body_merge(rows).select("doc_id", "seq", "text")


@query(f"{TREE_SQL} select doc_id, seq, parent from tree")
def parent_assign(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.parents(outline(spark, sf)).select("doc_id", "seq", "parent")


@query(f'{TREE_SQL} select doc_id, seq, depth, "left", "right" from tree')
def nested_set(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.nested_set(outline(spark, sf)).select("doc_id", "seq", "depth", "left", "right")


@query(f"{TREE_SQL} select doc_id, 'duplicate_numbering' as warning_type, seq from tree qualify row_number() over (partition by doc_id, parent, numbering, level order by seq) > 1")
def hierarchy_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.warnings(hierarchy.parents(outline(spark, sf)))


@query(f"{TREE_SQL} select d.doc_id, d.seq as node, string_agg(cast(a.seq as varchar), '>' order by a.depth) as chain from tree d join tree a on a.doc_id = d.doc_id and a.\"left\" < d.\"left\" and a.\"right\" > d.\"left\" group by all")
def ancestor_chain(spark: SparkSession, sf: str) -> DataFrame:
    c = graph.ancestors(hierarchy.nested_set(outline(spark, sf)), "doc_id")
    rows = c.groupBy("doc_id", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("x"))
    return rows.select("doc_id", "node", F.array_join(F.transform("x", lambda r: r["ancestor"].cast("string")), ">").alias("chain"))


@query(f"{TREE_SQL} select doc_id, seq, after - seq - 1 as descendants from tree")
def descendant_count(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.nested_set(outline(spark, sf)).select("doc_id", "seq", F.expr("(right - left - 1) div 2").alias("descendants"))


@query(
    f"""{TREE_SQL}, seeds as (select doc_id, seq from tree where seq % 3 = 0), s as (select doc_id, seq, 1.0 as s from seeds
 union all select d.doc_id, a.seq, pow(0.6, d.depth - a.depth) from seeds join tree d using (doc_id, seq) join tree a on a.doc_id = d.doc_id and a."left" < d."left" and a."right" > d."left"
 union all select d.doc_id, d.seq, pow(0.4, d.depth - a.depth) from seeds join tree a using (doc_id, seq) join tree d on a.doc_id = d.doc_id and a."left" < d."left" and a."right" > d."left")
 select doc_id, seq as node, round(least(1.0, sum(s)), 6) as strength from s where s > 1e-4 group by all"""
)
def evidence_propagation(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy.nested_set(outline(spark, sf))
    seeds = tree.where("seq % 3 = 0").select("doc_id", F.col("seq").alias("node"))
    return graph.propagate(seeds, graph.ancestors(tree, "doc_id"), "doc_id").select("doc_id", "node", F.round("strength", 6).alias("strength"))


@query(
    f"select p_partkey, 'section' as citation_type, cast(p_size as varchar) as ref_number, 'the ' || split_part(p_brand, '#', 1) as act_name, '' as court, '' as year, 0 as \"start\" from part union all select p_partkey, 'article', cast(p_size % 7 + 1 as varchar), '', '', '', instr(txt, 'Article') - 1 from part join ({LEGAL_SQL}) using (p_partkey) union all select p_partkey, 'case', '', '', 'SC', cast(1950 + p_size as varchar), instr(txt, 'AIR') - 1 from part join ({LEGAL_SQL}) using (p_partkey)"
)
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    return graph.citations(legal(spark, sf), "p_partkey", "txt").select("p_partkey", "citation_type", "ref_number", "act_name", "court", "year", F.col("start").cast("long").alias("start"))


@query(
    f"select rel_type, count(*) as n, count(distinct dst) as targets from (select distinct p_partkey, 'REFERENCES' as rel_type, regexp_extract(txt, 'Section\\s+\\d+') as dst from ({LEGAL_SQL}) union select p_partkey, 'REFERENCES', regexp_extract(txt, 'Article\\s+\\d+') from ({LEGAL_SQL}) union select p_partkey, 'CITES', regexp_extract(txt, 'AIR\\s+\\d+ SC \\d+') from ({LEGAL_SQL})) group by all"
)
def citation_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, e = graph.citation_graph(graph.citations(legal(spark, sf), "p_partkey", "txt"), "p_partkey")
    return e.groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


@query(
    f"select p_partkey, case when txt like '%overruled%' then 'overruled' else 'not_applicable' end as marker, case when txt like '%overruled%' then 'overruled' else 'shall not apply' end as phrase, substr(txt, greatest(1, i - 40), i - greatest(1, i - 40) + n + 80) as context from (select *, case when txt like '%overruled%' then instr(txt, 'overruled') else instr(txt, 'shall not apply') end as i, case when txt like '%overruled%' then 9 else 15 end as n from ({LEGAL_SQL})) where i > 0"
)
def counter_authority(spark: SparkSession, sf: str) -> DataFrame:
    return explain.counter_authority(legal(spark, sf), "p_partkey", "txt")


@query("select doc_id, len(regexp_extract_all(text, '(?i)tion|the|and')) as hits from documents")
def keyword_highlight(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.highlight_matches(F.col("text"), ["the", "tion", "and", "a"])).cast("long").alias("hits"))


@query()
def ingest_documents(spark: SparkSession, sf: str) -> DataFrame:
    return index.ingest(table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"))
