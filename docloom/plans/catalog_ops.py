"""Queries on the text, graph, rule and evidence operators that the other catalogues leave out; fixtures come from the driver's tables.

``_M`` is a state machine of 25 states over the nations' keys, ``_R`` are rules over the parts: both small enough to follow by hand,
and both read whole.
"""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fn
from docloom.operators import enrich, etl, evaluation, graph, reasoning, search
from docloom.plans import agent, planner, retrieval
from docloom.plans.domain import Domain, body_control
from docloom.plans.registry import Tables, query
from docloom.sources import readers, sinks
from docloom.sources.storage import shared_folder

# --- fixtures --------------------------------------------------------------------------------------------------------

_M = """m AS (
SELECT 'S' || n_nationkey AS src, 'S' || ((7 * n_nationkey + 3) % 25) AS dst, 'Sig_Abc' || (n_nationkey % 5) || ' = 1' AS guard, 'M' || (n_nationkey % 3) AS module, n_nationkey::BIGINT AS ord FROM nation
UNION ALL SELECT 'S' || n_nationkey, 'S' || ((n_nationkey + 1) % 25), '', 'M' || (n_nationkey % 3), 100 + n_nationkey FROM nation WHERE n_nationkey % 2 = 0)"""

_R = """r AS (
SELECT p_partkey::BIGINT AS rule_id, p_brand AS module, 'Sig_Abc' || (p_size % 7) || ' = ' || (p_size % 2) AS condition, 'send Out_Sig' || (p_size % 3) || ' ' || p_brand AS action,
['state S' || (p_partkey % 25)] AS preconditions, CASE WHEN p_partkey % 4 = 0 THEN 'S' || (3 * p_partkey % 25) ELSE '' END AS target_state, ['Sig_Abc' || (p_partkey % 7)] AS action_signals FROM part)"""


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _machine(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    module = _text("M", k % 3)
    first = t.nation.select(_text("S", k).alias("src"), _text("S", (7 * k + 3) % 25).alias("dst"), _text("Sig_Abc", k % 5, " = 1").alias("guard"), module.alias("module"), k.cast("long").alias("ord"))
    second = t.nation.where(k % 2 == 0).select(_text("S", k).alias("src"), _text("S", (k + 1) % 25).alias("dst"), F.lit("").alias("guard"), module.alias("module"), (k + 100).cast("long").alias("ord"))
    return first.unionByName(second)


def _rules(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.cast("long").alias("rule_id"), F.col("p_brand").alias("module"), _text("Sig_Abc", size % 7, " = ", size % 2).alias("condition"), _text("send Out_Sig", size % 3, " ", F.col("p_brand")).alias("action"),
        F.array(_text("state S", k % 25)).alias("preconditions"), F.when(k % 4 == 0, _text("S", (3 * k) % 25)).otherwise("").alias("target_state"), F.array(_text("Sig_Abc", k % 7)).alias("action_signals"),
    )


def _vocabulary(t: Tables) -> Column:
    """A sentence with CJK signs, identifiers and words, from a nation's name and key."""
    return _text("车窗 PEPS_Mode ", F.col("n_name"), "x锁 ", F.col("n_nationkey"))


_V = "v AS (SELECT n_nationkey, '车窗 PEPS_Mode ' || n_name || 'x锁 ' || n_nationkey AS s FROM nation)"

# --- text ------------------------------------------------------------------------------------------------------------


@query(f"WITH {_V}, w AS (SELECT *, list_transform(regexp_extract_all(s, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x)) AS words FROM v) SELECT n_nationkey, array_to_string(list_concat(['车', '窗', '锁'], list_concat(words, ['车窗', '窗锁'])), '/') AS tokens FROM w")
def tokenize_cjk(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.array_join(fn.tokenize(_vocabulary(t)), "/").alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')) AS n, sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}'), ' ')) AS digest FROM documents")
def tokenize_words(t: Tables) -> DataFrame:
    """All tokens of texts without CJK signs, by the tokenizer itself."""
    words = fn.tokenize("text")
    return t.documents.select("doc_id", F.size(words).cast("long").alias("n"), F.sha2(F.array_join(words, " "), 256).alias("digest"))


@query(f"WITH {_V}, w AS (SELECT *, list_concat(list_concat(regexp_extract_all(s, '[A-Z][A-Za-z0-9_]+'), ['车窗', '窗锁', '车', '窗', '锁']), regexp_extract_all(lower(s), '[a-z]{{3,}}')) AS l FROM v) SELECT n_nationkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '/') AS tokens FROM w")
def agent_tokens(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.array_join(fn.agent_tokens(_vocabulary(t)), "/").alias("tokens"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN (s_suppkey % 9 + 1) || '.' || (s_suppkey % 4) WHEN 1 THEN (s_suppkey % 9)::VARCHAR END AS number, CASE s_suppkey % 3 WHEN 2 THEN left('Supplier_' || lpad(s_suppkey::VARCHAR, 9, '0'), 20) WHEN 0 THEN left((s_suppkey % 9 + 1) || '_' || (s_suppkey % 4) || '_Supplier', 20) ELSE '车身电源管理系统总' END AS module FROM supplier")
def section_numbers_and_modules(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    title = F.when(k % 3 == 0, _text(k % 9 + 1, ".", k % 4, " Supplier#")).when(k % 3 == 1, _text(k % 9, " 车身电源管理系统总览 x")).otherwise(F.regexp_replace("s_name", "#", " "))
    return t.supplier.select("s_suppkey", fn.section_number(title).alias("number"), F.when(k % 3 == 1, _text(fn.module_name(title), "总")).otherwise(fn.module_name(title)).alias("module"))


@query("SELECT c_custkey, replace(trim(left('  ' || c_mktsegment || '  of ' || c_name, 30)), '  ', ' ') AS spaced, upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS said FROM customer")
def slug_and_capital(t: Tables) -> DataFrame:
    s = fn.slug(_text("  ", F.col("c_mktsegment"), "  of ", F.col("c_name")))
    return t.customer.select("c_custkey", F.replace(s, F.lit("_"), F.lit(" ")).alias("spaced"), fn.capitalised(F.lower("c_mktsegment")).alias("said"))


_T = "t AS (SELECT p_partkey, 'LOCK ' || p_name AS q FROM part)"


@query(f"WITH {_T} SELECT p_partkey, q || CASE WHEN contains(lower(q), 'blue') THEN ' verde' ELSE '' END || CASE WHEN contains(lower(q), 'lock') THEN ' door bolt' ELSE '' END AS expanded FROM t")
def query_expansion(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.expand_query(_text("LOCK ", F.col("p_name")), {"Blue": "verde", "lock": "door bolt"}).alias("expanded"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN left(p_comment, 800) || chr(10) || chr(10) || '问题: ' || p_name WHEN 1 THEN CASE WHEN p_comment = '' THEN p_name || ' ' || p_brand ELSE p_name || chr(10) || chr(10) || left(p_comment, 500) END ELSE p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size END AS rewritten FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'about ' || p_type || ' ' || p_size END AS p_comment FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 7 > 0)")
def query_rewrite(t: Tables) -> DataFrame:
    """Three strategies by part; one without a model's text falls back to keywords."""
    k = F.col("p_partkey")
    doc = F.when(k % 7 == 0, "").otherwise(_text("about ", F.col("p_type"), " ", F.col("p_size")))
    one = lambda c: F.array(F.col(c))
    q = [fn.rewrite_query("p_name", "hyde", doc, modules=one("p_brand")), fn.rewrite_query("p_name", "query2doc", doc, modules=one("p_brand")), fn.rewrite_query("p_name", "keywords", modules=one("p_brand"), signals_=one("p_type"), states=F.array(F.col("p_size").cast("string")))]
    return t.part.where((k % 3 > 0) | (k % 7 > 0)).select("p_partkey", F.when(k % 3 == 0, q[0]).when(k % 3 == 1, q[1]).otherwise(q[2]).alias("rewritten"))


@query("SELECT p_partkey, array_to_string(list_concat([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)], list_concat(CASE split_part(p_name, ' ', 1) WHEN 'blue' THEN ['azure', 'navy'] WHEN 'widget' THEN ['gadget'] ELSE [] END, CASE split_part(p_name, ' ', 2) WHEN 'blue' THEN ['azure', 'navy'] WHEN 'widget' THEN ['gadget'] ELSE [] END)), '/') AS terms FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def synonym_expansion(t: Tables) -> DataFrame:
    w = F.split("p_name", " ")
    terms = fn.synonyms(F.array(w[0], F.coalesce(F.get(w, F.lit(1)), F.lit(""))), {"Blue": ("azure", "navy"), "widget": ("gadget",)})
    return t.part.where(w[0] != F.coalesce(F.get(w, F.lit(1)), F.lit(""))).select("p_partkey", F.array_join(terms, "/").alias("terms"))


_G = "g AS (SELECT *, 'Sig_Abc' || (p_size % 5) || ' = 0x' || (p_size % 3) || ' AND PowerMode_x AND ab = 2' AS guard FROM part)"


@query(f"WITH {_G} SELECT p_partkey, 'Sig_Abc' || (p_size % 5) || '/PowerMode_x/ab' AS signals FROM g")
def guard_signals(t: Tables) -> DataFrame:
    guard = _text("Sig_Abc", F.col("p_size") % 5, " = 0x", F.col("p_size") % 3, " AND PowerMode_x AND ab = 2")
    return t.part.select("p_partkey", F.array_join(fn.signals(guard), "/").alias("signals"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INT AS days FROM orders")
def days_since(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("since "), F.date_format(d, "yyyy-MM-dd"))).otherwise(F.concat(F.date_format(d, "yyyy年M月d"), F.lit("日起")))
    return t.orders.select("o_orderkey", fn.resolve_days(said, F.lit("2000-01-01").cast("date")).alias("days"))


@query("SELECT n_nationkey, '[{\"a\": ' || n_nationkey || '}, [1]]' AS list, '{\"b\": {\"c\": ' || n_nationkey || '}}' AS object FROM nation")
def json_repair(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    said = lambda x: _text("Sure:\n```json\n", x, "\n``` done")
    return t.nation.select("n_nationkey", fn.json_part(said(_text('[{"a": ', k, "}, [1]]"))).alias("list"), fn.json_part(said(_text('{"b": {"c": ', k, "}}")), array=False).alias("object"))


@query("SELECT n_nationkey, '<table><tr><th colspan=\"2\">' || replace(n_name, ' ', ' &amp; ') || '</th></tr><tr><td>' || n_nationkey || '</td><td>&lt;x&gt;</td></tr></table>' AS html, n_nationkey || '/' || '<x>' AS last FROM nation")
def table_grid_html(t: Tables) -> DataFrame:
    cell = lambda x, span=1: F.struct(x.alias("text"), F.lit(1).alias("row_span"), F.lit(span).alias("col_span"))
    grid = F.array(F.array(cell(F.replace("n_name", F.lit(" "), F.lit(" & ")), 2)), F.array(cell(F.col("n_nationkey").cast("string")), cell(F.lit("<x>"))))
    html = fn.grid_html(grid)
    return t.nation.select("n_nationkey", html.alias("html"), F.array_join(F.element_at(fn.html_rows(html), 2), "/").alias("last"))


@query("SELECT doc_id, length(coalesce(text, '')) // 3 AS tokens, coalesce(text, '') = '' OR length(coalesce(text, '')) < 30 AS stub FROM documents WHERE NOT contains(coalesce(text, ''), '|') AND NOT contains(coalesce(text, ''), '#') AND trim(coalesce(text, '')) = coalesce(text, '')")
def stub_chunks(t: Tables) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    plain = t.documents.where(~F.contains(x, F.lit("|")) & ~F.contains(x, F.lit("#")) & (F.trim(x) == x))
    return plain.select("doc_id", (F.length(x) / 3).cast("long").alias("tokens"), fn.is_stub("text").alias("stub"))


_H = "h AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '## a' || chr(10) || '### b' || chr(10) || '## ' || n_name || chr(10) || repeat('x', n_nationkey * 8) ELSE repeat('## t ' || chr(10), n_nationkey % 4) || 'y' END AS s FROM nation)"


@query(f"WITH {_H} SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 8 < 100 ELSE n_nationkey % 4 >= 3 END AS toc FROM h")
def toc_only(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    said = F.when(k % 2 == 0, F.concat(F.lit("## a\n### b\n## "), "n_name", F.lit("\n"), F.repeat(F.lit("x"), (k * 8).cast("int")))).otherwise(F.concat(F.repeat(F.lit("## t \n"), (k % 4).cast("int")), F.lit("y")))
    return t.nation.select("n_nationkey", fn.is_toc_only(said).alias("toc"))


# --- intent, routing -------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 4 WHEN 0 THEN '车窗 故障 how ' WHEN 1 THEN '如何 进入 条件 PEPS_Mode ' WHEN 2 THEN '信号名称 取值 ' ELSE 'plain ' END || n_name AS s FROM nation)
SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'diagnostic' WHEN 1 THEN 'reasoning' ELSE CASE WHEN regexp_matches(lower(s), 'how|why|fault|error|dtc') THEN 'other' ELSE 'factual' END END AS question_type,
CASE query_id % 4 WHEN 0 THEN 'Window' WHEN 1 THEN 'RemoteControl' ELSE '' END AS modules, query_id % 4 = 2 AS signal_def, query_id % 4 = 1 AS transition FROM q""")
def question_intents(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    said = F.concat(F.when(k % 4 == 0, "车窗 故障 how ").when(k % 4 == 1, "如何 进入 条件 PEPS_Mode ").when(k % 4 == 2, "信号名称 取值 ").otherwise("plain "), "n_name")
    got = retrieval.intents(t.nation.select(k.alias("query_id"), said.alias("query")), body_control())
    return got.select("query_id", "question_type", F.array_join("modules", "/").alias("modules"), F.col("hint_signal_def").alias("signal_def"), F.col("hint_transition").alias("transition"))


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'diagnostic' WHEN 1 THEN 'path_finding' WHEN 2 THEN 'impact_analysis' WHEN 3 THEN 'reachability_check' WHEN 4 THEN 'state_transition' ELSE 'factual_lookup' END AS template FROM nation""")
def template_routing(t: Tables) -> DataFrame:
    """The router, the trigger words and the default of the default vocabulary, each by a question of its kind."""
    k = F.col("n_nationkey") % 6
    said = F.when(k == 0, "为什么 车窗 无法 升起").when(k == 1, "从 Inactive 到 Driving 有哪些 路径").when(k == 2, "信号 丢失 影响 哪些").when(k == 3, "状态机 有 死锁").when(k == 4, "Driving 是什么").otherwise("PIN 定义")
    return t.nation.select("n_nationkey", planner.select_template(F.concat(said, F.lit(" "), F.col("n_nationkey").cast("string")), body_control()).alias("template"))


@query("SELECT 'exp' || o_orderpriority AS expected, 'act' || o_orderstatus AS actual, count(*) AS n FROM orders GROUP BY 1, 2")
def routing_confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(t.orders.select(F.concat(F.lit("exp"), "o_orderpriority").alias("expected"), F.concat(F.lit("act"), "o_orderstatus").alias("actual")))


# --- sections and chunks ---------------------------------------------------------------------------------------------


def _lines(t: Tables) -> DataFrame:
    """Seven lines for each order: (doc_id, n, mode, sig)."""
    rows = t.orders.select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"))
    mode = F.element_at(F.array(*map(F.lit, ("AIR", "RAIL", "SHIP", "REG"))), ((F.col("o_custkey") + F.col("n")) % 4 + 1).cast("int"))
    letter = F.element_at(F.array(*map(F.lit, "ABC")), ((F.col("o_custkey") * F.col("n")) % 3 + 1).cast("int"))
    return rows.select("doc_id", "n", mode.alias("mode"), F.concat(F.lit("Sig_"), "o_orderstatus", letter).alias("sig"))


def _items(t: Tables) -> DataFrame:
    """The lines as items of one document an order; every third is a title, one is a table."""
    n = F.col("n")
    kind = F.when(n % 3 == 1, "title").when(n % 5 == 0, "table").otherwise("paragraph")
    page = (n / 3).cast("int")
    return _lines(t).select("doc_id", n.alias("idx"), page.alias("page"), kind.alias("type"), F.when(n % 3 == 1, page + 1).alias("level"), _text(n, " ", F.col("mode"), " ", F.col("sig")).alias("text"), F.lit("").alias("html"))


_L = "l AS (SELECT o_orderkey AS doc_id, n, ['AIR', 'RAIL', 'SHIP', 'REG'][(o_custkey + n) % 4 + 1] AS mode, 'Sig_' || o_orderstatus || ['A', 'B', 'C'][(o_custkey * n) % 3 + 1] AS sig FROM orders, range(1, 8) AS x(n))"
_I = _L + ", i AS (SELECT doc_id, n AS idx, n // 3 AS page, CASE WHEN n % 3 = 1 THEN 'title' WHEN n % 5 = 0 THEN 'table' ELSE 'paragraph' END AS type, n // 3 + 1 AS level, n || ' ' || mode || ' ' || sig AS text FROM l)"


@query(f"WITH {_I}, o AS (SELECT *, CASE WHEN type IN ('title', 'table') OR lag(type) OVER w = 'table' THEN idx END AS b, min(idx) OVER (PARTITION BY doc_id) AS f FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT doc_id, idx::INT AS idx, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), f)::INT AS grp FROM o")
def group_segments(t: Tables) -> DataFrame:
    return etl.segment(_items(t)).select("doc_id", "idx", F.col("grp").cast("int").alias("grp"))


@query(f"WITH {_I}, s AS (SELECT * FROM i WHERE type = 'title') SELECT a.doc_id, a.idx::INT AS start_idx, min(x.page)::INT AS first_page, max(x.page)::INT AS last_page FROM s a JOIN i x ON x.doc_id = a.doc_id AND x.idx >= a.idx GROUP BY 1, 2")
def section_page_ranges(t: Tables) -> DataFrame:
    """Titles go ever deeper here, so a section's subtree is all that follows."""
    items = _items(t)
    return etl.page_ranges(etl.sections(items), items)


@query(f"WITH {_I} SELECT doc_id, idx::INT AS start_idx, CASE idx WHEN 1 THEN 'ch_1' WHEN 4 THEN 'sec_4' ELSE 'ss_7' END AS section_id, idx::VARCHAR AS number, CASE idx WHEN 1 THEN NULL ELSE idx - 3 END::INT AS parent_idx FROM i WHERE type = 'title'")
def section_tree_ids(t: Tables) -> DataFrame:
    return etl.sections(_items(t)).select("doc_id", "start_idx", "section_id", "number", "parent_idx")


@query(f"WITH {_L} SELECT doc_id, n % 3 AS part, count(*) AS n, string_agg(mode, chr(10) ORDER BY n) AS text, array_to_string(list_sort(list_distinct(flatten(list(['e' || n, mode])))), '/') AS entities, bool_or(n % 2 = 0) AS has_table, min(n)::INT AS first FROM l GROUP BY 1, 2")
def same_section_merge(t: Tables) -> DataFrame:
    n = F.col("n")
    c = _lines(t).select("doc_id", (n % 3).alias("part"), n.cast("int").alias("first"), F.col("mode").alias("text"), F.array(_text("e", n), "mode").alias("entities"), (n % 2 == 0).alias("has_table"))
    return etl.merge_sections(c, ["doc_id", "part"], F.col("first")).withColumn("entities", F.array_join("entities", "/"))


@query(f"WITH {_I}, s AS (SELECT doc_id, idx AS ord, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) - 1, 99) AS last FROM i WHERE type = 'title'), e AS (SELECT doc_id, idx, 'signal_' || split_part(text, ' ', -1) AS id, split_part(text, ' ', -1) AS name FROM i) SELECT s.doc_id, s.ord::INT AS ord, array_to_string(list_sort(list_distinct(list(e.id))), '/') AS entities, array_to_string(list_sort(list_distinct(list(e.name))), '/') AS signals FROM s JOIN e ON e.doc_id = s.doc_id AND e.idx BETWEEN s.ord AND s.last GROUP BY 1, 2")
def chunk_entity_join(t: Tables) -> DataFrame:
    items = _items(t)
    spans = etl.sections(items).select("doc_id", F.col("start_idx").alias("ord"), F.col("end_idx").alias("last"))
    name = F.element_at(F.split("text", " "), -1)
    e = items.select("doc_id", "idx", F.concat(F.lit("signal_"), name).alias("entity_id"), F.lit("signal").alias("entity_type"), name.alias("name"))
    return etl.chunk_entities(spans, e).select("doc_id", "ord", F.array_join("entities", "/").alias("entities"), F.array_join("signals", "/").alias("signals"))


@query(f"WITH {_I}, e AS (SELECT doc_id, idx, unnest([split_part(text, ' ', -1), split_part(text, ' ', 2)]) AS name, unnest(['signal', 'mode']) AS kind FROM i WHERE NOT contains(text, 'REG')) SELECT doc_id, kind || '_' || name AS entity_id, kind AS entity_type, name, min(idx)::INT AS idx FROM e GROUP BY ALL")
def pattern_entities(t: Tables) -> DataFrame:
    domain = Domain("x", entity_patterns={"signal": r"\b(Sig_[A-Z]+)", "mode": r"\d ([A-Z]+)"}, fault_words="^$")
    return etl.text_entities(_items(t).where(~F.contains("text", F.lit("REG"))), domain).select("doc_id", "entity_id", "entity_type", "name", "idx")


@query(f"WITH {_I} SELECT doc_id, split_part(text, ' ', 2) AS src, split_part(text, ' ', -1) AS dst, 'uses' AS rel, min(idx)::INT AS ord FROM i WHERE NOT contains(text, 'REG') GROUP BY ALL")
def pattern_relations(t: Tables) -> DataFrame:
    domain = Domain("x", relation_patterns=[("uses", r"([A-Z]{2,}) (Sig_[A-Z]+)", 1, 2)])
    return etl.text_relations(etl.place_items(_items(t).where(~F.contains("text", F.lit("REG")))), domain).select("doc_id", "src", "dst", "rel", "ord")


@query("SELECT p_partkey AS doc_id, 0::INT AS idx, 'module_' || m AS entity_id, 'module' AS entity_type, m AS name FROM (SELECT p_partkey, left(array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9]+')[1:3], '_'), 20) AS m FROM part) UNION ALL SELECT p_partkey, 1, 'state_' || left(array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9]+')[1:3], '_'), 20) || '_Driving', 'state', 'Driving' FROM part WHERE false UNION ALL SELECT p_partkey, 1, 'state_Driving_of_' || left(p_brand, 5) || '_Driving', 'state', 'Driving' FROM part")
def title_entities(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand")
    row = lambda n, level, text: p.select("doc_id", F.lit(n).alias("idx"), F.lit(0).alias("page"), F.lit("title").alias("type"), F.lit(level).alias("level"), text.alias("text"), F.lit("").alias("html"))
    items = row(0, 1, F.col("p_name")).unionByName(row(1, 2, F.concat(F.lit("Driving of "), F.left("p_brand", F.lit(5)))))
    return etl.title_entities(etl.sections(items), Domain("x", state_names=["driving"])).select("doc_id", "idx", "entity_id", "entity_type", "name")


@query("SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'parameter' WHEN 1 THEN 'state' WHEN 2 THEN 'function' WHEN 3 THEN 'can_message' WHEN 4 THEN 'hardware_pin' WHEN 5 THEN 'signal' ELSE 'known' END AS kind FROM nation")
def entity_type_cascade(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 7
    name = F.when(k == 0, "NVM_x").when(k == 1, "Driving").when(k == 2, "灯光控制").when(k == 3, "0x12").when(k == 4, "kl30").when(k == 5, F.concat(F.lit("Sig_"), "n_nationkey")).otherwise("Cfg_y")
    return t.nation.select("n_nationkey", etl.entity_type_of(name, F.when(k == 6, "known"), body_control()).alias("kind"))


@query("WITH e AS (SELECT c_nationkey AS name, c_mktsegment AS entity_type, 'm' AS module, c_custkey AS entity_id, 'k' || (c_custkey % 4) AS key, c_name AS value, c_custkey AS ord FROM customer), p AS (SELECT name, entity_type, key, arg_max(value, ord) AS value FROM e GROUP BY 1, 2, 3) SELECT name::VARCHAR AS name, entity_type, (SELECT min(entity_id) FROM e WHERE e.name = p.name AND e.entity_type = p.entity_type)::BIGINT AS entity_id, string_agg(key || '=' || value, '/' ORDER BY key) AS properties FROM p GROUP BY 1, 2, 3, p.name, p.entity_type")
def entity_merge(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(F.col("c_nationkey").cast("string").alias("name"), F.col("c_mktsegment").alias("entity_type"), F.lit("m").alias("module"), k.cast("long").alias("entity_id"), F.create_map(_text("k", k % 4), F.col("c_name")).alias("properties"), k.alias("ord"))
    told = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "/")
    return etl.merge_entities(rows).select("name", "entity_type", "entity_id", told.alias("properties"))


@query("SELECT c_mktsegment AS kind, arg_min(c_name, c_custkey) AS name, min(c_custkey)::BIGINT AS c_custkey FROM customer GROUP BY 1")
def first_wins(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("c_custkey"))
    return etl.first_by(c, ["kind"], "c_custkey")


# --- tables and rules ------------------------------------------------------------------------------------------------


def _tables(t: Tables) -> DataFrame:
    """Three kinds of HTML tables over the suppliers: voltages, transitions, and one of no class."""
    k = F.col("s_suppkey")
    row = lambda *cells: F.concat(F.lit("<tr><td>"), F.array_join(F.array(*(F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells)), "</td><td>"), F.lit("</td></tr>"))
    volt = F.concat(row("Voltage", "Range", "Status"), row(F.col("s_name"), _text(k % 9, "V-", k % 9 + 4, "V"), "full"), row("---", "---", "---"), row("", "", ""))
    move = F.concat(row("Current state", "Event", "Target state"), row("A", F.col("s_name"), _text("B", k % 5)))
    none = F.concat(row("x", "y"), row("1", "2"))
    html = F.concat(F.lit("<table>"), F.when(k % 3 == 0, volt).when(k % 3 == 1, move).otherwise(none), F.lit("</table>"))
    # dealt out while they are small: a file of a few hundred kilobytes is one split, and one task would parse all tables
    rows = t.supplier.repartition(t.spark.sparkContext.defaultParallelism, "s_suppkey")
    return rows.select(k.alias("doc_id"), F.lit(0).alias("idx"), F.lit("table").alias("type"), F.lit("").alias("text"), html.alias("html"))


@query("SELECT s_suppkey AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN 'voltage_range' WHEN 1 THEN 'transition' ELSE 'unknown' END AS table_class FROM supplier")
def table_classes(t: Tables) -> DataFrame:
    return etl.classify_tables(_tables(t), body_control()).select("doc_id", "table_class")


@query("SELECT s_suppkey AS doc_id, 1 AS row_index, CASE s_suppkey % 3 WHEN 0 THEN s_name ELSE 'A' END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'range=' || (s_suppkey % 9) || 'V-' || (s_suppkey % 9 + 4) || 'V/status=full/voltage=' || s_name ELSE 'source_state=A/target_state=B' || (s_suppkey % 5) || '/trigger=' || s_name END AS fields FROM supplier WHERE s_suppkey % 3 < 2")
def table_rows(t: Tables) -> DataFrame:
    got = etl.table_records(etl.classify_tables(_tables(t), body_control()), body_control())
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "/")
    return got.select("doc_id", "row_index", "name", pairs.alias("fields"))


@query("SELECT DISTINCT 'voltage_range' AS rule_type, 'Voltage >= ' || (s_suppkey % 9) || '.0 AND Voltage <= ' || (s_suppkey % 9 + 4) || '.0' AS condition, 'full' AS action, 0.92::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 3 = 0")
def rules_of_tables(t: Tables) -> DataFrame:
    return etl.table_rules(etl.table_records(etl.classify_tables(_tables(t), body_control()), body_control())).select("rule_type", "condition", "action", "confidence")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS source, CASE WHEN n_nationkey % 3 < 2 THEN 'to ' || n_regionkey END AS target FROM nation")
def transition_split(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 3
    said = F.concat("n_name", F.when(k == 0, " -> ").when(k == 1, " → ").otherwise(" "), _text("to ", F.col("n_regionkey")))
    return t.nation.select("n_nationkey", etl.split_transition(said).alias("x")).select("n_nationkey", "x.source", "x.target")


@query(f"WITH {_M}, s AS (SELECT 'M' || (n_nationkey % 3) AS module, 'S' || n_nationkey AS state, n_nationkey < 3 AS i, n_nationkey % 5 = 0 AS t FROM nation), a AS (SELECT DISTINCT module, dst AS state FROM m), b AS (SELECT DISTINCT module, src AS state FROM m) SELECT module, 'unreachable' AS kind, state FROM s WHERE NOT i AND (module, state) NOT IN (SELECT (module, state) FROM a) UNION ALL SELECT module, 'deadlock', state FROM s WHERE NOT t AND (module, state) NOT IN (SELECT (module, state) FROM b) UNION ALL SELECT * FROM (SELECT module, 'unknown', state FROM (SELECT * FROM a UNION SELECT * FROM b) WHERE (module, state) NOT IN (SELECT (module, state) FROM s))")
def machine_validation(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    states = t.nation.select(_text("M", k % 3).alias("module"), _text("S", k).alias("name"), (k < 3).alias("is_initial"), (k % 5 == 0).alias("is_terminal"))
    return etl.validate_machine(states, _machine(t))


# --- graphs and reasoning --------------------------------------------------------------------------------------------

_E = f"""{_M}, {_R},
st AS (SELECT DISTINCT src AS name FROM m UNION SELECT DISTINCT dst FROM m), sg AS (SELECT DISTINCT unnest(action_signals) AS name FROM r),
us AS (SELECT r.*, name FROM r JOIN sg ON contains(lower(condition || ' ' || action), lower(name))),
e AS (SELECT 'state' AS src_type, src, 'state' AS dst_type, dst, 'transition: ' || left(guard, 60) AS via FROM m
UNION SELECT 'state', name, 'rule', rule_id::VARCHAR, 'guarded by ' || name FROM r JOIN st ON contains(lower(preconditions[1]), lower(name))
UNION SELECT 'signal', name, 'rule', rule_id::VARCHAR, 'signal ' || name FROM us
UNION SELECT 'signal', name, 'state', target_state, 'rule ' || rule_id FROM us WHERE target_state <> ''
UNION SELECT 'rule', rule_id::VARCHAR, 'state', target_state, 'rule ' || rule_id FROM r WHERE target_state <> ''
UNION SELECT 'rule', rule_id::VARCHAR, 'signal', action_signals[1], 'rule ' || rule_id FROM r)"""
_SEEDS = "seeds(seed, seed_type) AS (VALUES ('S4', 'state'), ('Sig_Abc2', 'signal'))"


def _seeds(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("S4", "state"), ("Sig_Abc2", "signal")], "seed string, seed_type string")


def _tree_sql(hops: int) -> str:
    """Least depths by breadth, hop by hop; the reason is the smallest among those of that depth."""
    parts = ["d0 AS (SELECT seed, seed_type AS node_type, seed AS node, 0 AS depth, NULL AS via FROM seeds)"]
    for k in range(1, hops + 1):
        known = " UNION ALL ".join(f"SELECT seed, node_type, node FROM d{i}" for i in range(k))
        parts.append(f"d{k} AS (SELECT d.seed, e.dst_type AS node_type, e.dst AS node, {k} AS depth, min(e.via) AS via FROM d{k - 1} d JOIN e ON e.src_type = d.node_type AND e.src = d.node WHERE (d.seed, e.dst_type, e.dst) NOT IN ({known}) GROUP BY 1, 2, 3)")
    return ", ".join(parts)


_CHAIN = f"{_E}, {_SEEDS}, {_tree_sql(3)}, f AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"


@query(f"WITH {_CHAIN} SELECT seed, node_type, node, depth, via FROM f")
def forward_chain_typed(t: Tables) -> DataFrame:
    return reasoning.forward_chain(reasoning.impact_edges(_machine(t), _rules(t)), _seeds(t), 3)


_SAID = "lower(concat_ws(' ', rule_id::VARCHAR, condition, action, target_state, preconditions[1]))"


@query(f"WITH {_CHAIN}, p AS (SELECT DISTINCT node, coalesce((SELECT module FROM r WHERE r.rule_id::VARCHAR = f.node), (SELECT arg_min(module, rule_id) FROM r WHERE contains({_SAID}, lower(f.node))), 'Unknown') AS module FROM f) SELECT seed, count(DISTINCT (node_type, f.node)) AS total_impacted, max(depth) AS total_depth, array_to_string(list_sort(list_distinct(list(module))), '/') AS modules FROM f JOIN p USING (node) GROUP BY 1")
def impact_reports(t: Tables) -> DataFrame:
    found = reasoning.forward_chain(reasoning.impact_edges(_machine(t), _rules(t)), _seeds(t), 3)
    return reasoning.impact_report(found, _rules(t)).withColumn("modules", F.array_join("modules", "/"))


@query(f"WITH {_R} SELECT n_name AS name, coalesce((SELECT arg_min(module, rule_id) FROM r WHERE contains({_SAID}, lower('S' || n_nationkey))), 'Unknown') AS module FROM nation")
def module_of_first_rule(t: Tables) -> DataFrame:
    names = t.nation.select(_text("S", F.col("n_nationkey")).alias("name"), "n_name")
    got = reasoning.first_rule_module(names.select("name"), _rules(t))
    return names.join(got, "name").select(F.col("n_name").alias("name"), "module")


_COND = f"""WITH RECURSIVE {_M}, e AS (SELECT DISTINCT dst AS state, src, guard FROM m WHERE src <> dst), inc AS (SELECT state, count(*) AS branches FROM e GROUP BY 1),
w AS (SELECT 'S' || n_nationkey AS goal, 'S' || n_nationkey AS state, ['S' || n_nationkey] AS path, 0 AS level, NULL::VARCHAR AS guard, false AS cycle FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT w.goal, e.src, list_append(path, e.src), level + 1, e.guard, list_contains(path, e.src) FROM w JOIN e ON e.state = w.state WHERE NOT cycle AND level < 3)
SELECT goal, array_to_string(path, '<') AS path, level, CASE WHEN cycle OR branches IS NULL OR level = 3 THEN 'LEAF' WHEN branches > 1 THEN 'OR' ELSE 'AND' END AS kind,
CASE WHEN cycle OR branches IS NULL OR level = 3 THEN 0 ELSE branches END AS branches, guard, CASE WHEN guard <> '' THEN split_part(guard, ' ', 1) ELSE '' END AS signals FROM w LEFT JOIN inc USING (state)"""


@query(_COND)
def condition_tree_and_or(t: Tables) -> DataFrame:
    goals = t.nation.where("n_nationkey % 5 = 0").select(_text("S", F.col("n_nationkey")).alias("goal"))
    tree = reasoning.condition_tree(_machine(t), goals, 3)
    return tree.withColumn("path", F.array_join("path", "<")).withColumn("signals", F.array_join("signals", "/"))


@query(f"WITH RECURSIVE {_M}, w AS (SELECT DISTINCT src AS start, dst AS goal, [src, dst] AS path FROM m WHERE src <> dst UNION SELECT w.start, m.dst, list_append(path, m.dst) FROM w JOIN m ON m.src = w.goal WHERE NOT list_contains(path, m.dst) AND len(path) < 4), s AS (SELECT *, unnest(range(1, len(path))) AS n FROM w WHERE start = 'S0'), g AS (SELECT s.*, coalesce((SELECT arg_min(guard, ord) FROM m WHERE src = path[n] AND dst = path[n + 1]), '') AS guard FROM s) SELECT start, goal, array_to_string(path, '>') AS path, len(path)::INT - 1 AS hops, string_agg(guard, ';' ORDER BY n) AS guards, array_to_string(list_sort(list_distinct(list_filter(list(split_part(guard, ' ', 1)), lambda x: x <> ''))), '/') AS signals FROM g GROUP BY 1, 2, 3, 4")
def paths_with_guards(t: Tables) -> DataFrame:
    m = _machine(t)
    pairs = t.nation.where("n_nationkey > 0").select(F.lit("S0").alias("start"), _text("S", F.col("n_nationkey")).alias("goal"))
    got = reasoning.path_guards(graph.simple_paths(m, pairs, 3), m)
    return got.select("start", "goal", F.array_join("path", ">").alias("path"), "hops", F.array_join("guards", ";").alias("guards"), F.array_join("signals", "/").alias("signals"))


_NAMES = "a AS (SELECT 'Sig_Abc' || r_regionkey AS term FROM region UNION ALL SELECT 'S' || (r_regionkey + 10) FROM region)"


@query(f"WITH {_M}, {_R}, {_NAMES}, h AS (SELECT a.term, r.* FROM a JOIN r ON contains(lower(concat_ws(' ', condition, action, target_state, preconditions[1])), lower(term))), b AS (SELECT term, count(DISTINCT rule_id) AS rules, array_to_string(list_sort(list_distinct(list(module))), '/') AS modules, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(action, '[A-Z][A-Za-z0-9_]{{3,}}')))))[1:8], '/') AS signals FROM h GROUP BY 1), k AS (SELECT term, src || '->' || dst AS x, row_number() OVER (PARTITION BY term, module ORDER BY ord) AS n FROM a JOIN m ON contains(lower(guard), lower(term))), c AS (SELECT term, array_to_string(list_sort(list(x)), '/') AS transitions FROM k WHERE n <= 3 GROUP BY 1) SELECT term, coalesce(rules, 0) AS rules, coalesce(modules, '') AS modules, coalesce(signals, '') AS signals, coalesce(transitions, '') AS transitions FROM a LEFT JOIN b USING (term) LEFT JOIN c USING (term)")
def impact_summaries(t: Tables) -> DataFrame:
    k = F.col("r_regionkey")
    terms = t.region.select(_text("Sig_Abc", k).alias("term")).unionByName(t.region.select(_text("S", k + 10).alias("term")))
    got = reasoning.impact_summary(terms, _rules(t), _machine(t))
    return got.select("term", "rules", *(F.array_join(c, "/").alias(c) for c in ("modules", "signals", "transitions")))


@query(f"WITH {_M}, s AS (SELECT 'S' || r_regionkey AS state FROM region) SELECT state, 'incoming' AS direction, src AS other, guard FROM s JOIN m ON dst = state UNION ALL SELECT state, 'outgoing', dst, guard FROM s JOIN m ON src = state")
def transitions_of_states(t: Tables) -> DataFrame:
    return reasoning.state_moves(_machine(t), t.region.select(_text("S", F.col("r_regionkey")).alias("state")))


@query(f"WITH {_M}, h AS (SELECT n_regionkey AS query_id, 'S' || n_nationkey AS state FROM nation), x AS (SELECT query_id, src, dst, arg_min(guard, ord) AS guard, min(ord) AS ord FROM h JOIN m ON state = src OR state = dst GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, src, dst) AS n FROM x) SELECT query_id, src, dst, guard, n FROM n WHERE n <= 10")
def evidence_transitions(t: Tables) -> DataFrame:
    return reasoning.evidence_transitions(t.nation.select(F.col("n_regionkey").alias("query_id"), _text("S", F.col("n_nationkey")).alias("state")), _machine(t))


@query("SELECT n_nationkey AS query_id, 'S' || n_nationkey AS start, 'S' || (2 * n_nationkey) AS goal FROM nation WHERE 2 * n_nationkey < 25")
def pairs_of_known_states(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return reasoning.both_machines(t.nation.select(k.alias("query_id"), _text("S", k).alias("start"), _text("S", 2 * k).alias("goal")), _machine(t))


_K = """k AS (SELECT 'c' || c_custkey AS entity_id, c_name AS name, c_mktsegment AS module, 'customer' AS entity_type FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, 'G' || n_regionkey, 'nation' FROM nation),
ke AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'in' AS rel, c_custkey AS ord FROM customer)"""


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    c, n = t.customer, t.nation
    entities = c.select(_text("c", F.col("c_custkey")).alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("module"), F.lit("customer").alias("entity_type"))
    nations = n.select(_text("n", F.col("n_nationkey")).alias("entity_id"), F.col("n_name").alias("name"), _text("G", F.col("n_regionkey")).alias("module"), F.lit("nation").alias("entity_type"))
    edges = c.select(_text("c", F.col("c_custkey")).alias("src"), _text("n", F.col("c_nationkey")).alias("dst"), F.lit("in").alias("rel"), F.col("c_custkey").alias("ord"))
    return entities.unionByName(nations), edges


@query(f"WITH {_K}, f AS (SELECT n_nationkey AS query_id, 'n' || n_nationkey AS id FROM nation), x AS (SELECT query_id, module FROM f JOIN k ON entity_id = id UNION SELECT query_id, module FROM f JOIN ke ON dst = id JOIN k ON entity_id = src) SELECT query_id, string_agg(module, '/' ORDER BY module) AS modules FROM x GROUP BY 1")
def signal_module_routing(t: Tables) -> DataFrame:
    entities, edges = _graph(t)
    got = reasoning.signal_modules(t.nation.select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("signal")), entities, edges)
    return got.withColumn("modules", F.array_join("modules", "/"))


@query(f"WITH {_K} SELECT a.module AS src_module, b.module AS dst_module, 'in' AS rels, count(*) AS n FROM ke JOIN k a ON a.entity_id = src JOIN k b ON b.entity_id = dst GROUP BY 1, 2")
def cross_module_relations(t: Tables) -> DataFrame:
    entities, edges = _graph(t)
    return reasoning.cross_module(edges, entities).withColumn("rels", F.array_join("rels", "/"))


@query(f"WITH {_K} SELECT 'n' || n_nationkey AS seed, '' AS out_nodes, coalesce((SELECT string_agg(src, '/' ORDER BY src) FROM ke WHERE dst = 'n' || n_nationkey), '') AS in_nodes FROM nation")
def entity_contexts(t: Tables) -> DataFrame:
    got = reasoning.entity_context(_graph(t)[1], t.nation.select(_text("n", F.col("n_nationkey")).alias("seed")))
    return got.select("seed", F.array_join("out_nodes", "/").alias("out_nodes"), F.array_join("in_nodes", "/").alias("in_nodes"))


_Q = "q AS (SELECT r_regionkey AS query_id, '0' || r_regionkey AS term FROM region UNION ALL SELECT 10 + n_nationkey, n_name FROM nation)"


def _terms(t: Tables) -> DataFrame:
    return t.region.select(F.col("r_regionkey").alias("query_id"), _text("0", F.col("r_regionkey")).alias("term")).unionByName(t.nation.select((F.col("n_nationkey") + 10).alias("query_id"), F.col("n_name").alias("term")))


@query(f"WITH {_K}, {_Q}, h AS (SELECT query_id, term, entity_id, entity_type, CASE WHEN lower(name) = lower(term) THEN 'exact' ELSE 'partial' END AS tier FROM q JOIN k ON contains(lower(name), lower(term))), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, term, entity_type, tier ORDER BY entity_id) AS i FROM h) SELECT query_id, term, entity_id, entity_type, tier FROM n WHERE i <= CASE tier WHEN 'exact' THEN 3 ELSE 5 END")
def capped_entity_hits(t: Tables) -> DataFrame:
    return reasoning.capped_entities(_terms(t), _graph(t)[0])


@query(f"WITH {_K}, {_Q} SELECT term, entity_id, name FROM q JOIN k ON contains(lower(name), lower(term)) OR contains(lower(entity_id), lower(term))")
def entity_search_contains(t: Tables) -> DataFrame:
    return graph.search_entities(_graph(t)[0], _terms(t).select("term"))


@query("SELECT DISTINCT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'controls' AS rel FROM orders WHERE o_orderkey % 3 > 0")
def fk_antijoin_enrich(t: Tables) -> DataFrame:
    """New edges against a third of them that are known already; each comes twice and is kept once."""
    o = t.orders.select(_text("o", F.col("o_orderkey")).alias("src"), _text("c", F.col("o_custkey")).alias("dst"), F.lit("controls").alias("rel"), F.lit(0.6).alias("weight"), "o_orderkey")
    known = o.where("o_orderkey % 3 = 0").select("src", "dst", "rel")
    return graph.enrich(known, o.unionByName(o).drop("o_orderkey")).select("src", "dst", "rel")


@query(f"WITH RECURSIVE {_M}, f AS (SELECT src, arg_min(dst, ord) AS next FROM m GROUP BY 1), w AS (SELECT 'S' || n_nationkey AS start, 'S' || n_nationkey AS node, ['S' || n_nationkey] AS path, 0 AS k FROM nation UNION ALL SELECT start, next, list_append(path, next), k + 1 FROM w JOIN f ON src = node WHERE k < 5 AND NOT list_contains(path, next)) SELECT start, array_to_string(arg_max(path, k), '>') AS path FROM w GROUP BY 1")
def greedy_chains(t: Tables) -> DataFrame:
    got = graph.greedy_chain(_machine(t), t.nation.select(_text("S", F.col("n_nationkey")).alias("start")))
    return got.withColumn("path", F.array_join("path", ">"))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, 2 * n_nationkey + 1 AS dst FROM nation WHERE 2 * n_nationkey + 1 < 25 UNION SELECT n_nationkey, n_nationkey + 10 FROM nation WHERE n_nationkey + 10 < 25), w AS (SELECT n_nationkey AS node, 0 AS level FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM w JOIN e ON src = node) SELECT node, max(level)::INT AS level FROM w GROUP BY 1")
def topological_levels(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    e = t.nation.select(k.alias("src"), (2 * k + 1).alias("dst")).unionByName(t.nation.select(k.alias("src"), (k + 10).alias("dst"))).where("dst < 25")
    return graph.levels(e, t.nation.select(k.alias("node")), 8)


@query("SELECT n_nationkey, list_transform(generate_series(len(string_split(p, '.')), 1, -1), lambda i: array_to_string(string_split(p, '.')[1:i], '.')) AS sections FROM (SELECT n_nationkey, n_regionkey || '.' || n_nationkey || '.' || (n_nationkey % 3) AS p FROM nation) WHERE false UNION ALL SELECT n_nationkey, [n_regionkey::VARCHAR, n_regionkey || '.' || n_nationkey, n_regionkey || '.' || n_nationkey || '.' || (n_nationkey % 3)] FROM nation")
def section_ancestors(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    hits = t.nation.select(k.alias("query_id"), _text(F.col("n_regionkey"), ".", k, ".", k % 3).alias("section_path"))
    got = retrieval.hit_sections(hits).groupBy(F.col("query_id").alias("n_nationkey")).agg(F.array_sort(F.collect_set("section")).alias("sections"))
    return got


# --- rules -----------------------------------------------------------------------------------------------------------


@query("SELECT 'pin_PIN_' || s_nationkey AS entity_id, 'PIN ' || s_nationkey AS name, count(*) AS n FROM supplier GROUP BY 1, 2")
def pin_promotion(t: Tables) -> DataFrame:
    e = t.supplier.select(_text("s", F.col("s_suppkey")).alias("entity_id"), F.lit("signal").alias("entity_type"), F.create_map(F.lit("pin"), _text(" PIN ", F.col("s_nationkey"))).alias("properties"))
    pins, edges = enrich.promote_pins(e)
    return pins.join(edges, pins["entity_id"] == edges["dst"]).groupBy(pins["entity_id"], "name").agg(F.count(F.lit(1)).alias("n"))


# --- evidence and scores ---------------------------------------------------------------------------------------------


@query("WITH l AS (SELECT s_nationkey AS query_id, min(s_suppkey) AS ord, 'N' || (s_suppkey % 4) || ' --[in]--> ' || CASE s_suppkey % 3 WHEN 0 THEN 'M' || (s_suppkey % 2) WHEN 1 THEN 'T' ELSE 'src' END AS line FROM supplier GROUP BY 1, 3), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, line) AS n FROM l) SELECT query_id, line, n FROM n WHERE n <= 20")
def relation_evidence_lines(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    hits = t.supplier.select(F.col("s_nationkey").alias("query_id"), k.alias("ord"), _text("N", k % 4).alias("name"), F.lit("in").alias("rel"), F.when(k % 3 == 0, _text("M", k % 2)).otherwise("").alias("module"), F.when(k % 3 == 1, "T").alias("target"), F.lit("").alias("related_to"), F.lit("src").alias("source"))
    return enrich.relation_lines(hits)


@query("WITH c AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, c_acctbal / 1000 AS score, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 + 1 END AS rank FROM customer), s AS (SELECT *, CASE WHEN rank IS NULL THEN 0.7 * score ELSE 0.6 * score + 0.4 / rank END AS f FROM c) SELECT query_id, doc_id, round(f, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank IS NULL, round(f, 9) DESC, doc_id)::INT AS position FROM s")
def model_rank_fusion(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    c = t.customer.select(F.col("c_nationkey").alias("query_id"), k.alias("doc_id"), (F.col("c_acctbal") / 1000).alias("score"))
    ranks = t.customer.where(k % 3 == 0).select(F.col("c_nationkey").alias("query_id"), k.alias("doc_id"), (k % 5 + 1).alias("rank"))
    return enrich.fuse_ranking(c, ranks).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


@query("SELECT s_suppkey, round(0.8 / greatest(s_suppkey % 4, 1), 6)::DOUBLE AS score, round(CASE WHEN s_suppkey % 7 >= 2 THEN s_suppkey * (1 + 0.2 * least(s_suppkey % 7, 5)) ELSE s_suppkey END, 6)::DOUBLE AS boosted FROM supplier")
def graph_and_keyword_scores(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", F.round(enrich.wrapped_score(k % 4), 6).alias("score"), F.round(search.keyword_boost(k.cast("double"), k % 7), 6).alias("boosted"))


@query("WITH p AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, c_name AS text, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer) SELECT query_id, 'G_' || rank AS key, doc_id, left(text, 12) AS summary FROM p WHERE rank <= 8 UNION ALL SELECT query_id, 'V_' || rank, doc_id, left(text, 12) FROM p WHERE rank <= 12")
def fusion_pools(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text"), (-F.col("c_custkey")).alias("score"))
    r = search.ranked(c, 99)
    return reasoning.fusion_pool(r, r, width=12)


@query("WITH r AS (SELECT c_nationkey AS query_id, c_mktsegment AS module, 's' || (c_custkey % 7) AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer) SELECT query_id, array_to_string(list_sort(list_distinct(list(module))), '/') AS modules, array_to_string(list_sort(list_distinct(list(s)))[1:3], '/') AS signals FROM r WHERE rank <= 10 GROUP BY 1")
def result_facets(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    r = search.ranked(t.customer.select(F.col("c_nationkey").alias("query_id"), k.alias("doc_id"), (-k).alias("score"), F.col("c_mktsegment").alias("module"), F.array(_text("s", k % 7)).alias("signals"), F.lit(None).cast("array<string>").alias("states")), 99)
    return reasoning.query_facets(r).select("query_id", F.array_join("modules", "/").alias("modules"), F.array_join("signals", "/").alias("signals"))


@query("WITH n AS (SELECT user_id AS query_id, event_type AS cause, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cause) AS rank FROM n) SELECT query_id, cause, round(least(0.15 * n + 0.3, 0.95), 6)::DOUBLE AS likelihood, rank FROM r WHERE rank <= 5")
def hypothesis_likelihood(t: Tables) -> DataFrame:
    got = reasoning.hypotheses(t.events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("cause")))
    return got.withColumn("likelihood", F.round("likelihood", 6))


@query("SELECT DISTINCT user_id AS query_id, event_type AS source, 'q' || (event_id % 3) AS query FROM events WHERE event_id % 2 = 0 AND (user_id, event_type, 'q' || (event_id % 3)) NOT IN (SELECT (user_id, event_type, 'q' || (event_id % 3)) FROM events WHERE event_id % 2 = 1)")
def retrieval_step_dedup(t: Tables) -> DataFrame:
    steps = t.events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("source"), _text("q", F.col("event_id") % 3).alias("query"), "event_id")
    return reasoning.new_steps(steps.where("event_id % 2 = 1"), steps.where("event_id % 2 = 0"))


@query("SELECT event_type AS node, count(*) AS runs, count(*) FILTER (event_id % 3 > 0) AS ok, count(*) FILTER (event_id % 3 = 0) AS failed, round(count(DISTINCT user_id) * 1.0 / (SELECT count(DISTINCT user_id) FROM events), 6)::DOUBLE AS utilisation, round(avg((event_id % 10) / 10.0), 6)::DOUBLE AS mean_confidence FROM events GROUP BY 1")
def plan_node_health(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("node"), F.when(F.col("event_id") % 3 > 0, "ok").otherwise("failed").alias("status"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    got = evaluation.node_health(e)
    return got.select("node", "runs", "ok", "failed", F.round("utilisation", 6).alias("utilisation"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query("WITH x AS (SELECT n_nationkey AS k, n_nationkey % 3 AS a, n_nationkey % 2 AS b FROM nation) SELECT k AS n_nationkey, round(0.35 * (1 + (a = 1)::INT) / 2.0 + 0.15 * CASE b WHEN 0 THEN 1 ELSE 0 END + 0.35 * 0.5 + 0.15 * (a <> 2 OR b = 1)::INT, 6)::DOUBLE AS path, round(0.5 * 0.5 + 0.3 * (1 - (CASE WHEN a = 0 THEN 0.5 ELSE 0 END)) + 0.2 * least(1, k / 10.0), 6)::DOUBLE AS impact, round(greatest(0, CASE b WHEN 0 THEN 0.5 * 0.5 + 0.5 * 1.0 - 0.2 * (a = 0)::INT ELSE 1 - 0.2 END), 6)::DOUBLE AS issues FROM x")
def reasoning_scores(t: Tables) -> DataFrame:
    """Path, impact and reachability scores of made-up answers whose parts are known."""
    k = F.col("n_nationkey")
    a, b = k % 3, k % 2
    words = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    second = F.when(a == 1, "B").otherwise(_text("X", a))
    none = F.array().cast("array<string>")
    path = F.when(b == 0, words("A", second)).otherwise(words("A", second, "C"))
    score = evaluation.path_score(path, words("A", "B"), words("Sig = 1"), words("sig", "zzz"), F.array(F.when(b == 0, words("A", "X2")).otherwise(words("Z"))))
    impact = evaluation.impact_score(words("one", F.when(a == 0, "bad").otherwise("fine")), words("ONE", "two"), words("BAD"), k, F.lit(10))
    issues = evaluation.issue_score(words("deadlock"), F.when(b == 0, words("deadlock", "livelock")).otherwise(none), F.when(a == 0, words("deadlock")).otherwise(none))
    return t.nation.select("n_nationkey", F.round(score, 6).alias("path"), F.round(impact, 6).alias("impact"), F.round(issues, 6).alias("issues"))


# --- sinks -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_K} SELECT count(*) FILTER (entity_id LIKE 'n%') AS nations, count(*) FILTER (entity_id LIKE 'c%') AS customers, (SELECT count(*) FROM ke) AS relations FROM k")
def cypher_statements(t: Tables) -> DataFrame:
    entities, edges = _graph(t)
    said = sinks.cypher(entities, edges.withColumn("weight", F.lit(1.0)))
    like = lambda p: F.count_if(F.col("statement").like(p))
    return said.agg(like("MERGE (n:Nation%").alias("nations"), like("MERGE (n:Customer%").alias("customers"), like("MATCH%").alias("relations"))


@query("WITH i AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'N ' || s_nationkey END AS module, s_name AS content FROM supplier) SELECT s_suppkey, CASE WHEN module = '' THEN 'unknown' ELSE replace(module, ' ', '_') END || '/root/' || left(md5(content), 8) || '.png' AS storage_path FROM i")
def image_store_paths(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    images = t.supplier.select("s_suppkey", F.when(k % 3 == 0, "").otherwise(_text("N ", F.col("s_nationkey"))).alias("module"), F.lit(None).cast("string").alias("section"), F.col("s_name").cast("binary").alias("content"), F.lit("").alias("suffix"))
    return sinks.image_paths(images).select("s_suppkey", "storage_path")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'type' || s_nationkey ELSE '' END AS image_type, CASE WHEN s_nationkey % 2 = 0 THEN repeat('a picture ', 50) ELSE '' END AS description FROM supplier")
def image_captions(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    captions = t.nation.where(k % 2 == 0).select(k.cast("string").alias("name"), _text("type", k).alias("image_type"), F.repeat(F.lit("a picture "), F.lit(90)).alias("description"))
    return sinks.captioned(t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("name")), captions).select("s_suppkey", "image_type", "description")


# --- agents ----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || '/to ' || n_nationkey || '/last' ELSE n_name END AS parts FROM nation WHERE n_name NOT LIKE '% %'")
def question_parts(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    said = F.when(k % 2 == 0, F.concat(F.lower("n_name"), _text(" and to ", k, "，last？last; "))).otherwise(F.col("n_name"))
    return t.nation.where("n_name not like '% %'").select("n_nationkey", F.array_join(agent.sub_questions(said), "/").alias("parts"))


@query("WITH e AS (SELECT s_nationkey AS query_id, 'supplier alpha' || CASE WHEN s_nationkey % 2 = 0 THEN ' beta' ELSE '' END AS text FROM supplier), k AS (SELECT DISTINCT query_id FROM e) SELECT n_nationkey AS query_id, round(CASE WHEN k.query_id IS NULL THEN 0 WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END / 3.0, 6)::DOUBLE AS covered, CASE WHEN k.query_id IS NULL THEN 'alpha/beta' WHEN n_nationkey % 2 = 0 THEN 'gamma' ELSE 'beta/gamma' END AS gaps FROM nation LEFT JOIN k ON k.query_id = n_nationkey")
def evidence_gaps(t: Tables) -> DataFrame:
    asked = t.nation.select(F.col("n_nationkey").alias("query_id"), F.lit("alpha beta gamma").alias("query"))
    e = t.supplier.select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("supplier alpha"), F.when(F.col("s_nationkey") % 2 == 0, " beta").otherwise("")).alias("text"))
    return agent.keyword_gaps(asked, e).select("query_id", F.round("covered", 6).alias("covered"), F.array_join("gaps", "/").alias("gaps"))


@query("SELECT DISTINCT s_nationkey AS query_id, s_name AS cited FROM supplier WHERE s_suppkey % 4 = 0")
def answer_citations(t: Tables) -> DataFrame:
    s = t.supplier
    answers = s.where("s_suppkey % 4 = 0").groupBy(F.col("s_nationkey").alias("query_id")).agg(F.concat(F.lit("see "), F.array_join(F.array_sort(F.collect_list("s_name")), ", ")).alias("answer"))
    return agent.citations(answers, s.select(F.col("s_nationkey").alias("query_id"), F.col("s_name").alias("id")))


@query("SELECT c_custkey, starts_with(c_name, left(c_mktsegment, 1)) OR starts_with(c_name, 'Cust') AS in_section, round(CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1 END, 6)::DOUBLE AS recall FROM customer")
def section_and_entity_recall(t: Tables) -> DataFrame:
    """Prefix matches of sections, and the share of expected entities that were found (whole where none is expected)."""
    found, expected = F.array("c_name", "c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_name", F.lit("zz"))).otherwise(F.array().cast("array<string>"))
    prefix = F.exists(F.array(F.left("c_mktsegment", F.lit(1)), F.lit("Cust")), lambda p: F.startswith(F.col("c_name"), p))
    return t.customer.select("c_custkey", prefix.alias("in_section"), F.round(evaluation.recall(found, expected), 6).alias("recall"))


# --- readers: artefacts are written to the shared folder as the JSON they lie in, and read back -----------------------


def _written(t: Tables, rows: DataFrame, head: str, body: Column, tail: str = "]}", folder: str | None = None, size: int = 1000) -> str:
    """JSON files of one object each, whose list holds ``body`` of some ``size`` rows: as many files as the rows need, each in its own folder."""
    folder = folder or f"{shared_folder(t.spark)}/json-{uuid.uuid4().hex}"
    files = max(1, -(-rows.count() // size))
    cut = rows.select(body.alias("body")).withColumn("file", F.concat(F.lit(uuid.uuid4().hex[:6]), F.pmod(F.xxhash64("body"), F.lit(files)).cast("string")))
    one = cut.groupBy("file").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("body")), ","), F.lit(tail)).alias("value"))
    one.write.mode("append").partitionBy("file").text(folder)
    return folder


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


@query("SELECT 'c' || n_nationkey AS chunk_id, n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS n_entities, false AS has_table FROM nation")
def read_chunk_files(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    one = _json(chunk_id=_text("c", k), text=F.col("n_name"), entities=F.when(k % 2 == 0, F.array(F.lit("e"))))
    got = readers.read_chunks(t.spark, _written(t, t.nation, '{"text_chunks": [', one))
    return got.select("chunk_id", "text", F.size("entities").alias("n_entities"), "has_table")


@query("SELECT 'p' || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN '0.0/0.0' ELSE n_nationkey || '.0/1.5' END AS vector FROM nation")
def read_point_files(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    one = _json(id=_text("p", k), vector=F.when(k % 3 > 0, F.array(k.cast("double"), F.lit(1.5))))
    got = readers.read_points(t.spark, _written(t, t.nation, '{"dim": 2, "points": [', one))
    return got.select("id", F.array_join(F.transform("vector", lambda x: x.cast("string")), "/").alias("vector"))


@query("SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS rel, 1.0::DOUBLE AS weight, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 > 0")
def read_graph_files(t: Tables) -> DataFrame:
    """Nodes and edges under their other names; edges without a source are left out, sources without a node are bare."""
    k = F.col("n_nationkey")
    nodes = _json(id=_text("r", F.col("r_regionkey")), name=F.col("r_name"), type=F.lit("region"))
    edges = _json(source=F.when(k % 5 > 0, _text("n", k)).otherwise(""), target=_text("r", F.col("n_regionkey")), type=F.lit("IN"))
    folder = _written(t, t.nation, '{"edges": [', edges, folder=_written(t, t.region, '{"nodes": [', nodes))
    entities, links = readers.read_graph(t.spark, folder)
    named = entities.where("entity_type = 'region'").select(F.col("entity_id").alias("dst"), "name")
    bare = entities.where("entity_type = ''").select(F.col("entity_id").alias("src"))
    return links.join(named, "dst").join(bare, "src", "left_semi").select("src", "dst", "rel", "weight", "name")


@query("SELECT 'R' || p_partkey AS rule_id, p_brand AS module, 'size = ' || p_size AS condition, p_type AS action, 0.0::DOUBLE AS confidence FROM part")
def read_rule_files(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    one = _json(rule_id=_text("R", k), module=F.col("p_brand"), condition_expr=F.when(k % 2 == 0, _text("size = ", F.col("p_size"))), condition=F.when(k % 2 == 1, _text("size = ", F.col("p_size"))), action_text=F.col("p_type"))
    return readers.read_rules(t.spark, _written(t, t.part, '{"rules": [', one)).select("rule_id", "module", "condition", "action", "confidence")


@query(f"WITH {_M} SELECT 'K' AS module, src, dst, guard FROM m")
def read_machine_files(t: Tables) -> DataFrame:
    one = _json(source=F.col("src"), target=F.col("dst"), guard=F.nullif("guard", F.lit("")))
    return readers.read_state_machines(t.spark, _written(t, _machine(t), '{"module": "K", "states": [], "transitions": [', one))[1].select("module", "src", "dst", "guard")


@query("SELECT 's' || n_nationkey AS section_id, 's' || n_regionkey AS parent_id, 1 AS level, n_name AS title, '' AS module FROM nation")
def read_section_files(t: Tables) -> DataFrame:
    one = _json(id=_text("s", F.col("n_nationkey")), parent_id=_text("s", F.col("n_regionkey")), title=F.col("n_name"))
    return readers.read_sections(t.spark, _written(t, t.nation, '{"nodes": [', one)).select("section_id", "parent_id", "level", "title", "module")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages WHERE regexp_matches(html, '(?s)<h1[^>]*>\\s*[^<\\s]') AND NOT contains(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '&')")
def page_titles(t: Tables) -> DataFrame:
    """Titles of level 1 as the page parser finds them, of pages whose title has no character entity."""
    plain = t.pages.where(F.col("html").rlike(r"(?s)<h1[^>]*>\s*[^<\s]") & ~F.contains(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1), F.lit("&")))
    first = readers.page_items(plain).where("type = 'title' and level = 1").groupBy("doc_id").agg(F.min_by("text", "idx").alias("title"))
    return first.select(F.col("doc_id").cast("long").alias("page_id"), "title")


@query("SELECT n_regionkey AS doc_id, n_nationkey AS idx, n_nationkey % 3 AS page, CASE WHEN n_nationkey % 4 = 0 THEN 'title' ELSE 'paragraph' END AS type, CASE WHEN n_nationkey % 4 = 0 THEN 2 END AS level, n_name AS text FROM nation WHERE n_nationkey % 7 > 0")
def page_wrapping(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    flat = t.nation.select(F.col("n_regionkey").alias("doc_id"), k.alias("idx"), (k % 3).alias("page_idx"), F.when(k % 7 == 0, "footer").otherwise("text").alias("type"), F.when(k % 4 == 0, 2).alias("text_level"), F.col("n_name").alias("text"), F.lit(None).cast("string").alias("html"))
    return etl.page_wrap(flat).select("doc_id", "idx", "page", "type", "level", "text")


# --- more sinks, evidence, embeddings --------------------------------------------------------------------------------


@query(f"WITH {_M} SELECT module, string_agg(src || ' -> ' || dst || CASE WHEN guard <> '' THEN ' [' || guard || ']' ELSE '' END, chr(10) ORDER BY src || ' -> ' || dst || CASE WHEN guard <> '' THEN ' [' || guard || ']' ELSE '' END) AS summary FROM m GROUP BY 1")
def machine_summaries(t: Tables) -> DataFrame:
    return sinks.machine_summary(_machine(t))


@query("SELECT doc_id AS id, lang AS module, length(left(coalesce(text, ''), 5000)) AS n FROM documents")
def point_payloads(t: Tables) -> DataFrame:
    c = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("module"), F.lit("x").alias("chunk_type"), F.lit("").alias("section_path"), F.lit("").alias("section_title"), "text", F.col("text").alias("embedding_text"), F.lit(False).alias("has_table"), F.lit(1).alias("token_count"))
    return sinks.vector_points(c).select("id", "payload.module", F.length("payload.embedding_text").alias("n"))


@query("WITH r AS (SELECT s_nationkey AS query_id, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier) SELECT query_id, string_agg('### ' || rank || '. ' || s_suppkey || chr(10) || s_name, chr(10) || chr(10) ORDER BY rank) AS evidence FROM r WHERE rank <= 8 GROUP BY 1")
def evidence_markdown(t: Tables) -> DataFrame:
    r = search.ranked(t.supplier.select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("doc_id"), (-F.col("s_suppkey")).alias("score"), F.col("s_suppkey").cast("string").alias("section_title"), F.col("s_name").alias("text")), 99)
    return retrieval.evidence(r)


@query("WITH w AS (SELECT n_nationkey, unnest(regexp_extract_all(lower(n_name), '[a-z0-9_]{2,}')) AS x FROM nation), b AS (SELECT n_nationkey, ('0x' || left(md5(x), 8))::BIGINT % 8 AS k, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT n_nationkey, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1) SELECT n_nationkey, k::INT AS slot, round(n / norm, 6) AS value FROM b JOIN s USING (n_nationkey)")
def hashed_embeddings(t: Tables) -> DataFrame:
    e = search.embed(t.nation.select("n_nationkey", F.col("n_name").alias("text")), dim=8)
    return e.select("n_nationkey", F.posexplode("vector").alias("slot", "value")).where("value > 0").select("n_nationkey", "slot", F.round("value", 6).alias("value"))


@query("SELECT n_regionkey AS doc_id, 'e' || n_nationkey AS src, 'section_' || (n_nationkey // 5 * 5) AS dst, 'belongs_to' AS rel, 0.1::DOUBLE AS weight FROM nation")
def section_membership(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    e = t.nation.select(F.col("n_regionkey").alias("doc_id"), k.alias("idx"), _text("e", k).alias("entity_id"))
    placed = t.nation.select(F.col("n_regionkey").alias("doc_id"), k.alias("idx"), ((k / 5).cast("int") * 5).alias("section_idx"))
    return etl.belongs_to(e, placed).select("doc_id", "src", "dst", "rel", "weight")


@query("SELECT 'module_' || r_regionkey AS entity_id, r_name AS name FROM region")
def module_list(t: Tables) -> DataFrame:
    e = t.region.select(_text("module_", F.col("r_regionkey")).alias("entity_id"), F.col("r_name").alias("name"), F.lit("module").alias("entity_type"))
    return graph.modules(e.unionByName(t.nation.select(F.col("n_name").alias("entity_id"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"))))


@query("SELECT c_nationkey AS doc_id, c_mktsegment AS module, '1' AS section_path, string_agg(c_name || ' is the name of a customer', chr(10) ORDER BY c_custkey) AS text, (length(string_agg(c_name || ' is the name of a customer', chr(10) ORDER BY c_custkey)) // 3)::INT AS token_count FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1, 2")
def chunk_optimisation(t: Tables) -> DataFrame:
    """Heading-only chunks go, chunks of a section are joined in the order of their ids; stubs go last."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "## a\n## b\n### c\n").otherwise(F.concat("c_name", F.lit(" is the name of a customer")))
    c = t.customer.select(F.col("c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("module"), F.lit("1").alias("section_path"), text.alias("text"), F.format_string("%09d", k).alias("chunk_id"), F.lit(False).alias("has_table"))
    return etl.optimise_chunks(c).select("doc_id", "module", "section_path", "text", "token_count")
