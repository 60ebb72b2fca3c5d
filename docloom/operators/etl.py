"""From content items to sections, chunks, entities, relations, table records, rules and state machines.

Items: doc_id, idx, page, type (title, paragraph, list, table, image), level, text, html. Everything is keyed by doc_id, so a
document's order is a window over one key; only truly sequential folds run as grouped pandas, one document at a time.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import classify, coding_list, estimate_tokens, html_rows, is_stub, is_toc_only, key_terms, module_name, rule_id, safe_id, section_number, slug, text_of, voltage_range
from docloom.plans.domain import Domain

LEVELS = 6
# Words that make a name a function, and the supply terminals.
FUNCTION_WORDS = ("功能", "控制", "管理", "保护", "检测", "诊断")
TERMINALS = ("KL30", "KL15", "KL31", "KL87", "GND", "VBAT")


def doc_window(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(order or ("idx",)))


def flatten_pages(raw: DataFrame) -> DataFrame:
    """Items from (doc_id, pages: array<array<struct<type, level, text, html>>>)."""
    pages = raw.select("doc_id", F.posexplode("pages").alias("page", "items"))
    rows = pages.select("doc_id", "page", F.posexplode("items").alias("nth", "item")).select("doc_id", "page", "nth", "item.*")
    return rows.withColumn("idx", F.row_number().over(doc_window("page", "nth")) - 1).drop("nth")


def page_wrap(flat: DataFrame) -> DataFrame:
    """Flat parser output to items: text_level >= 1 makes titles (cut at 200), footers and page numbers are dropped."""
    kept = flat.where(~F.col("type").isin("footer", "page_number"))
    title = F.coalesce("text_level", F.lit(0)) >= 1
    return kept.select("doc_id", "idx", F.coalesce("page_idx", F.lit(0)).alias("page"), F.when(title, "title").when(F.col("type") == "text", "paragraph").otherwise(F.col("type")).alias("type"), F.when(title, F.col("text_level")).alias("level"), F.when(title, F.left(text_of("text"), F.lit(200))).otherwise(text_of("text")).alias("text"), text_of("html").alias("html"))


def sections(items: DataFrame) -> DataFrame:
    """One row for each title: range of items, number, id, parent (the nearest title before it of a smaller level), pages.

    The parent is a window: of the last positions of each smaller level the greatest.
    """
    n = items.groupBy("doc_id").agg(F.max("idx").alias("last_idx"))
    t = items.where("type = 'title'").withColumn("level", F.coalesce("level", F.lit(1)))
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("idx")), ignorenulls=True).over(before) for k in range(1, LEVELS)}
    parent = reduce(lambda a, k: F.greatest(a, F.when(F.col("level") > k, last[k])), range(1, LEVELS), F.lit(None).cast("int"))
    t = t.withColumn("parent_idx", parent).withColumn("end_idx", F.lead("idx").over(doc_window()) - 1).hint("merge").join(n.hint("merge"), "doc_id")
    number = section_number("text")
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in ((1, "ch"), (2, "sec"), (3, "ss"), (4, "sss"), (5, "leaf"), (6, "node")) for x in kv]), F.least("level", F.lit(6)))
    base = F.concat(prefix, F.lit("_"), F.coalesce(F.replace(number, F.lit("."), F.lit("_")), F.col("idx").cast("string")))
    t = t.withColumn("number", number).withColumn("base", base)
    twin = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("idx"))
    return t.select("doc_id", F.col("idx").alias("start_idx"), F.coalesce("end_idx", "last_idx").alias("end_idx"), "parent_idx", "level", "number", F.col("text").alias("title"), F.when(twin > 1, F.concat("base", F.lit("_"), F.col("idx").cast("string"))).otherwise(F.col("base")).alias("section_id"), module_name("text").alias("module"), "page")


def place_items(items: DataFrame) -> DataFrame:
    """Items with the index of the title they stand under (null before the first): a forward fill."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("section_idx", F.last(F.when(F.col("type") == "title", F.col("idx")), ignorenulls=True).over(w))


def ancestors(tree: DataFrame) -> DataFrame:
    """(doc_id, start_idx, ancestor_idx, up) for every section and each section above it, itself included (up = 0)."""
    up = tree.select("doc_id", F.col("start_idx").alias("ancestor_idx"), F.col("parent_idx").alias("next"))
    level = tree.select("doc_id", "start_idx", F.col("start_idx").alias("ancestor_idx"))
    out = level.withColumn("up", F.lit(0))
    for k in range(1, LEVELS):
        level = level.join(up, ["doc_id", "ancestor_idx"]).where("next is not null").select("doc_id", "start_idx", F.col("next").alias("ancestor_idx"))
        out = out.unionByName(level.withColumn("up", F.lit(k)))
    return out


def breadcrumbs(tree: DataFrame) -> DataFrame:
    """(doc_id, start_idx, breadcrumb): titles from the root down, each cut at 60, at most 10."""
    titles = tree.select("doc_id", F.col("start_idx").alias("ancestor_idx"), "title")
    chain = ancestors(tree).join(titles, ["doc_id", "ancestor_idx"])
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("k"), F.left("title", F.lit(60)).alias("t"))))
    named = chain.where("up < 10").groupBy("doc_id", "start_idx").agg(F.transform(pairs, lambda x: x["t"]).alias("p"))
    return named.select("doc_id", "start_idx", F.array_join("p", " > ").alias("breadcrumb"))


def page_ranges(tree: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start_idx, first_page, last_page) over each section's whole subtree."""
    own = place_items(items).where("section_idx is not null").groupBy("doc_id", F.col("section_idx").alias("start_idx")).agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    return ancestors(tree).join(own, ["doc_id", "start_idx"]).groupBy("doc_id", F.col("ancestor_idx").alias("start_idx")).agg(F.min("lo").alias("first_page"), F.max("hi").alias("last_page"))


def context(items: DataFrame, before: int = 5, after: int = 5, width: int = 200, title: int = 100) -> DataFrame:
    """Items with the cut texts of their neighbours in order, joined by blanks; titles stand in brackets."""
    t = text_of("text")
    cut = F.when(F.col("type") == "title", F.concat(F.lit("["), F.left(t, F.lit(title)), F.lit("]"))).otherwise(F.left(t, F.lit(width)))
    w = doc_window()
    return items.withColumn("context_before", F.array_join(F.collect_list(cut).over(w.rowsBetween(-before, -1)), " ")).withColumn("context_after", F.array_join(F.collect_list(cut).over(w.rowsBetween(1, after)), " "))


# --- chunks ----------------------------------------------------------------------------------------------------------


def segment(items: DataFrame, level: int = 3) -> DataFrame:
    """Items with ``grp``, the index of the item that opens their group: titles down to ``level`` open one, a table is one of its own."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    opens = ((F.col("type") == "title") & (F.coalesce("level", F.lit(1)) <= level)) | (F.col("type") == "table") | (F.lag("type").over(w) == "table")
    return items.withColumn("grp", F.coalesce(F.last(F.when(opens, F.col("idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("idx").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def merge_small(groups: DataFrame, least: int = 40, most: int = 300, forced: int = 30) -> DataFrame:
    """(doc_id, ord, last, text, tokens, kind): groups of under ``least`` tokens join the one before, else the one after, if that has under ``most``.

    What is left under ``forced`` tokens joins the one before whatever its size. Tables (kind 'table') neither join nor are joined.
    Sequential by nature, hence grouped pandas; a group is one document's groups.
    """
    names = ["doc_id", "ord", "last", "text", "tokens", "kind"]

    def join(a: dict, b: dict) -> None:
        a["text"] = "\n".join(x for x in (a["text"], b["text"]) if x)
        a["tokens"] += b["tokens"]
        a["last"] = b["last"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, out = pdf.sort_values("ord").to_dict("records"), []
        k = 0
        while k < len(rows):
            r, after = rows[k], rows[k + 1] if k + 1 < len(rows) else None
            free = lambda x: x is not None and x["kind"] != "table" and x["tokens"] < most
            k += 1
            if r["kind"] != "table" and r["tokens"] < least and free(out[-1] if out else None):
                join(out[-1], r)
            elif r["kind"] != "table" and r["tokens"] < least and free(after):
                join(r, after)
                out.append(r)
                k += 1
            else:
                out.append(r)
        kept: list[dict] = []
        for r in out:
            if kept and r["kind"] != "table" and r["tokens"] < forced and kept[-1]["kind"] != "table":
                join(kept[-1], r)
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=names)

    kind = groups.schema["doc_id"].dataType.simpleString()
    given = {"last": F.col("ord"), "kind": F.lit("text")}
    rows = groups.withColumns({k: v for k, v in given.items() if k not in groups.columns})
    rows = rows.select("doc_id", F.col("ord").cast("long"), F.col("last").cast("long"), "text", F.col("tokens").cast("long"), "kind")
    return rows.groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, ord long, last long, text string, tokens long, kind string")


def split_long(chunks: DataFrame, most: int = 1500) -> DataFrame:
    """Chunks of more than ``most`` tokens are cut before level-2 headings, else at blank lines; pieces are packed greedily."""
    fits = estimate_tokens("text") <= most
    parts = F.split(F.col("text"), r"\n(?=## )|\n\n")
    empty = F.array().cast("array<string>")

    def pack(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(last, F.lit("\n\n"), part)
        return F.when(F.size(acc) > 0, F.when(estimate_tokens(joined) <= most, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.array_append(acc, part))).otherwise(F.array(part))

    pieces = F.when(fits, F.array("text")).otherwise(F.aggregate(parts, empty, pack))
    return chunks.select(*[c for c in chunks.columns if c != "text"], F.posexplode(pieces).alias("part", "text"))


def item_text(level: int = 3) -> Column:
    """An item's text in a chunk: headings with their marks, tables as lines of cells between bars."""
    rows = F.array_join(F.transform(html_rows("html"), lambda r: F.array_join(r, " | ")), "\n")
    mark = F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(1)), F.lit(level))), F.lit(" "), F.trim(text_of("text")))
    return F.when(F.col("type") == "title", mark).when(F.col("type") == "table", rows).otherwise(text_of("text"))


def chunk_groups(items: DataFrame) -> DataFrame:
    """(doc_id, ord, last, text, tokens, kind): the texts of ``segment``'s groups; a group of nothing but headings counts their text alone."""
    said = segment(items).withColumn("t", item_text()).where("type in ('title', 'paragraph', 'list', 'table') and trim(t) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), "\n")
    grouped = said.groupBy("doc_id", F.col("grp").alias("ord")).agg(F.max("idx").alias("last"), text.alias("text"), F.when(F.bool_or(F.col("type") == "table"), "table").otherwise("text").alias("kind"))
    return grouped.withColumn("tokens", estimate_tokens("text"))


def chunk_entities(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, ord, entities, signals, states): the ids of entities found between a chunk's first and last item, and the names of two kinds."""
    found = spans.select("doc_id", "ord", "last").join(entities, "doc_id").where("idx between ord and last")
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("entity_type") == kind, F.col("name"))))
    return found.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"), names("signal").alias("signals"), names("state").alias("states"))


def build_chunks(items: DataFrame, domain: Domain, entities: DataFrame | None = None) -> DataFrame:
    """Chunks of grouped items, with module, type, key terms, breadcrumb, entities, embedding text and ids.

    A group runs from one title to the next, a table stands alone, and small groups join their neighbours; a chunk belongs to the
    section of its first item. What stands before a document's first title, or in a document without titles, belongs to a
    root section of empty title, number and module. Without ``entities`` their columns are empty. A chunk_id is
    chunk_<module>_<number>:<doc_id>, of at least three digits; modules have no colon, so two documents never share one.
    """
    tree = sections(items)
    start = place_items(items).select("doc_id", F.col("idx").cast("long").alias("ord"), F.coalesce("section_idx", F.lit(-1)).alias("start_idx"))
    merged = merge_small(chunk_groups(items))
    joined = merged.join(start, ["doc_id", "ord"]).join(tree, ["doc_id", "start_idx"], "left").join(breadcrumbs(tree), ["doc_id", "start_idx"], "left")
    if entities is not None:
        joined = joined.join(chunk_entities(merged, entities), ["doc_id", "ord"], "left")
    none, no_names = F.lit(""), F.array().cast("array<string>")
    root = F.first("module", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("start_idx"))  # null for the root section
    lists = {c: F.coalesce(c, no_names) if entities is not None else no_names for c in ("entities", "signals", "states")}
    chunks = split_long(joined.withColumns({"module": F.coalesce(root, none), "title": F.coalesce("title", none), "breadcrumb": F.coalesce("breadcrumb", none), "has_table": F.col("kind") == "table", **lists}))
    kind = classify("title", "text", domain.chunk_types) if domain.chunk_types else F.lit("general_text")
    number = F.row_number().over(Window.partitionBy("doc_id", "module").orderBy("ord", "part"))
    return chunks.select(
        "doc_id", "module", F.coalesce("number", F.lit("")).alias("section_path"), F.col("title").alias("section_title"), "text", "has_table", "breadcrumb", kind.alias("chunk_type"),
        estimate_tokens("text").alias("token_count"), key_terms("text").alias("key_terms"), "entities", "signals", "states",
        F.concat(F.lit("chunk_"), "module", F.lit("_"), F.format_string("%03d", number), F.coalesce(F.concat(F.lit(":"), F.col("doc_id").cast("string")), none)).alias("chunk_id"),
        F.concat_ws("\n", F.concat(F.lit("["), "module", F.lit("] "), kind), F.nullif("breadcrumb", none), F.nullif(key_terms("text"), F.lit("")), F.left("text", F.when(F.col("has_table"), 2000).otherwise(3000))).alias("embedding_text"),
    )


def merge_sections(chunks: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Chunks of one key as one: texts joined by line breaks in order, lists united, flags or-ed, the first row's other columns."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), "text"))), lambda x: x["text"]), "\n")
    aggregates = [F.count(F.lit(1)).alias("n"), text.alias("text")]
    for c in chunks.columns:
        if c in ("entities", "signals", "states"):
            aggregates.append(united(c))
        elif c == "has_table":
            aggregates.append(F.bool_or(c).alias(c))
        elif c not in ("text", "n", *keys):
            aggregates.append(F.min_by(c, order).alias(c))
    return chunks.groupBy(*keys).agg(*aggregates)


def optimise_chunks(chunks: DataFrame) -> DataFrame:
    """Drop chunks of headings only, merge those of one section, drop stubs (under 30 signs once bars and headings are gone)."""
    order = F.struct(F.length("chunk_id").alias("n"), "chunk_id")  # numbers of more than three digits come last
    merged = merge_sections(chunks.where(~is_toc_only("text")), ["doc_id", "module", "section_path"], order)
    return merged.where(~is_stub("text")).withColumn("token_count", (F.length("text") / 3).cast("int"))


def chunk_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean and exact median of token counts, near-empty and undersized chunks."""
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("token_count").alias("mean_tokens"), F.median("token_count").alias("median_tokens"), F.count_if(F.col("token_count") < 50).alias("near_empty"), F.count_if(F.col("token_count") < 200).alias("undersized"), F.count_if(is_toc_only("text")).alias("toc_only"))


# --- tables ----------------------------------------------------------------------------------------------------------


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, idx, r, c, cell) of HTML tables."""
    rows = tables.select("doc_id", "idx", F.posexplode(html_rows("html")).alias("r", "cells"))
    return rows.select("doc_id", "idx", "r", F.posexplode("cells").alias("c", "cell"))


def classify_tables(tables: DataFrame, domain: Domain) -> DataFrame:
    """(doc_id, idx, html, table_class): a point for each header group that occurs in the first two rows; two are needed, first wins ties."""
    head = F.lower(F.array_join(F.flatten(F.slice(html_rows("html"), 1, 2)), " ␟ "))
    seen = lambda group: F.exists(F.array(*map(F.lit, group)), lambda word: F.contains(F.col("head_"), word)).cast("int")
    scores = [F.struct(reduce(lambda a, b: a + b, map(seen, groups)).alias("score"), F.lit(-n).alias("order"), F.lit(name).alias("name")) for n, (name, groups) in enumerate(domain.table_headers.items())]
    if not scores:
        return tables.select("doc_id", "idx", "html", F.lit("unknown").alias("table_class"))
    # the parsed head is a row of its own: as a mere column, a filter on the class would be pushed below it, and each keyword parse the table anew
    best = tables.select("doc_id", "idx", "html", F.explode(F.array(head)).alias("head_")).withColumn("best", F.array_max(F.array(*scores)))
    return best.select("doc_id", "idx", "html", F.when(F.col("best.score") >= 2, F.col("best.name")).otherwise("unknown").alias("table_class"))


def table_records(classified: DataFrame, domain: Domain) -> DataFrame:
    """(doc_id, idx, table_class, row_index, fields, raw_cells): cells under the field whose keyword is in their header.

    Each header takes the first free field. Empty, separator and nameless rows go (the name falls back to the first filled cell).
    """
    columns = domain.table_columns

    def assign(batches):
        for pdf in batches:
            out = []
            for kind, header in zip(pdf["table_class"], pdf["header"], strict=True):
                free, names = dict(columns.get(kind, {})), []
                for cell in header if header is not None else []:
                    field = next((f for f, words in free.items() if any(w in (cell or "").lower() for w in words)), None)
                    names.append(field)
                    free.pop(field, None)
                out.append(names)
            yield pdf.assign(names=out)[["doc_id", "idx", "table_class", "names", "rows"]]

    kind = classified.schema["doc_id"].dataType.simpleString()
    parsed = classified.where("table_class <> 'unknown'").select("doc_id", "idx", "table_class", html_rows("html").alias("rows"))
    base = parsed.select("doc_id", "idx", "table_class", F.try_element_at("rows", F.lit(1)).alias("header"), "rows")
    named = base.mapInPandas(assign, f"doc_id {kind}, idx int, table_class string, names array<string>, rows array<array<string>>")
    cells = named.select("doc_id", "idx", "table_class", "names", F.posexplode("rows").alias("row_index", "raw_cells")).where("row_index > 0")
    filled = F.exists("raw_cells", lambda x: (x != "") & ~x.rlike(r"^[-—:|\s]+$"))
    pairs = F.filter(F.zip_with("names", "raw_cells", lambda n, v: F.struct(n.alias("key"), F.coalesce(v, F.lit("")).alias("value"))), lambda p: p["key"].isNotNull())
    first = F.try_element_at(F.filter("raw_cells", lambda x: x != ""), F.lit(1))
    out = cells.where(filled).withColumn("fields", F.map_from_entries(pairs))
    return out.withColumn("name", F.coalesce(F.nullif(F.try_element_at("fields", F.lit("name")), F.lit("")), first)).where("name is not null").select("doc_id", "idx", "table_class", "row_index", "fields", "raw_cells", "name")


def split_transition(c: Column | str) -> Column:
    """struct(source, target) of 'A -> B'; nulls without an arrow."""
    parts = F.split(text_of(c), r"\s*(?:->|→|=>|>)\s*", 2)
    ok = F.size(parts) == 2
    return F.struct(F.when(ok, F.trim(parts[0])).alias("source"), F.when(ok, F.trim(F.try_element_at(parts, F.lit(2)))).alias("target"))


def table_rules(records: DataFrame, module: str = "") -> DataFrame:
    """(rule_id, module, rule_type, condition, action, confidence) from voltage, configuration, signal and fault tables.

    The module is that of the records, where they have one, else ``module``.
    """
    r = records if "module" in records.columns else records.withColumn("module", F.lit(module))
    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    rule = lambda kind, condition, action, sure: ["module", kind.alias("rule_type"), condition.alias("condition"), action.alias("action"), sure.alias("confidence")]
    volt = r.where("table_class = 'voltage_range'").withColumn("v", voltage_range(F.coalesce(F.nullif(f("range"), F.lit("")), f("voltage")))).where("v.low is not null")
    within = F.concat(F.lit("Voltage >= "), F.col("v.low").cast("string"), F.lit(" AND Voltage <= "), F.col("v.high").cast("string"))
    volt = volt.select(*rule(F.lit("voltage_range"), within, F.concat_ws("; ", F.nullif(f("status"), F.lit("")), F.nullif(f("function"), F.lit(""))), F.lit(0.92)))
    code = r.where("table_class in ('config_param', 'can_signal')").select("module", "table_class", "name", F.explode(coding_list(f("coding"))).alias("x"))
    config = F.col("table_class") == "config_param"
    code = code.select(*rule(F.when(config, "config").otherwise("signal_value"), F.concat("name", F.lit(" = "), "x.code"), F.col("x.meaning"), F.when(config, 0.90).otherwise(0.93)))
    fault = r.where("table_class = 'fault_diag'").select(*rule(F.lit("fault"), F.concat_ws(" AND ", "name", F.nullif(f("detection"), F.lit(""))), f("reaction"), F.when(f("recovery") != "", 0.88).otherwise(0.85)))
    rules = volt.unionByName(code).unionByName(fault)
    return first_by(rules.withColumn("rule_id", rule_id("module", "rule_type", F.concat("condition", F.lit("|"), "action"))), ["rule_id"], "condition")


# --- entities and relations ------------------------------------------------------------------------------------------


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first by ``order`` (an aggregate, so hot keys combine before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*df.columns)


def text_entities(items: DataFrame, domain: Domain) -> DataFrame:
    """(doc_id, entity_id, entity_type, name, idx): matches of every pattern; text with a fault word names a fault (cut at 80)."""

    def matches(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all(text_of("text"), F.lit(pattern), F.lit(1))
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("entity_type"), F.trim(x).alias("name")))

    found = [matches(kind, p) for kind, p in domain.entity_patterns.items()]
    fault = F.when(text_of("text").rlike(domain.fault_words), F.array(F.struct(F.lit("fault").alias("entity_type"), F.left(text_of("text"), F.lit(80)).alias("name")))).otherwise(F.array().cast("array<struct<entity_type:string,name:string>>"))
    rows = items.select("doc_id", "idx", F.explode(F.concat(*found, fault) if found else fault).alias("e")).select("doc_id", "idx", "e.*").where("name <> ''")
    rows = rows.withColumn("entity_id", F.concat("entity_type", F.lit("_"), safe_id("name")))
    # one name has one type: that of the first pattern which knows it
    rank = F.array_position(F.array(*[F.lit(k) for k in (*domain.entity_patterns, "fault")]), F.col("entity_type"))
    typed = rows.withColumn("k", F.struct(rank, F.col("idx"))).groupBy("doc_id", "name").agg(F.min_by(F.struct("entity_type", "entity_id"), "k").alias("r"), F.min("idx").alias("idx"))
    return typed.select("doc_id", "r.entity_id", "r.entity_type", "name", "idx")


def text_relations(placed: DataFrame, domain: Domain) -> DataFrame:
    """(doc_id, src, dst, rel, ord): matches of the relation patterns; a source or target of group 0 is the item's section."""
    section = F.concat(F.lit("section_"), F.coalesce("section_idx", F.lit(-1)).cast("string"))

    def pairs(rel: str, pattern: str, a: int, b: int) -> Column:
        group = lambda g: F.regexp_extract_all(text_of("text"), F.lit(pattern), F.lit(g))
        end = lambda g: group(g) if g else F.transform(group(0), lambda _: section)
        return F.zip_with(end(a), end(b), lambda x, y: F.struct(x.alias("src"), y.alias("dst"), F.lit(rel).alias("rel")))

    parts = [pairs(*p) for p in domain.relation_patterns]
    rows = placed.select("doc_id", F.col("idx").alias("ord"), F.explode(F.concat(*parts)).alias("e")).select("doc_id", "ord", "e.*").where("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("doc_id", "src", "dst", "rel").agg(F.min("ord").alias("ord"))


def title_entities(tree: DataFrame, domain: Domain) -> DataFrame:
    """(doc_id, entity_id, entity_type, name, idx) of titles: a module for each of level 1, the states and functions they name."""
    title, module = text_of("title"), F.col("module")
    states = [s for s in domain.state_names if s.isascii()]
    latin = F.regexp_extract_all(title, F.lit("(?i)\\b(" + "|".join(states or ["(?!)"]) + ")\\b"), F.lit(1))
    named = F.filter(F.regexp_extract_all(title, F.lit("([一-鿿]{2,8}?)(?:状态|模式)"), F.lit(1)), lambda x: F.length(x) >= 2)
    function = F.when(title.rlike("功能|控制|管理|保护|检测|诊断|(?i)function|control"), F.array(F.left(title, F.lit(60)))).otherwise(F.array().cast("array<string>"))
    one = lambda kind, names, key: F.transform(names, lambda x: F.struct(F.lit(kind).alias("entity_type"), key(x).alias("entity_id"), x.alias("name")))
    of_module = F.when((F.col("level") == 1) & (module != ""), F.array(module)).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        one("module", of_module, lambda x: F.concat(F.lit("module_"), x)),
        one("state", F.concat(latin, named), lambda x: F.concat(F.lit("state_"), module, F.lit("_"), x)),
        one("function", function, lambda x: F.concat(F.lit("func_"), module, F.lit("_"), slug(x))),
    )
    rows = tree.select("doc_id", F.col("start_idx").alias("idx"), F.explode(found).alias("e")).select("doc_id", "e.entity_id", "e.entity_type", "e.name", "idx")
    return first_by(rows, ["doc_id", "entity_id"], "idx")


def entity_type_of(name: Column | str, existing: Column, domain: Domain, functions: tuple[str, ...] = FUNCTION_WORDS, terminals: tuple[str, ...] = TERMINALS) -> Column:
    """The type a name is known by (``existing``, may be null), else guessed: parameter by prefix, state, function by keyword, 0x, terminal, identifier."""
    n = text_of(name)
    return (
        F.when(n == "", "signal")
        .when(existing.isNotNull(), existing)
        .when(n.rlike("^(?:Cfg|cfg|Cal|cal|NVM_|nvm_)"), "parameter")
        .when(F.lower(n).isin(*domain.state_names) if domain.state_names else F.lit(False), "state")
        .when(reduce(lambda a, w: a | F.contains(n, F.lit(w)), functions, F.lit(False)), "function")
        .when(F.startswith(n, F.lit("0x")), "can_message")
        .when(F.upper(n).isin(*terminals), "hardware_pin")
        .when(n.rlike("^[A-Z][A-Za-z0-9_]{3,}$"), "signal")
        .otherwise("function")
    )


def merge_entities(rows: DataFrame) -> DataFrame:
    """One entity for each (name, entity_type, module): the first row's id, all rows' properties, of which later ones win. Rows: ord, properties (map)."""
    keys = ["name", "entity_type", "module"]
    ids = rows.groupBy(*keys).agg(F.min_by("entity_id", "ord").alias("entity_id"))
    said = rows.select(*keys, "ord", F.explode("properties").alias("key", "value")).groupBy(*keys, "key").agg(F.max_by("value", "ord").alias("value"))
    held = said.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return ids.join(held, keys, "left").select(*keys, "entity_id", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))


def locate_entities(entities: DataFrame, placed: DataFrame, tree: DataFrame) -> DataFrame:
    """Entities with the module and section number they were found in ('' before the first title)."""
    at = placed.select("doc_id", "idx", F.col("section_idx").alias("start_idx"))
    where = tree.select("doc_id", "start_idx", "module", F.col("number").alias("section_path"))
    joined = entities.join(at, ["doc_id", "idx"], "left").join(where, ["doc_id", "start_idx"], "left")
    return joined.select(*entities.columns, text_of("module").alias("module"), text_of("section_path").alias("section_path"))


def belongs_to(entities: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges of weight 0.1 from each entity to the section it was found in."""
    return entities.join(placed.select("doc_id", "idx", "section_idx"), ["doc_id", "idx"]).where("section_idx is not null").select("doc_id", F.col("entity_id").alias("src"), F.concat(F.lit("section_"), F.col("section_idx").cast("string")).alias("dst"), F.lit("belongs_to").alias("rel"), F.lit(0.1).alias("weight"), F.col("idx").cast("long").alias("ord")).distinct()


def validate_machine(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """(module, kind, state): unreachable (never entered, not initial), deadlock (never left, not terminal) and unknown states."""
    s = states.select("module", F.col("name").alias("state"), "is_initial", "is_terminal")
    into, out = (transitions.select("module", F.col(c).alias("state")).distinct() for c in ("dst", "src"))
    return (
        s.where(~F.col("is_initial")).join(into, ["module", "state"], "left_anti").select("module", F.lit("unreachable").alias("kind"), "state")
        .unionByName(s.where(~F.col("is_terminal")).join(out, ["module", "state"], "left_anti").select("module", F.lit("deadlock").alias("kind"), "state"))
        .unionByName(into.unionByName(out).distinct().join(s, ["module", "state"], "left_anti").select("module", F.lit("unknown").alias("kind"), "state"))
    )
