"""From items to a graph: mentions, relations, and the resolution of every relation's ends to entity ids.

An entity is one (type, module, name) over all documents; its id says so: ``<type>_<module>_<name as an id>``. Modules are
``module_<name>``, sections belong to their document: ``section_<doc_id>_<number>``. A *link* is a relation whose ends are structs (id,
entity_type, name, module). An end that nothing mentions becomes an entity of its own (insert if absent), so no edge dangles.

Text without a section has module '' and the section 'root'. Documents have ids (``Engine.analyse`` gives '' to those without). Equal (src, dst, rel) are one edge, that of the
first place; an entity's place is its first mention, its properties are those of all its table rows, of which later ones win.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import html_rows, safe_id, text_of
from docloom.operators.etl import entity_type_of, place_items, split_transition
from docloom.plans import patterns
from docloom.plans.domain import Domain

NO_PROPERTIES = "map<string,string>"


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def entity_key(kind: Column | str, module: Column | str, name: Column | str) -> Column:
    """The id of a named entity."""
    return F.concat(text_of(kind), F.lit("_"), text_of(module), F.lit("_"), safe_id(name, 80))


def _end(kind: Column | str, name: Column | str, module: Column | str) -> Column:
    return F.struct(entity_key(kind, module, name).alias("id"), text_of(kind).alias("entity_type"), text_of(name).alias("name"), text_of(module).alias("module"))


def section_end(number: Column | str, module: Column | str = "module") -> Column:
    """The entity of a section of the row's document; without a number it is the document's root."""
    n = F.coalesce(F.nullif(text_of(number), F.lit("")), F.lit("root"))
    return F.struct(F.concat(F.lit("section_"), _doc(), F.lit("_"), F.replace(n, F.lit("."), F.lit("_"))).alias("id"), F.lit("module").alias("entity_type"), F.concat(F.lit("Section "), n).alias("name"), text_of(module).alias("module"))


def module_end(module: Column | str) -> Column:
    """The entity of a module; text of no module belongs to its document's root."""
    m = text_of(module)
    root = section_end(F.lit(""), F.lit(""))
    return F.when(m == "", root).otherwise(F.struct(F.concat(F.lit("module_"), m).alias("id"), F.lit("module").alias("entity_type"), m.alias("name"), m.alias("module")))


def located(items: DataFrame, tree: DataFrame) -> DataFrame:
    """Items, dealt out by document, with their section: section_idx, section_path (its number), section_title, parent_title and module (its own, else its parent's)."""
    up = tree.select("doc_id", F.col("start_idx").alias("parent_idx"), F.col("title").alias("parent_title"), F.col("module").alias("above"))
    own = F.coalesce(F.nullif(text_of("module"), F.lit("")), text_of("above"))
    at = tree.join(up.hint("merge"), ["doc_id", "parent_idx"], "left").select("doc_id", F.col("start_idx").alias("section_idx"), text_of("number").alias("section_path"), F.col("title").alias("section_title"), "parent_title", own.alias("module"))
    joined = place_items(items).join(at.hint("merge"), ["doc_id", "section_idx"], "left")
    return joined.withColumns({c: text_of(c) for c in ("section_path", "section_title", "parent_title", "module")})


# --- mentions --------------------------------------------------------------------------------------------------------


def _named(kind: str, rank: int, names: Column) -> Column:
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("entity_type"), F.lit(rank).alias("rank"), F.trim(x).alias("name")))


def _may_hold(text: Column, pattern: str) -> Column:
    """Whether a text holds a word without which the pattern can't be found in it; true for a pattern of which no such words are known."""
    cues = patterns.CUES.get(pattern)
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), cues, F.lit(False)) if cues else F.lit(True)


def _cued(rows: DataFrame, text: Column, sought: Sequence[str]) -> DataFrame:
    """Rows with their text (``told``) and what of it may hold each pattern: columns of their own, as lambdas and what stands around them are interpreted, not compiled."""
    return rows.withColumn("told", text).withColumns({f"may_{n}": _may_hold(F.col("told"), p) for n, p in enumerate(sought)})


def _matches(found: Sequence[tuple]) -> list[Column]:
    """What each pattern finds in rows that are ``_cued`` for them."""

    def one(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        names = F.when(F.col(f"may_{rank}"), F.regexp_extract_all("told", F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
        return _named(kind, rank, F.filter(names, lambda x: (F.length(x) >= least) & ~x.isin(*patterns.NO_SIGNALS)))

    return [one(rank, *p) for rank, p in enumerate(found)]


def _mentions(rows: DataFrame, found: Column) -> DataFrame:
    told = rows.select("doc_id", "idx", "module", "section_path", F.explode(found).alias("e")).select("doc_id", "idx", "module", "section_path", "e.*")
    told = told.where("name <> ''").withColumn("entity_id", F.when((F.col("entity_type") == "module"), F.concat(F.lit("module_"), "name")).otherwise(entity_key("entity_type", "module", "name")))
    return told.dropDuplicates(["doc_id", "idx", "entity_id"]).withColumn("properties", F.create_map().cast(NO_PROPERTIES))


def mentions(items: DataFrame, domain: Domain, found: Sequence[tuple] = patterns.MENTIONS) -> DataFrame:
    """(doc_id, idx, module, section_path, entity_type, rank, name, entity_id, properties) of ``located`` items.

    Paragraphs and lists: all patterns, and their own beginning (80 signs) as a fault if they hold a fault word. Tables: signals and CAN
    messages in their cells. Titles: the module of level 1, states, the title itself (60 signs) as a function if it says so, and
    functions with Latin letters.
    """
    text, last = text_of("text"), len(found)
    nothing = F.array().cast("array<struct<entity_type:string,rank:int,name:string>>")
    fault = F.when(text.rlike(domain.fault_words), _named("fault", last, F.array(F.left(text, F.lit(80))))).otherwise(nothing)
    of = lambda *kinds: [p for p in found if p[0] in kinds]
    cued = lambda kind, text, sought: _cued(items.where(kind), text, [p[1] for p in sought])
    prose = _mentions(cued("type in ('paragraph', 'list')", text, found), F.concat(*_matches(found), fault))
    cells = of("signal", "can_message")
    tables = _mentions(cued("type = 'table'", text_of(F.array_join(F.flatten(html_rows("html")), " ")), cells), F.concat(*_matches(cells)))
    some = lambda test, names: F.when(test, names).otherwise(F.array().cast("array<string>"))
    states = _matches(of("state"))
    latin = F.filter(F.regexp_extract_all(text, F.lit(patterns.FUNCTION_TEXT), F.lit(0)), lambda x: x.rlike(r"[\x00-\x7f]"))
    titles = F.concat(
        _named("module", 0, some((F.coalesce("level", F.lit(1)) == 1) & (F.col("module") != ""), F.array("module"))), *states,
        _named("function", last, some(text.rlike(patterns.FUNCTION_TITLE), F.array(F.left(text, F.lit(60))))), _named("function", last, latin),
    )
    return prose.unionByName(tables).unionByName(_mentions(cued("type = 'title'", text, of("state")), titles))


def record_mentions(records: DataFrame) -> DataFrame:
    """The entity that each table record with a name field is about, with its fields as properties. Records: ``located`` ones."""
    name = F.coalesce(F.try_element_at("fields", F.lit("name")), F.lit(""))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in patterns.RECORD_TYPES.items() for x in kv]), F.col("table_class"))
    extra = F.map_from_arrays(F.array(F.lit("table_class"), F.lit("row")), F.array("table_class", F.col("row_index").cast("string")))
    rows = records.where(F.trim(name) != "").select("doc_id", "idx", "module", "section_path", kind.alias("entity_type"), F.lit(0).alias("rank"), name.alias("name"), F.map_concat(F.map_filter("fields", lambda k, _: ~k.isin("table_class", "row")), extra).alias("properties"))
    return rows.withColumn("entity_id", entity_key("entity_type", "module", "name"))


# --- links -----------------------------------------------------------------------------------------------------------


def text_links(items: DataFrame, said: DataFrame, domain: Domain, relations: Sequence[tuple] = patterns.RELATIONS) -> DataFrame:
    """(doc_id, idx, rel, weight, properties, nth, section_path, src, dst) of paragraphs and lists (``located`` ones), by all patterns.

    A name without a stated type has the type under which its item mentions it (``said``), else the one it looks like.
    """
    text = F.col("told")
    title, parent = F.col("section_title"), F.col("parent_title")
    first = lambda c, p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    function = F.coalesce(first(title, patterns.FUNCTION_TEXT), F.when(title.rlike(patterns.FUNCTION_TITLE), F.left(title, F.lit(30))), F.lit(""))
    of_section = {"state": F.coalesce(first(title, patterns.STATE), first(parent, patterns.STATE), F.lit("")), "function": function, "module": F.col("module"), "section": F.col("section_path")}

    def ends(what: str, group: int, kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        give = lambda k, name, module: F.struct(F.lit(k or None).cast("string").alias("kind"), name.alias("name"), module.alias("module"))
        if what == "foreign":
            return F.zip_with(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(group - 1)), lambda x, m: give(kind, x, m))
        if what in of_section:
            return F.transform(hits, lambda _: give(what, of_section[what], F.col("module")))
        return F.transform(hits, lambda x: give("section" if what == "number" else kind, x, F.col("module")))

    def pairs(nth: int, rel: str, pattern: str, src: tuple, dst: tuple) -> Column:
        found = F.zip_with(ends(*src, pattern), ends(*dst, pattern), lambda a, b: F.struct(F.lit(rel).alias("rel"), F.lit(nth).alias("nth"), a.alias("a"), b.alias("b")))
        return F.when(F.col(f"may_{nth}") & text.rlike(pattern), found)  # most texts hold few of the patterns: one look each, not one a group

    parts = [pairs(nth, *r) for nth, r in enumerate(relations)]
    cued = _cued(items.where("type in ('paragraph', 'list')"), text_of("text"), [r[1] for r in relations])
    rows = cued.select("doc_id", "idx", "module", "section_path", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("e"))
    rows = rows.select("doc_id", "idx", "module", "section_path", "e.rel", "e.nth", "e.a", "e.b")
    whole = lambda c: (F.col(f"{c}.name") != "") | F.col(f"{c}.kind").isin("module", "section")  # noqa: E731  what has no name can't be an end
    rows = rows.where(whole("a") & whole("b"))
    known = said.groupBy("doc_id", "idx", "name").agg(F.min_by("entity_type", "rank").alias("known"))
    for side in "ab":
        own = known.select("doc_id", "idx", F.col("name").alias(f"{side}_name"), F.col("known").alias(f"{side}_known"))
        # what the name alone tells is found before the join: with all of both ends in one step, that step's code is too long for the JVM to compile
        name, unknown = F.col(f"{side}.name"), F.lit(None).cast("string")
        rows = rows.withColumns({f"{side}_name": name, f"{side}_safe": safe_id(name, 80), f"{side}_like": entity_type_of(name, unknown, domain)})
        rows = rows.join(own.hint("merge"), ["doc_id", "idx", f"{side}_name"], "left")
        rows = rows.withColumn(f"{side}_type", F.coalesce(F.col(f"{side}.kind"), F.when(F.col(f"{side}_name") != "", F.col(f"{side}_known")), F.col(f"{side}_like")))

    def resolved(side: str) -> Column:
        kind, name, module = (F.col(f"{side}.{c}") for c in ("kind", "name", "module"))
        key = F.concat(f"{side}_type", F.lit("_"), text_of(module), F.lit("_"), f"{side}_safe")
        typed = F.struct(key.alias("id"), F.col(f"{side}_type").alias("entity_type"), text_of(name).alias("name"), text_of(module).alias("module"))
        return F.when(kind == "section", section_end(name)).when(kind == "module", module_end(name)).otherwise(typed)

    return rows.select("doc_id", "idx", "rel", F.lit(1.0).alias("weight"), F.create_map().cast(NO_PROPERTIES).alias("properties"), "nth", "section_path", resolved("a").alias("src"), resolved("b").alias("dst"))


def split_moves(records: DataFrame) -> DataFrame:
    """Records of transition tables whose one column says 'source -> target' with both as fields; others as they are."""
    f = lambda k: F.trim(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")))
    whole = F.coalesce(F.nullif(f("transition_text"), F.lit("")), f("source_state"))
    cut = split_transition(whole)
    both = (F.col("table_class") == "transition") & (cut["source"] != "") & (cut["target"] != "")
    source = F.when((f("source_state") == "") | (f("source_state") == whole), cut["source"]).otherwise(f("source_state"))
    kept = F.map_filter("fields", lambda k, _: ~k.isin("source_state", "target_state", "transition_text"))
    new = F.map_from_arrays(F.array(*map(F.lit, ("source_state", "target_state", "transition_text"))), F.array(source, cut["target"], whole))
    return records.withColumn("fields", F.when(both, F.map_concat(kept, new)).otherwise(F.col("fields")))


def table_links(records: DataFrame) -> DataFrame:
    """Links of table records (``located`` ones, moves split), each class by its own rules; columns as ``text_links``.

    Signals: outputs to their pin, controls of their type (0.8). States: references to the next row's, depends_on their power mode. Moves:
    transition_to (0.8) and triggered_by the trigger's signals; a trigger alone belongs to an unknown state, and to a move from the section's
    state to the one it (or else the table's first trigger that tells one) enters (0.6). Pins: controls of their function, references to
    their driver. Faults: reports of what detects them, depends_on their recovery. Parameters: configures the functions in their text.
    """
    f = lambda k: F.trim(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")))
    by_table = Window.partitionBy("doc_id", "idx").orderBy("row_index")
    entered = F.nullif(F.regexp_extract(f("trigger"), patterns.ENTERED, 1), F.lit(""))
    peer = F.first(F.nullif(F.regexp_extract(f("trigger"), patterns.ENTERED_BY_PEER, 1), F.lit("")), ignorenulls=True).over(by_table.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    home = F.nullif(F.regexp_extract("section_title", patterns.SECTION_STATE, 1), F.lit(""))
    r = records.withColumns({"name_": f("name"), "next_": F.lead(f("name")).over(Window.partitionBy("doc_id", "idx", f("name") != "").orderBy("row_index")), "peer": peer, "home": home, "entered": entered})
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in patterns.RECORD_TYPES.items() for x in kv]), F.col("table_class"))
    end = lambda k, name: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), name.alias("name"))
    own = end(kind, F.col("name_"))
    state = lambda c: end("state", c)
    nothing = F.array().cast("array<struct<rel:string,weight:double,about:string,note:string,nth:int,a:struct<kind:string,name:string>,b:struct<kind:string,name:string>>>")

    def link(kinds: str, test: Column, rel: str, weight: float, nth: int, src: Column, dst_kind: str, dst: Column, note: str | Column = "") -> Column:
        """An array of links: one to ``dst``, or one to each name of it if it is an array."""
        about, said = (F.lit("relation"), F.lit(note)) if isinstance(note, str) else (F.lit("trigger"), note)
        to = lambda x: F.struct(F.lit(rel).alias("rel"), F.lit(weight).alias("weight"), about.alias("about"), said.alias("note"), F.lit(nth).alias("nth"), src.alias("a"), end(dst_kind, x).alias("b"))
        return F.when((F.col("table_class") == kinds) & test, F.transform(dst, lambda x: to(x))).otherwise(nothing)

    one = lambda c: F.array(c)
    named = F.col("name_") != ""
    long = lambda k: named & (F.length(f(k)) >= 2)
    source, target, trigger = f("source_state"), f("target_state"), f("trigger")
    move = (source != "") & (target != "")
    alone = (source == "") & (target == "") & (trigger != "")
    signals = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(patterns.SIGNAL), F.lit(1)))
    unknown = state(F.lit("unknown"))
    functions = F.array_distinct(F.regexp_extract_all(F.concat(f("description"), F.lit(" "), f("comments")), F.lit(patterns.FUNCTION_TEXT), F.lit(0)))
    guess = F.coalesce("entered", F.when(F.col("peer") != F.col("home"), F.col("peer")))
    made = [
        link("signal_def", long("pin"), "outputs", 0.8, 0, own, "hardware_pin", one(f("pin")), "assigned_to_pin"),
        link("signal_def", named & (f("signal_type") != ""), "controls", 0.8, 1, own, "signal", one(f("signal_type")), "signal_type"),
        link("state_machine", named & F.col("next_").isNotNull(), "references", 1.0, 0, own, "state", one(F.col("next_")), "next_in_table"),
        link("state_machine", long("power_mode"), "depends_on", 1.0, 1, own, "state", one(f("power_mode")), "power_mode"),
        link("transition", move, "transition_to", 0.8, 0, state(source), "state", one(target), F.left(trigger, F.lit(200))),
        link("transition", move, "triggered_by", 1.0, 1, state(target), "signal", signals(trigger)),
        link("transition", alone, "triggered_by", 1.0, 1, unknown, "signal", signals(trigger)),
        link("transition", alone & F.col("home").isNotNull() & guess.isNotNull(), "transition_to", 0.6, 2, state(F.col("home")), "state", one(guess), F.left(trigger, F.lit(120))),
        link("transition", (source != "") & (target == ""), "triggered_by", 1.0, 1, unknown, "signal", signals(F.concat(source, F.lit(" "), trigger))),
        link("output_pin", long("function"), "controls", 1.0, 0, own, "function", one(f("function")), "pin_controls_function"),
        link("output_pin", named & f("signal_type").isin(*patterns.DRIVERS), "references", 1.0, 1, own, "signal", one(f("signal_type")), "driver_type"),
        link("fault_diag", named & (f("detection") != ""), "reports", 1.0, 0, own, "signal", one(f("detection")), "detection_condition"),
        link("fault_diag", named & (f("recovery") != ""), "depends_on", 1.0, 1, own, "function", one(f("recovery")), "recovery_action"),
        link("config_param", named, "configures", 1.0, 0, own, "function", functions, "configures_function"),
    ]
    rows = r.select("doc_id", "idx", "row_index", "module", "section_path", F.explode(F.concat(*made)).alias("e"))
    about = F.when(F.col("e.note") != "", F.create_map(F.col("e.about"), F.col("e.note"))).otherwise(F.create_map().cast(NO_PROPERTIES))
    ends = (_end(F.col(f"e.{x}.kind"), F.col(f"e.{x}.name"), "module").alias(y) for x, y in (("a", "src"), ("b", "dst")))
    return rows.select("doc_id", "idx", "e.rel", "e.weight", about.alias("properties"), (F.col("row_index") * 100 + F.col("e.nth")).alias("nth"), "section_path", *ends)


def section_links(said: DataFrame) -> DataFrame:
    """belongs_to links (0.1) from what is mentioned to the numbered section it stands in."""
    src = F.struct(F.col("entity_id").alias("id"), "entity_type", "name", "module")
    return said.where("section_path <> ''").select("doc_id", "idx", F.lit("belongs_to").alias("rel"), F.lit(0.1).alias("weight"), F.create_map().cast(NO_PROPERTIES).alias("properties"), F.lit(1000).alias("nth"), "section_path", src.alias("src"), section_end("section_path").alias("dst"))


# --- resolution ------------------------------------------------------------------------------------------------------


def entities_of(said: DataFrame, links: DataFrame) -> DataFrame:
    """(entity_id, entity_type, name, module, section_path, doc_id, idx, properties): each id once, mentioned or only an end of a link.

    Everything is an aggregate on the id, so an entity that all documents mention is combined before the shuffle.
    """
    place = ["entity_type", "name", "module", "section_path", "doc_id", "idx"]
    known = said.select("entity_id", *place, F.lit(0).alias("late"), "properties")
    ends = links.select(F.explode(F.array("src", "dst")).alias("e"), "section_path", "doc_id", "idx")
    added = ends.select(F.col("e.id").alias("entity_id"), "e.entity_type", "e.name", "e.module", "section_path", "doc_id", "idx", F.lit(1).alias("late"), F.create_map().cast(NO_PROPERTIES).alias("properties"))
    both = known.unionByName(added)
    first = both.groupBy("entity_id").agg(F.min_by(F.struct(*place), F.struct("late", "doc_id", "idx")).alias("r")).select("entity_id", "r.*")
    told = known.select("entity_id", F.struct("doc_id", "idx").alias("at"), F.explode("properties").alias("key", "value")).groupBy("entity_id", "key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    held = told.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return first.hint("merge").join(held.hint("merge"), "entity_id", "left").withColumn("properties", F.coalesce("properties", F.create_map().cast(NO_PROPERTIES)))


def edges_of(links: DataFrame) -> DataFrame:
    """(src, dst, rel, weight, ord, properties, doc_id): each (src, dst, rel) once, as its first place says; loops are left out."""
    keyed = links.select(F.col("src.id").alias("src"), F.col("dst.id").alias("dst"), "rel", "weight", "properties", "doc_id", "idx", "nth").where("src <> dst")
    first = F.min_by(F.struct("weight", F.col("idx").cast("long").alias("ord"), "properties", "doc_id"), F.struct("doc_id", "idx", "nth"))
    return keyed.groupBy("src", "dst", "rel").agg(first.alias("r")).select("src", "dst", "rel", "r.*")


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(node): ends of edges that are no entity; none where ``entities_of`` made the entities."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.hint("merge").join(entities.select(F.col("entity_id").alias("node")).hint("merge"), "node", "left_anti")
