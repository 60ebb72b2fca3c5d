"""Reasoning over rules and state machines: typed impact, condition trees, paths with guards, summaries, and evidence selection.

Rules: rule_id, module, condition, action, preconditions (array), target_state, action_signals (array). Transitions: src, dst,
guard, module, ord. Names match as the text operators do, by lower-cased substring; the side of names is a vocabulary (states,
signals, asked terms), which is small beside the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import signals, text_of
from docloom.operators.matching import contains_join
from docloom.sources.storage import stored


def _known(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def impact_edges(transitions: DataFrame, rules: DataFrame) -> DataFrame:
    """(src_type, src, dst_type, dst, via): what follows from what.

    state -> state by a transition; state -> rule that has it among its preconditions; signal -> rule that names it, and that rule's
    target state; rule -> its target state and the signals of its action.
    """
    states = transitions.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    named = rules.select(F.explode(_known("action_signals")).alias("name")).where("name <> ''").distinct()
    edge = lambda a, src, b, dst, via: [F.lit(a).alias("src_type"), src.alias("src"), F.lit(b).alias("dst_type"), dst.alias("dst"), via.alias("via")]
    rule, target = F.col("rule_id").cast("string"), F.col("target_state")
    moves = transitions.select(*edge("state", F.col("src"), "state", F.col("dst"), F.concat(F.lit("transition: "), F.left(text_of("guard"), F.lit(60)))))
    guarded = contains_join(rules.select("rule_id", F.explode(_known("preconditions")).alias("said")), "said", states, "name")
    guards = guarded.select(*edge("state", F.col("name"), "rule", rule, F.concat(F.lit("guarded by "), "name")))
    using = contains_join(rules, F.concat_ws(" ", "condition", "action"), named, "name")
    uses = using.select(*edge("signal", F.col("name"), "rule", rule, F.concat(F.lit("signal "), "name")))
    through = using.where(text_of("target_state") != "").select(*edge("signal", F.col("name"), "state", target, F.concat(F.lit("rule "), rule)))
    enters = rules.where(text_of("target_state") != "").select(*edge("rule", rule, "state", target, F.concat(F.lit("rule "), rule)))
    acts = rules.select("rule_id", F.explode(_known("action_signals")).alias("name")).where("name <> ''").select(*edge("rule", rule, "signal", F.col("name"), F.concat(F.lit("rule "), rule)))
    return moves.unionByName(guards).unionByName(uses).unionByName(through).unionByName(enters).unionByName(acts).distinct()


def forward_chain(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """(seed, node_type, node, depth, via): all that a seed (seed, seed_type) affects, at its least depth; via is the smallest reason there."""
    # written once: each depth would make the edges anew
    e = stored(edges.select(F.col("src_type").alias("node_type"), F.col("src").alias("node"), "dst_type", "dst", "via"))
    front = seeds.select("seed", F.col("seed_type").alias("node_type"), F.col("seed").alias("node")).distinct()
    seen = front
    out = None
    for depth in range(1, max_depth + 1):
        step = front.hint("merge").join(e.hint("merge"), ["node_type", "node"]).groupBy("seed", F.col("dst_type").alias("node_type"), F.col("dst").alias("node")).agg(F.min("via").alias("via"))
        found = stored(step.join(seen.hint("merge"), ["seed", "node_type", "node"], "left_anti"))
        front = found.select("seed", "node_type", "node")
        seen = seen.unionByName(front)
        rows = found.select("seed", "node_type", "node", F.lit(depth).alias("depth"), "via")
        out = rows if out is None else out.unionByName(rows)
    return out


def impact_report(impacted: DataFrame, rules: DataFrame) -> DataFrame:
    """(seed, total_impacted, total_depth, modules) of a forward chain; a node's module is that of its rule, or of the first rule that names it."""
    names = impacted.select("node").distinct()
    of_rule = names.join(rules.select(F.col("rule_id").cast("string").alias("node"), "module").hint("merge"), "node")
    others = names.join(of_rule.hint("merge"), "node", "left_anti")
    placed = of_rule.unionByName(first_rule_module(others.withColumnRenamed("node", "name"), rules).withColumnRenamed("name", "node"))
    joined = impacted.join(placed.hint("merge"), "node", "left")
    return joined.groupBy("seed").agg(F.count_distinct("node_type", "node").alias("total_impacted"), F.max("depth").alias("total_depth"), F.array_sort(F.collect_set("module")).alias("modules"))


def first_rule_module(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, module): the module of the first rule (by id) whose text holds the name; Unknown without one."""
    said = F.lower(F.concat_ws(" ", F.col("rule_id").cast("string"), "condition", "action", "target_state", F.array_join(_known("preconditions"), " ")))
    hits = contains_join(rules.select("rule_id", "module", said.alias("said")), "said", names, "name")
    first = hits.groupBy("name").agg(F.min_by("module", "rule_id").alias("module"))
    return names.join(first, "name", "left").select("name", F.coalesce("module", F.lit("Unknown")).alias("module"))


def condition_tree(transitions: DataFrame, goals: DataFrame, depth: int = 5) -> DataFrame:
    """(goal, path, level, kind, branches, guard, signals): what is needed to reach each goal, as rows of an AND/OR tree.

    A state with incoming transitions is an OR of them (one is an AND alone); each is an AND of its guard's signals and its source
    state. A state on its own path, at the depth limit or without incoming transitions is a LEAF. ``path`` runs from the
    goal back to the state; guard and signals are those of the step that led there.
    """
    e = transitions.where("src <> dst").select(F.col("dst").alias("state"), "src", "guard").distinct()
    incoming = e.groupBy("state").agg(F.count(F.lit(1)).alias("branches"))
    none = F.lit(None).cast("string")
    level = goals.select("goal", F.col("goal").alias("state"), F.array("goal").alias("path"), none.alias("guard"), F.lit(False).alias("cycle"))
    out = None
    for d in range(depth + 1):
        rows = level.join(incoming, "state", "left").withColumn("leaf", F.col("cycle") | F.col("branches").isNull() | F.lit(d == depth))
        rows = stored(rows)
        told = rows.select("goal", "path", F.lit(d).alias("level"), F.when(F.col("leaf"), "LEAF").when(F.col("branches") > 1, "OR").otherwise("AND").alias("kind"), F.when(F.col("leaf"), 0).otherwise(F.col("branches")).cast("long").alias("branches"), "guard", signals("guard").alias("signals"))
        out = told if out is None else out.unionByName(told)
        open_ = rows.where(~F.col("leaf")).select("goal", "state", "path")
        level = open_.join(e, "state").select("goal", F.col("src").alias("state"), F.array_append("path", F.col("src")).alias("path"), "guard", F.array_contains("path", F.col("src")).alias("cycle"))
    return out


def path_guards(paths: DataFrame, transitions: DataFrame) -> DataFrame:
    """(start, goal, path, hops, guards, signals): each step's guard in order ('' where it has none), and all guards' distinct signals."""
    steps = paths.select("start", "goal", "path", "hops", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("nth", "src")).withColumn("dst", F.element_at("path", F.col("nth") + 2))
    first = transitions.groupBy("src", "dst").agg(F.min_by(text_of("guard"), "ord").alias("guard"))
    told = steps.join(first, ["src", "dst"], "left").withColumn("guard", text_of("guard"))
    rows = told.groupBy("start", "goal", "path", "hops").agg(F.array_sort(F.collect_list(F.struct("nth", "guard"))).alias("g"))
    guards = F.transform("g", lambda x: x["guard"])
    return rows.select("start", "goal", "path", "hops", guards.alias("guards"), F.array_sort(F.array_distinct(F.flatten(F.transform(guards, lambda g: signals(g))))).alias("signals"))


def impact_summary(terms: DataFrame, rules: DataFrame, transitions: DataFrame, n_signals: int = 8, per_module: int = 3) -> DataFrame:
    """(term, rules, modules, signals, transitions): rules that mention a term, their modules, their actions' signals, guards that name it."""
    said = F.lower(F.concat_ws(" ", "condition", "action", "target_state", F.array_join(_known("preconditions"), " ")))
    hits = contains_join(rules, said, terms, "term")
    found = F.regexp_extract_all(text_of("action"), F.lit("[A-Z][A-Za-z0-9_]{3,}"), F.lit(0))
    by_rule = hits.groupBy("term").agg(F.count_distinct("rule_id").alias("rules"), F.array_sort(F.collect_set("module")).alias("modules"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(found)))), 1, n_signals).alias("signals"))
    moves = contains_join(transitions, "guard", terms, "term")
    nth = F.row_number().over(Window.partitionBy("term", "module").orderBy("ord"))
    kept = moves.withColumn("k", nth).where(F.col("k") <= per_module)
    by_move = kept.groupBy("term").agg(F.array_sort(F.collect_list(F.concat("src", F.lit("->"), "dst"))).alias("transitions"))
    return terms.join(by_rule, "term", "left").join(by_move, "term", "left").select("term", F.coalesce("rules", F.lit(0)).alias("rules"), _known("modules").alias("modules"), _known("signals").alias("signals"), _known("transitions").alias("transitions"))


def state_moves(transitions: DataFrame, states: DataFrame) -> DataFrame:
    """(state, direction, other, guard): transitions into and out of each stated state; two equi-joins."""
    into = states.join(transitions, states["state"] == transitions["dst"]).select("state", F.lit("incoming").alias("direction"), F.col("src").alias("other"), "guard")
    out = states.join(transitions, states["state"] == transitions["src"]).select("state", F.lit("outgoing").alias("direction"), F.col("dst").alias("other"), "guard")
    return into.unionByName(out)


def evidence_transitions(hits: DataFrame, transitions: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, src, dst, guard, n): transitions that touch a query's states (query_id, state), each (src, dst) once, the first ``limit``."""
    touched = hits.join(transitions, hits["state"] == transitions["src"]).unionByName(hits.join(transitions, hits["state"] == transitions["dst"]))
    once = touched.groupBy("query_id", "src", "dst").agg(F.min_by("guard", "ord").alias("guard"), F.min("ord").alias("ord"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "src", "dst"))
    return once.withColumn("n", nth).where(F.col("n") <= limit).select("query_id", "src", "dst", "guard", "n")


def both_machines(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """(query_id, start, goal): asked pairs whose states both exist; two semi-joins."""
    known = transitions.select(F.explode(F.array("src", "dst")).alias("state")).distinct()
    return states.join(known.withColumnRenamed("state", "start"), "start", "left_semi").join(known.withColumnRenamed("state", "goal"), "goal", "left_semi").select("query_id", "start", "goal")


def signal_modules(asked: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, modules): modules of the entities a query's signals (query_id, signal) name, and of their neighbours, sorted."""
    found = asked.join(entities, F.lower("signal") == F.lower("name")).select("query_id", "entity_id", "module")
    ends = edges.select(F.col("src").alias("entity_id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("entity_id"), F.col("src").alias("other"))).distinct()
    near = found.select("query_id", "entity_id").join(ends, "entity_id").join(entities.select(F.col("entity_id").alias("other"), "module"), "other").select("query_id", "module")
    both = found.select("query_id", "module").unionByName(near).where(text_of("module") != "")
    return both.groupBy("query_id").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def cross_module(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_module, dst_module, rels, n): relations between entities of different modules."""
    side = lambda c: entities.select(F.col("entity_id").alias(c), F.col("module").alias(f"{c}_module"))
    joined = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_module <> dst_module")
    return joined.groupBy("src_module", "dst_module").agg(F.array_sort(F.collect_set("rel")).alias("rels"), F.count(F.lit(1)).alias("n"))


def entity_context(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, out_nodes, in_nodes, rels): distinct neighbours on both sides of each seed, sorted; a seed without any has empty lists."""
    out = seeds.join(edges, seeds["seed"] == edges["src"]).select("seed", F.col("dst").alias("o"), F.lit(None).cast("string").alias("i"), "rel")
    into = seeds.join(edges, seeds["seed"] == edges["dst"]).select("seed", F.lit(None).cast("string").alias("o"), F.col("src").alias("i"), "rel")
    lists = out.unionByName(into).groupBy("seed").agg(*(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("o", "out_nodes"), ("i", "in_nodes"), ("rel", "rels"))))
    return seeds.join(lists, "seed", "left").select("seed", *(_known(c).alias(c) for c in ("out_nodes", "in_nodes", "rels")))


def capped_entities(terms: DataFrame, entities: DataFrame, exact: int = 3, partial: int = 5) -> DataFrame:
    """(query_id, term, entity_id, entity_type, tier): of the entities that a term names, the first of each type: ``exact`` equal names, ``partial`` others."""
    hit = contains_join(entities, "name", terms, "term").withColumn("tier", F.when(F.lower("name") == F.lower("term"), "exact").otherwise("partial"))
    nth = F.row_number().over(Window.partitionBy("query_id", "term", "entity_type", "tier").orderBy("entity_id"))
    return hit.withColumn("k", nth).where(F.col("k") <= F.when(F.col("tier") == "exact", exact).otherwise(partial)).select("query_id", "term", "entity_id", "entity_type", "tier")


def fusion_pool(graph: DataFrame, vectors: DataFrame, n_graph: int = 8, n_vectors: int = 12, width: int = 150) -> DataFrame:
    """(query_id, key, doc_id, summary): what a model is asked to rank: the best of both lists under synthetic keys, texts cut."""
    cut = lambda df, n, p: df.where(F.col("rank") <= n).select("query_id", F.concat(F.lit(p), F.col("rank").cast("string")).alias("key"), "doc_id", F.left(text_of("text"), F.lit(width)).alias("summary"))
    return cut(graph, n_graph, "G_").unionByName(cut(vectors, n_vectors, "V_"))


def query_facets(results: DataFrame, top: int = 10, most: int = 3) -> DataFrame:
    """(query_id, modules, signals, states) of the first ``top`` results: all modules, and ``most`` signals and states, sorted."""
    r = results.where(F.col("rank") <= top)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(_known(c)))))
    return r.groupBy("query_id").agg(F.array_sort(F.collect_set(F.nullif("module", F.lit("")))).alias("modules"), F.slice(flat("signals"), 1, most).alias("signals"), F.slice(flat("states"), 1, most).alias("states"))


def hypotheses(support: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, cause, likelihood, rank): min(0.15 n + 0.3, 0.95) of each cause with n pieces of evidence, the likeliest ``top``."""
    n = support.groupBy("query_id", "cause").agg(F.count(F.lit(1)).alias("n"))
    scored = n.withColumn("likelihood", F.least(0.15 * F.col("n") + 0.3, F.lit(0.95)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), "cause"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "cause", "likelihood", "rank")


def new_steps(done: DataFrame, proposed: DataFrame) -> DataFrame:
    """(query_id, source, query): proposed retrieval steps not yet done (by source and query), each once: an agent's loop ends when none is left."""
    keys = ["query_id", "source", "query"]
    return proposed.select(*keys).distinct().join(done.select(*keys), keys, "left_anti")
