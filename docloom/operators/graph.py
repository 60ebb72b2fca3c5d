"""Property-graph operators over an edge table (src, dst, rel, ord[, guard]).

``ord`` is the input's order. Walks of a bounded depth unroll into one lazy plan; closures of unknown depth iterate over
written tables until nothing is new. Frontiers are de-duplicated each hop, so work follows distinct (seed, node) pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import text_of
from docloom.operators.matching import contains_join
from docloom.sources.storage import discard, stored

DEPENDENCIES = ("depends_on", "requires", "triggered_by", "controls")


def collapse(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the last one's attributes."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("src", "dst", "r.*")


def search_entities(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, entity_id, name): case-insensitive substring of name or id."""
    by_name = contains_join(entities.select("entity_id", "name"), "name", terms.select("term"), "term")
    by_id = contains_join(entities.select("entity_id", "name"), F.col("entity_id").cast("string"), terms.select("term"), "term")
    return by_name.unionByName(by_id).select("term", "entity_id", "name").distinct()


def lookup_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Exact name, whatever the case: an equi-join."""
    return names.withColumn("key", F.lower("term")).join(entities.withColumn("key", F.lower("name")), "key").select("term", "entity_id", "name")


def modules(entities: DataFrame) -> DataFrame:
    """(entity_id, name) of the modules."""
    return entities.where("entity_type = 'module'").select("entity_id", "name")


def expand(edges: DataFrame, seeds: DataFrame, hops: int, relations: tuple[str, ...] | None = None, direction: str = "both") -> DataFrame:
    """(seed, node, distance, rel): nodes within ``hops`` of each seed, the relation of the edge that found them first.

    At equal distance out-edges come before in-edges, then input order. ``relations`` is applied to the edges before any join.
    """
    e = edges.where(F.col("rel").isin(*relations)) if relations else edges
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("node"), "rel", F.lit(0).alias("way"), "ord")
    back = e.select(F.col("dst").alias("at"), F.col("src").alias("node"), "rel", F.lit(1).alias("way"), "ord")
    both = {"both": out.unionByName(back), "out": out, "in": back}[direction]
    frontier = seeds.select("seed", F.col("seed").alias("at")).distinct()
    visited = frontier.select("seed", F.col("at").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("rel"))
    for d in range(1, hops + 1):
        step = frontier.join(both, "at").join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
        found = step.groupBy("seed", "node").agg(F.min_by("rel", F.struct("way", "ord")).alias("rel")).select("seed", "node", F.lit(d).alias("distance"), "rel")
        if d < hops:
            found = stored(found)
        visited = visited.unionByName(found)
        frontier = found.select("seed", F.col("node").alias("at"))
    return visited.where("distance > 0")


def walk(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(start, node, path, hops): all simple paths from each start, up to ``max_hops``."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    level = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    out = None
    for h in range(1, max_hops + 1):
        level = level.join(e, "node").where(~F.array_contains("path", F.col("next"))).select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        if h < max_hops:
            level = stored(level)  # else every later hop would walk the earlier ones anew
        step = level.withColumn("hops", F.lit(h))
        out = step if out is None else out.unionByName(step)
    return out


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """(start, goal, path, hops) between stated pairs; a pair of equal ends has no path."""
    return walk(edges, pairs.select("start").distinct(), max_hops).join(pairs.select("start", F.col("goal").alias("node")).distinct(), ["start", "node"]).select("start", F.col("node").alias("goal"), "path", "hops")


def shortest_paths(paths: DataFrame) -> DataFrame:
    """One path a pair: fewest hops, then lexicographic."""
    return paths.groupBy("start", "goal").agg(F.min_by("path", F.struct("hops", "path")).alias("path"), F.min("hops").alias("hops"))


def routes(edges: DataFrame, pairs: DataFrame, max_hops: int = 50) -> DataFrame:
    """(start, goal, path, hops): a shortest path between stated pairs, of those the lexicographically first; no row where there is none.

    Breadth-first: a start meets each node once, with one path, and stops when its goals are found. A pair of equal ends has no path.
    """
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    open_ = pairs.select("start", "goal").where("start <> goal").distinct()
    level = open_.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    seen, out = level.select("start", "node"), None
    for h in range(1, max_hops + 1):
        step = level.join(open_.select("start").distinct(), "start", "left_semi").join(e, "node").select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        level = stored(step.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti"))
        found = level.withColumnRenamed("node", "goal").join(open_, ["start", "goal"], "left_semi").select("start", "goal", "path", F.lit(h).alias("hops"))
        out = found if out is None else out.unionByName(found)
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("start", "node"))
        open_ = stored(open_.join(level.withColumnRenamed("node", "goal"), ["start", "goal"], "left_anti"))
    return out


def dependency_chain(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, relations: tuple[str, ...] = DEPENDENCIES) -> DataFrame:
    """(seed, node, depth, path): the shortest, then lexicographically first, path to each node over dependency relations."""
    e = edges.where(F.col("rel").isin(*relations)).select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    level = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct()
    seen = level.select("seed", "node")
    out = None
    for d in range(1, max_depth + 1):
        step = level.join(e, "node").select("seed", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        level = stored(step.groupBy("seed", "node").agg(F.min("path").alias("path")).join(seen, ["seed", "node"], "left_anti"))
        seen = seen.unionByName(level.select("seed", "node"))
        found = level.withColumn("depth", F.lit(d))
        out = found if out is None else out.unionByName(found)
    return out.select("seed", "node", "depth", "path")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, unreachable, deadlock) over distinct edges; isolated nodes count as both."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    both = nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")).unionByName(ends)
    got = both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return got.withColumn("unreachable", F.col("in_degree") == 0).withColumn("deadlock", F.col("out_degree") == 0)


def closure(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(src, dst): everything reachable in one step or more; semi-naive doubling, one written table a round."""
    total = stored(edges.select("src", "dst").distinct())
    delta = total
    for _ in range(limit):
        step = delta.select("src", F.col("dst").alias("via")).join(total.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        found = stored(step.join(total, ["src", "dst"], "left_anti"))
        if delta is not total:
            discard(delta)
        delta = found
        if delta.isEmpty():
            discard(delta)
            return total
        grown = stored(total.unionByName(delta))
        discard(total)
        total = grown
    raise RuntimeError("the closure did not settle")


def strongly_connected(reach: DataFrame) -> DataFrame:
    """(component, node): nodes that reach each other, named by the smallest; only components of two or more nodes."""
    back = reach.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = reach.join(back, ["src", "dst"], "left_semi").where("src <> dst")
    return mutual.groupBy("src").agg(F.min(F.least("src", "dst")).alias("component")).select("component", F.col("src").alias("node"))


def livelocks(edges: DataFrame, max_hops: int = 6) -> DataFrame:
    """(start, path, hops): cycles whose guards are all blank, each told once from its smallest node."""
    free = edges.where(F.trim(text_of("guard")) == "").select("src", "dst").distinct()
    paths = walk(free.where("src <> dst"), free.select(F.col("src").alias("start")).distinct(), max_hops - 1)
    closing = free.select(F.col("src").alias("node"), F.col("dst").alias("start"))
    cycles = paths.join(closing, ["start", "node"]).where(F.array_min("path") == F.col("start")).select("start", "path", (F.col("hops") + 1).alias("hops"))
    loops = free.where("src = dst").select(F.col("src").alias("start"), F.array("src").alias("path"), F.lit(1).alias("hops"))
    return cycles.unionByName(loops)


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, depth): what a change at the seed reaches along typed out-edges, with the least depth."""
    return expand(edges, seeds, max_depth, direction="out").select("seed", "node", F.col("distance").alias("depth"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch a stated id: two semi-joins instead of one join on OR."""
    touching = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return touching.distinct()


def enrich(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New edges whose (src, dst, rel) isn't known yet, each once."""
    keys = ["src", "dst", "rel"]
    return new.groupBy(*keys).agg(F.min("weight").alias("weight")).join(existing, keys, "left_anti")


def resolve_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id, tier): the entity of that very name, else the first one that contains it."""
    exact = names.join(entities.groupBy(F.lower("name").alias("key")).agg(F.min("entity_id").alias("entity_id")), F.lower(names["name"]) == F.col("key")).select(names["name"], "entity_id", F.lit("exact").alias("tier"))
    rest = names.join(exact.select("name"), "name", "left_anti")
    near = contains_join(entities.select("entity_id", F.col("name").alias("target")), "target", rest, "name").groupBy("name").agg(F.min("entity_id").alias("entity_id")).withColumn("tier", F.lit("substring"))
    return exact.unionByName(near)


def state_transitions(events: DataFrame, by: str, state: str, order: list[str]) -> DataFrame:
    """(src, dst, n): consecutive states of each key, counted."""
    nxt = F.lead(state).over(Window.partitionBy(by).orderBy(*order))
    return events.select(F.col(state).alias("src"), nxt.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def duplicate_transitions(transitions: DataFrame) -> DataFrame:
    """(src, dst, n, guards) where more than one transition joins the same states."""
    return transitions.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(text_of("guard"))).alias("guards")).where("n > 1")


def greedy_chain(edges: DataFrame, starts: DataFrame, steps: int = 5) -> DataFrame:
    """(start, path): from each start along the first edge of every node, at most ``steps``, stopping at a cycle."""
    first = edges.groupBy("src").agg(F.min_by("dst", "ord").alias("next")).withColumnRenamed("src", "node")
    level = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    for _ in range(steps):
        go = level.join(first, "node", "left")
        ok = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        level = go.select("start", F.when(ok, F.col("next")).alias("node"), F.when(ok, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"))
    return level.select("start", "path")


def levels(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """(node, level): Kahn's levels as longest path from a source, for acyclic graphs of at most ``limit`` levels.

    Each level is written once and read by the next; the walk ends with the graph.
    """
    out = nodes.select("node", F.lit(0).alias("level"))
    front = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node")
    for d in range(1, limit):
        front = stored(front.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select(F.col("next").alias("node")).distinct())
        if front.isEmpty():
            break
        out = out.unionByName(front.withColumn("level", F.lit(d)))
    return out.groupBy("node").agg(F.max("level").alias("level"))
