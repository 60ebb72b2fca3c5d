"""Nested structures as rows: a document body of nested groups in reading order, and condition trees as one expression.

Both go level by level over written tables, so their depth costs jobs, not plan size; a level holds each node of a document or tree once.
Both sides of every join grow with the documents, but their files tell little of their rows (ids and paths compress to next to nothing):
they are merged, as a broadcast chosen by file size would pass all of them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import text_of
from docloom.sources.storage import discard, stored

#: Levels at most; deeper ones are an error, not cut.
DEEPEST = 100
#: Kinds of items that are appended if no group refers to them, in this order.
ORPHANS = ("text", "table", "picture")


def body_order(nodes: DataFrame, children: DataFrame, root: str = "#/body") -> DataFrame:
    """(doc_id, idx, ref, kind, orphan): a document's items in the order of its body.

    nodes: doc_id, ref, kind ('group' or an item's), ord. children: doc_id, parent, nth, ref. A group's items follow where the group stands;
    what is referred to again, by a cycle or not, counts at its first place. References to nothing are passed over. Texts, tables
    and pictures that nothing refers to follow at the end, by kind and ``ord``.

    Only groups are walked, over the references to groups; what they hold meets them once, at the end. References cross a shuffle twice, by
    document alone, which keeps a document's rows together: they take a fraction of the disk that joins by reference at every level take.
    """
    at = children.select("doc_id", "parent", "nth", "ref").where("doc_id is not null and ref is not null")
    own = nodes.where("kind = 'group'").select("doc_id", "ref", F.lit(True).alias("own"))
    called = _dealt(at.unionByName(own, allowMissingColumns=True)).withColumn("inner", F.max("own").over(Window.partitionBy("doc_id", "ref")))
    inner = stored(called.where("inner and own is null").select("doc_id", "parent", "nth", "ref"))
    level = stored(inner.where(F.col("parent") == root).groupBy("doc_id", "ref").agg(F.array(F.min("nth")).alias("path")).withColumn("above", F.array("ref")))
    below = inner.where(F.col("parent") != root) if inner.where(F.col("ref") == root).isEmpty() else inner
    levels = [level]
    for _ in range(DEEPEST):
        down = level.withColumnRenamed("ref", "parent").hint("merge").join(below.hint("merge"), ["doc_id", "parent"])
        step = down.where(~F.array_contains("above", F.col("ref"))).select("doc_id", "ref", F.array_append("path", F.col("nth")).alias("path"), F.array_append("above", F.col("ref")).alias("above"))
        # of the places of one group on one level only the first can give first places below it
        level = stored(step.groupBy("doc_id", "ref").agg(F.min_by(F.struct("path", "above"), "path").alias("r")).select("doc_id", "ref", "r.*"))
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
    else:
        raise ValueError(f"groups are nested deeper than {DEEPEST} levels")
    discard(inner)
    items = nodes.where("kind <> 'group'").select("doc_id", "ref", "kind", "ord")
    rows = items.unionByName(at.withColumnRenamed("parent", "key"), allowMissingColumns=True)
    for x in levels:
        rows = rows.unionByName(x.select("doc_id", F.col("ref").alias("key"), F.struct("path", "above").alias("place")), allowMissingColumns=True)
    free = F.filter(F.collect_list("place").over(Window.partitionBy("doc_id", "key")), lambda p: ~F.array_contains(p["above"], F.col("ref")))
    rows = _dealt(rows).withColumn("way", F.array_min(F.transform(free, lambda p: F.array_append(p["path"], F.col("nth"))))).where("place is null")
    alike, top = Window.partitionBy("doc_id", "ref"), F.col("key") == root
    of_root = F.when(F.max(top).over(alike), F.array(F.min(F.when(top, F.col("nth"))).over(alike)))
    rank = F.array_position(F.array(*map(F.lit, ORPHANS)), F.col("kind"))
    found = rows.withColumn("path", F.least(F.min("way").over(alike), of_root)).where(F.col("kind").isNotNull() & (F.col("path").isNotNull() | (rank > 0)))
    order = Window.partitionBy("doc_id").orderBy(F.col("path").isNull(), "path", rank, "ord", "ref")
    return found.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "ref", "kind", F.col("path").isNull().alias("orphan"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by document, for all windows after it. AQE sees how little they compress to and not the room they take, so the tasks are counted here."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _leaf() -> Column:
    signal, value = text_of("signal"), text_of("value")
    return F.when((signal != "") & (value != ""), F.concat(signal, F.lit("="), value)).otherwise(F.concat(signal, value))


def infix(nodes: DataFrame) -> DataFrame:
    """(tree_id, expression): condition trees as text, 'a=1 AND b=2 OR c=3', as the parts stand in the tree (without brackets).

    nodes: tree_id, node_id, parent_id (null for the root), nth, kind (AND, OR, else a leaf), signal, value. Empty parts are left out; a tree
    without any is ''. A node that its root does not reach has no part in it.
    """
    rows = nodes.select("tree_id", "node_id", "parent_id", "nth", "kind", _leaf().alias("leaf"))
    level = rows.where("parent_id is null")
    levels = [level]
    for _ in range(DEEPEST):
        level = stored(rows.join(level.select("tree_id", F.col("node_id").alias("parent_id")).hint("merge"), ["tree_id", "parent_id"]))
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
    else:
        raise ValueError(f"a tree is deeper than {DEEPEST} levels, or has a cycle")
    below = None
    for level in reversed(levels):
        inner, text = F.col("kind").isin("AND", "OR"), F.col("leaf")
        if below is None:
            told = level.withColumn("text", F.when(inner, "").otherwise(text))
        else:
            parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("nth", "node_id", "text")))), lambda x: x["text"])
            made = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(parts.alias("parts"))
            joined = F.array_join(F.coalesce("parts", F.array().cast("array<string>")), " AND "), F.array_join(F.coalesce("parts", F.array().cast("array<string>")), " OR ")
            told = level.join(made.hint("merge"), ["tree_id", "node_id"], "left").withColumn("text", F.when(F.col("kind") == "AND", joined[0]).when(F.col("kind") == "OR", joined[1]).otherwise(text))
        below = told.select("tree_id", "node_id", "parent_id", "nth", "text")
    return below.select("tree_id", F.col("text").alias("expression"))
