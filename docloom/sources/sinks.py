"""Sinks: tables as JSON, Cypher text and vector-point payloads. All are projections; Spark's writers do the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Descriptor of the vector collection: metadata only.
COLLECTION = {"vectors": {"dense": {"size": 1024, "distance": "Cosine"}}, "sparse_vectors": {"sparse": {}}, "hnsw_config": {"m": 16, "ef_construct": 200}}


def quoted(c: Column | str) -> Column:
    """A Cypher string literal; backslashes and quotes are escaped."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lit("'"), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, statement): constraints for each type, then nodes, then relationships."""
    label = F.regexp_replace(F.initcap(F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("Entity"))), "[^A-Za-z0-9]", "")
    constraints = entities.select(F.lit(0).alias("part"), F.concat(F.lit("CREATE CONSTRAINT IF NOT EXISTS FOR (n:"), label, F.lit(") REQUIRE n.entity_id IS UNIQUE;")).alias("statement")).distinct()
    nodes = entities.select(F.lit(1).alias("part"), F.concat(F.lit("MERGE (n:"), label, F.lit(" {entity_id: "), quoted("entity_id"), F.lit("}) SET n.name = "), quoted("name"), F.lit(", n.module = "), quoted("module"), F.lit(";")).alias("statement"))
    rel = F.regexp_replace(F.upper("rel"), "[^A-Z0-9_]", "_")
    links = edges.select(F.lit(2).alias("part"), F.concat(F.lit("MATCH (a {entity_id: "), quoted("src"), F.lit("}), (b {entity_id: "), quoted("dst"), F.lit("}) MERGE (a)-[r:"), rel, F.lit("]->(b) SET r.weight = "), F.col("weight").cast("string"), F.lit(";")).alias("statement"))
    return constraints.unionByName(nodes).unionByName(links)


def write_cypher(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """One text file set in statement order (range-partitioned by part, so no single task sorts it all)."""
    cypher(entities, edges).repartitionByRange("part", "statement").sortWithinPartitions("part", "statement").select("statement").write.mode("overwrite").text(path)


def vector_points(chunks: DataFrame) -> DataFrame:
    """(id, payload): payload texts are cut at 5000 signs."""
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(5000)).alias(c)
    return chunks.select(F.col("chunk_id").alias("id"), F.struct("module", "chunk_type", "section_path", "section_title", cut("text"), cut("embedding_text"), "has_table", "token_count").alias("payload"))


def write_json(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def machine_summary(transitions: DataFrame) -> DataFrame:
    """(module, summary): a line for each transition, sorted."""
    line = F.concat("src", F.lit(" -> "), "dst", F.when(F.col("guard") != "", F.concat(F.lit(" ["), "guard", F.lit("]"))).otherwise(""))
    return transitions.groupBy("module").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("summary"))


def image_paths(images: DataFrame) -> DataFrame:
    """Images (module, section, content, suffix) with their place in an object store: module/section/first 8 signs of the MD5.suffix."""
    name = F.concat(F.left(F.md5("content"), F.lit(8)), F.lit("."), F.coalesce(F.nullif("suffix", F.lit("")), F.lit("png")))
    part = lambda c, other: F.coalesce(F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\w.-]+", "_"), F.lit("")), F.lit(other))
    return images.withColumn("storage_path", F.concat_ws("/", part("module", "unknown"), part("section", "root"), name))


def captioned(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Images with what a vision model said of their content (name, image_type, description), '' where it has not been asked; descriptions are cut at 500."""
    said = captions.groupBy("name").agg(F.min_by("image_type", "description").alias("image_type"), F.min("description").alias("description"))
    joined = images.join(said, "name", "left")
    return joined.withColumn("image_type", F.coalesce("image_type", F.lit(""))).withColumn("description", F.left(F.coalesce("description", F.lit("")), F.lit(500)))
