"""Readers: artefacts at rest (JSON in tolerated layouts) and raw documents, to tables with explicit schemas.

Aliases and defaults are resolved here, at the scan, and nowhere later.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.office import PARSERS

ITEM_DDL = "type string, level int, text string, html string"
TEXT_SUFFIXES = (".html", ".htm", ".md", ".txt", ".csv")


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def _either(*names: str) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of ``text_chunks``; an empty file is an error, found when the plan runs."""
    one = "struct<chunk_id:string,chunk_type:string,module:string,section_path:string,section_title:string,text:string,entities:array<string>,signals:array<string>,states:array<string>,has_table:boolean,token_count:int>"
    raw = _json(spark, path, f"text_chunks array<{one}>")
    checked = raw.select(F.when(F.size("text_chunks") > 0, F.col("text_chunks")).otherwise(F.raise_error(F.lit("no text_chunks"))).alias("c"))
    c = checked.select(F.explode("c").alias("c")).select("c.*")
    for name in ("entities", "signals", "states"):
        c = c.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return c.withColumn("has_table", F.coalesce("has_table", F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, payload) of ``points`` or of ``text_chunks`` and ``image_chunks``; a null vector of known size is zeros."""
    one = "array<struct<id:string,chunk_id:string,vector:array<float>,payload:map<string,string>>>"
    raw = _json(spark, path, f"dim int, points {one}, text_chunks {one}, image_chunks {one}")
    every = F.flatten(F.filter(F.array("points", "text_chunks", "image_chunks"), lambda x: x.isNotNull()))
    rows = raw.select("dim", F.explode(every).alias("p"))
    zero = F.when(F.col("dim") > 0, F.array_repeat(F.lit(0.0).cast("float"), F.col("dim")))
    return rows.select(F.coalesce("p.id", "p.chunk_id").alias("id"), F.coalesce("p.vector", zero).alias("vector"), F.col("p.payload").alias("payload"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges): entities|nodes, relationships|edges, source_id|source, target_id|target; edges without an end are left out.

    Ends that no entity has become bare entities with an empty name.
    """
    node = "array<struct<entity_id:string,id:string,entity_type:string,type:string,name:string,module:string,section_path:string,properties:map<string,string>>>"
    edge = "array<struct<source_id:string,source:string,target_id:string,target:string,rel_type:string,type:string,weight:double,guard:string>>"
    raw = _json(spark, path, f"entities {node}, nodes {node}, relationships {edge}, edges {edge}")
    e = raw.select(F.explode(_either("entities", "nodes")).alias("e")).select(F.coalesce("e.entity_id", "e.id").alias("entity_id"), F.coalesce("e.entity_type", "e.type", F.lit("")).alias("entity_type"), F.coalesce("e.name", F.lit("")).alias("name"), F.coalesce("e.module", F.lit("")).alias("module"), F.coalesce("e.section_path", F.lit("")).alias("section_path"), F.col("e.properties").alias("properties"))
    r = raw.select(F.posexplode(_either("relationships", "edges")).alias("ord", "r"))
    r = r.select(F.coalesce("r.source_id", "r.source").alias("src"), F.coalesce("r.target_id", "r.target").alias("dst"), F.lower(F.coalesce("r.rel_type", "r.type", F.lit(""))).alias("rel"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"), F.coalesce("r.guard", F.lit("")).alias("guard"), F.col("ord").cast("long"))
    r = r.where("src <> '' and dst <> ''")
    ends = r.select(F.col("src").alias("entity_id")).unionByName(r.select(F.col("dst").alias("entity_id"))).distinct().join(e, "entity_id", "left_anti")
    bare = ends.select("entity_id", *[F.lit("").alias(c) for c in ("entity_type", "name", "module", "section_path")], F.lit(None).cast("map<string,string>").alias("properties"))
    return e.unionByName(bare), r


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules with condition_expr|condition and action|action_text; values that were left out are defaults."""
    one = "array<struct<rule_id:string,module:string,rule_type:string,condition_expr:string,condition:string,action:string,action_text:string,source_section:string,section:string,confidence:double>>"
    rows = _json(spark, path, f"rules {one}").select(F.explode("rules").alias("r"))
    text = lambda *n: F.coalesce(*[F.col(f"r.{x}") for x in n], F.lit(""))
    return rows.select(text("rule_id").alias("rule_id"), text("module").alias("module"), text("rule_type").alias("rule_type"), text("condition_expr", "condition").alias("condition"), text("action", "action_text").alias("action"), text("source_section", "section").alias("section"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """A section tree at rest: (section_id, parent_id, level, number, title, module, start_idx, end_idx); missing modules are ''."""
    one = "array<struct<section_id:string,id:string,parent_id:string,level:int,number:string,title:string,module:string,start_idx:int,end_idx:int>>"
    rows = _json(spark, path, f"sections {one}, nodes {one}").select(F.explode(_either("sections", "nodes")).alias("s"))
    return rows.select(F.coalesce("s.section_id", "s.id").alias("section_id"), "s.parent_id", F.coalesce("s.level", F.lit(1)).alias("level"), "s.number", F.coalesce("s.title", F.lit("")).alias("title"), F.coalesce("s.module", F.lit("")).alias("module"), "s.start_idx", "s.end_idx")


def data_sets(spark: SparkSession, folder: str, marker: str = "knowledge_graph.json") -> DataFrame:
    """(name, path, entities, relations) of each data set below a folder: a folder that holds ``marker``."""
    node, edge = "array<struct<id:string>>", "array<struct<type:string>>"
    raw = _json(spark, f"{folder}/*/{marker}", f"entities {node}, nodes {node}, relationships {edge}, edges {edge}").withColumn("file", F.input_file_name())
    home = F.regexp_extract("file", "^(.*)/[^/]+$", 1)
    count = lambda a, b: F.coalesce(F.size(_either(a, b)), F.lit(0))
    return raw.select(F.regexp_extract(home, "([^/]+)$", 1).alias("name"), home.alias("path"), F.greatest(count("entities", "nodes"), F.lit(0)).alias("entities"), F.greatest(count("relationships", "edges"), F.lit(0)).alias("relations"))


def pictures(items: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, idx, name, suffix, content) of images given as data URIs: named by the first 12 signs of their content's MD5, each content once a document.

    Vector markup has no picture and is left out.
    """
    uri = F.col(source)
    suffix = F.lower(F.regexp_extract(uri, "^data:image/([A-Za-z0-9]+)", 1))
    content = F.try_to_binary(F.regexp_extract(uri, "base64,(.*)$", 1), F.lit("base64"))
    rows = items.where(uri.startswith("data:image/") & ~suffix.isin("svg", "vml")).select("doc_id", "idx", suffix.alias("suffix"), content.alias("content")).where("content is not null")
    named = rows.withColumn("name", F.left(F.md5("content"), F.lit(12)))
    return named.groupBy("doc_id", "name").agg(F.min("idx").alias("idx"), F.min_by("suffix", "idx").alias("suffix"), F.min_by("content", "idx").alias("content")).select("doc_id", "idx", "name", "suffix", "content")


def read_state_machines(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(states, transitions) of all files of a glob, every module kept apart; single and multi-module layouts."""
    state = "array<struct<name:string,is_initial:boolean,is_terminal:boolean>>"
    move = "array<struct<id:string,source:string,target:string,guard:string,effect:string,priority:int,confidence:double>>"
    machine = f"struct<module:string,states:{state},transitions:{move}>"
    raw = _json(spark, glob, f"module string, states {state}, transitions {move}, machines array<{machine}>")
    m = raw.select(F.explode(F.coalesce("machines", F.array(F.struct("module", "states", "transitions")))).alias("m")).select("m.*").withColumn("module", F.coalesce("module", F.lit("")))
    no = F.lit(False)
    s = m.select("module", F.explode("states").alias("s")).select("module", "s.name", F.coalesce("s.is_initial", no).alias("is_initial"), F.coalesce("s.is_terminal", no).alias("is_terminal"))
    t = m.select("module", F.posexplode("transitions").alias("ord", "t")).select("module", "t.id", F.col("t.source").alias("src"), F.col("t.target").alias("dst"), F.coalesce("t.guard", F.lit("")).alias("guard"), F.coalesce("t.effect", F.lit("")).alias("effect"), F.coalesce("t.priority", F.lit(0)).alias("priority"), F.col("ord").cast("long").alias("ord"))
    return s, t


class _Items(HTMLParser):
    """Titles, paragraphs, lists, tables and images of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, int | None, str, str]] = []
        self.kind, self.level, self.parts, self.table, self.depth, self.skip = None, None, [], [], 0, 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if self.kind and text:
            self.items.append((self.kind, self.level, text, ""))
        self.kind, self.level, self.parts = None, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "table":
            if not self.depth:
                self.flush()
                self.table = []
            self.depth += 1
        if self.depth:
            spans = "".join(f' {k}="{v}"' for k, v in attrs if k in ("rowspan", "colspan"))
            self.table.append(f"<{tag}{spans}>")
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "title", int(tag[1])
        elif tag in ("p", "div", "section", "article"):
            self.flush()
            self.kind = "paragraph"
        elif tag == "li":
            self.flush()
            self.kind = "list"
        elif tag == "img":
            self.flush()
            a = dict(attrs)
            self.items.append(("image", None, a.get("alt") or "", a.get("src") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        if self.depth:
            self.table.append(f"</{tag}>")
            if tag == "table":
                self.depth -= 1
                if not self.depth:
                    self.items.append(("table", None, "", "".join(self.table)))
        elif tag in ("p", "li", "div") or re.fullmatch("h[1-6]", tag):
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        if self.depth:
            self.table.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        else:
            if self.kind is None and data.strip():
                self.kind = "paragraph"
            self.parts.append(data)


def html_items(page: str | None) -> list[tuple[str, int | None, str, str]]:
    parser = _Items()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def markdown_items(text: str | None) -> list[tuple[str, int | None, str, str]]:
    """Headings, list lines, pipe tables (as HTML) and paragraphs."""
    out, block = [], []

    def close() -> None:
        if block and all(x.lstrip().startswith("|") for x in block):
            rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in block if not re.fullmatch(r"[|\s:\-]+", x.strip())]
            out.append(("table", None, "", "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"))
        elif block:
            out.append(("paragraph", None, " ".join(x.strip() for x in block), ""))
        block.clear()

    for line in (text or "").splitlines():
        if m := re.match(r"(#{1,6})\s+(.*\S)", line):
            close()
            out.append(("title", len(m[1]), m[2], ""))
        elif m := re.match(r"\s*(?:[-*+]|\d+\.)\s+(.*\S)", line):
            close()
            out.append(("list", None, m[1], ""))
        elif not line.strip():
            close()
        else:
            if block and line.lstrip().startswith("|") != block[-1].lstrip().startswith("|"):
                close()
            block.append(line)
    close()
    return out


Parser = Callable[[bytes], list[tuple[str, int | None, str, str]]]
_TEXT: dict[str, Parser] = {".html": lambda b: html_items(b.decode("utf-8", "replace")), ".md": lambda b: markdown_items(b.decode("utf-8", "replace"))}
_TEXT |= {".htm": _TEXT[".html"], ".txt": _TEXT[".md"], ".csv": lambda b: markdown_items("\n".join("|" + "|".join(x.split(",")) + "|" for x in b.decode("utf-8", "replace").splitlines()))}


def parse_documents(spark: SparkSession, path: str, parsers: dict[str, Parser | list[Parser]] | None = None) -> DataFrame:
    """Items of all files under a path (globs allowed), one binary scan: doc_id (path), idx, page, type, level, text, html, warnings.

    ``parsers`` adds or replaces formats by suffix; several for one suffix are tried in order until one succeeds, and what the
    others said stays as warnings (PDF needs a library of the caller's choice). A file that can't be parsed at all gives one row
    with warnings instead of failing the job.
    """
    known = {**_TEXT, **PARSERS, **(parsers or {})}
    ddl = f"doc_id string, idx int, page int, {ITEM_DDL}, warnings array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "idx", "page", "type", "level", "text", "html", "warnings"]
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                suffix = re.search(r"(\.[^./]+)?$", name)[0].lower()
                chain, warnings, items = known.get(suffix, []), [], None
                for parser in chain if isinstance(chain, (list, tuple)) else [chain]:
                    try:
                        items = parser(bytes(data))
                        break
                    except Exception as e:  # noqa: BLE001  a broken file is a warning
                        warnings.append(f"{type(e).__name__}: {e}")
                if items is not None:
                    rows += [(name, i, 0, *x, warnings) for i, x in zip(count(), items)]
                else:
                    rows.append((name, None, None, None, None, None, None, warnings or [f"no parser for {suffix or 'files without suffix'}"]))
            out = pd.DataFrame(rows, columns=names)
            for c in ("idx", "page", "level"):
                out[c] = out[c].astype("Int32")
            yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ddl)


def page_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Items of a table of HTML pages."""
    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(f"idx int, page int, {ITEM_DDL}").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, 0, *x) for i, h in zip(pdf["doc_id"], pdf["html"], strict=True) for k, x in enumerate(html_items(h))]
            out = pd.DataFrame(rows, columns=schema.names)
            out["level"] = out["level"].astype("Int32")
            yield out

    return pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html")).mapInPandas(run, schema)
