"""The public facade: parse, analyse, load, search, ask, and graph reasoning over one data set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import text_of
from docloom.operators import enrich, etl, explain, graph, knowledge, machines
from docloom.operators.reasoning import state_moves
from docloom.operators.index import build_index
from docloom.operators.search import embed
from docloom.plans.agent import Tools, augment, gather, reflect
from docloom.plans.domain import Domain, Domains
from docloom.plans.planner import NodeOutput, build_plan, run_plan, select_template
from docloom.plans.retrieval import Corpus, evidence, named_entities, retrieve, search_terms
from docloom.sources import readers, sinks
from docloom.sources.storage import step, stored


class Engine:
    """Methods return DataFrames, some after jobs that write intermediate tables to the shared folder; a language model, if any, is a callable (evidence, question) -> text on the driver."""

    def __init__(self, spark: SparkSession, domain: str = "bcm", domains: Domains | None = None, llm: Callable[[str, str], str] | None = None):
        self.spark, self.domains, self.llm = spark, domains or Domains(), llm
        self.domain: Domain = self.domains.get_or_create(domain)
        self.corpus: Corpus | None = None
        self.embedder: Callable | None = None
        self.rules = self.states = self.transitions = None

    def parse(self, path: str, parsers: dict | None = None) -> DataFrame:
        return readers.parse_documents(self.spark, path, parsers)

    def analyse(self, items: DataFrame, done: str = "") -> dict[str, DataFrame]:
        """All tables of parsed items: sections, chunks, mentions, entities, edges, table_records, rules, states, transitions.

        Mentions, links and rules feed several of these, so each is written to the shared folder once; the rest is lazy. Every end of an
        edge is an entity; guards, rules and faults add theirs to what texts and tables say.

        ``done`` names what parsed the items (parsers and their version). Under a name, steps are kept by the files that were read, the
        vocabulary and the name, and a later call over the same files reads them instead of doing them again.
        """
        keep = lambda step_name, make: step(step_name, items, make, done, repr(self.domain)) if done else stored(make())
        clean = items.where("idx is not null").withColumn("doc_id", text_of("doc_id")) if dict(items.dtypes)["doc_id"] == "string" else items.where("idx is not null and doc_id is not null")
        tree = etl.sections(clean)
        placed = keep("located", lambda: knowledge.located(clean, tree))
        found = etl.table_records(etl.classify_tables(clean.where("type = 'table'"), self.domain), self.domain)
        records = keep("records", lambda: knowledge.split_moves(found.join(placed.select("doc_id", "idx", "module", "section_path", "section_title"), ["doc_id", "idx"])))
        said = keep("mentions", lambda: knowledge.mentions(placed, self.domain).unionByName(knowledge.record_mentions(records)))
        links = keep("links", lambda: knowledge.text_links(placed, said, self.domain).unionByName(knowledge.table_links(records)).unionByName(knowledge.section_links(said)))
        shared = ["rule_id", "module", "rule_type", "condition", "action", "confidence"]
        rules = keep("rules", lambda: machines.prose_rules(clean).unionByName(etl.table_rules(records).select(*shared), allowMissingColumns=True))
        states, transitions = machines.build_machines(rules)
        entities, edges = stored(knowledge.entities_of(said, links)), knowledge.edges_of(links)
        more = stored(enrich.enrich_graph(edges, entities, rules, transitions))
        added = more.select("src", "dst", "rel", "weight", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("map<string,string>").alias("properties"), F.lit(None).cast(edges.schema["doc_id"].dataType).alias("doc_id"))
        ruled = enrich.rule_entities(rules).join(more.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct(), "entity_id", "left_semi").join(entities, "entity_id", "left_anti")
        return {
            "sections": tree,
            "chunks": etl.optimise_chunks(etl.build_chunks(clean, self.domain, said)),
            "mentions": said,
            "entities": entities.unionByName(ruled, allowMissingColumns=True),
            "edges": edges.unionByName(added),
            "table_records": records,
            "rules": rules,
            "states": states,
            "transitions": transitions,
        }

    def export(self, tables: dict[str, DataFrame], folder: str) -> None:
        sinks.write_json(tables, folder)

    def load(self, chunks: DataFrame, entities: DataFrame, edges: DataFrame, points: DataFrame | None = None, rules: DataFrame | None = None, transitions: DataFrame | None = None, store: bool = True, embedder: Callable | None = None, states: DataFrame | None = None) -> None:
        """What searches run on. Each search reads these tables several times, so they are written to the shared folder first, and the
        chunks get a keyword index; ``store=False`` takes tables at rest as they are and searches without an index.

        ``embedder`` (texts to vectors, batch by batch) makes the vectors of chunks that ``points`` has none for; they are stored with the
        others, so that no search makes them again.
        """
        self.embedder = embedder
        if embedder is not None:
            had = points.select("chunk_id", "vector") if points is not None else self.spark.createDataFrame([], "chunk_id string, vector array<double>")
            points = stored(embed(chunks.select("chunk_id", "text").join(had, "chunk_id", "left"), embedder).select("chunk_id", "vector"))
        keep = lambda df: stored(df) if store and df is not None else df
        held = keep(chunks)
        index = build_index(held.select(F.col("chunk_id").alias("doc_id"), "text")) if store else None
        self.corpus, self.rules, self.transitions = Corpus(held, keep(entities), keep(edges), keep(points), index), keep(rules), keep(transitions)
        self.states = keep(states)

    def search(self, queries: DataFrame, top_k: int = 10, vectors: DataFrame | None = None, **how: object) -> DataFrame:
        """See ``retrieve``; with points and an embedder (``load``), queries are embedded as the chunks were."""
        if vectors is None and self.corpus.points is not None and self.embedder is not None:
            vectors = embed(queries.select("query_id", text_of("query").alias("text")), self.embedder).select("query_id", "vector")
        return retrieve(queries, self.corpus, self.domain, top_k, vectors, **how)

    def templates(self, queries: DataFrame) -> DataFrame:
        return queries.select("query_id", "query", select_template("query", self.domain).alias("template"))

    def modules(self) -> DataFrame:
        return graph.modules(self.corpus.entities).orderBy("name")

    def ask(self, question: str) -> dict[str, NodeOutput | str]:
        """One question through its plan; nodes' rows are DataFrames, the answer text comes from the model or is the evidence itself."""
        q = self.spark.createDataFrame([(0, question)], "query_id long, query string")
        template = self.templates(q).first().template
        said = F.lit(question.lower())
        states = self.transitions.select(F.explode(F.array("src", "dst")).alias("node")).distinct().where(F.contains(said, F.lower("node"))) if self.transitions is not None else None
        named = self.corpus.entities.where((F.col("name") != "") & F.contains(said, F.lower("name")))
        names = [r.node for r in states.limit(8).collect()] if states is not None else []  # a question names a few states
        pairs = self.spark.createDataFrame([(a, b) for a in names for b in names if a != b], "start string, goal string")
        executors = {
            "intent": lambda p, given: self.templates(q),
            "chunk_search": lambda p, given: self.search(q),
            "rule_lookup": lambda p, given: self.rules.where(F.exists(F.split(F.lit(question), r"\s+"), lambda w: F.contains(F.lower("condition"), F.lower(w)))).limit(10),
            "state_machine": lambda p, given: self.transitions,
            "path_finder": lambda p, given: graph.simple_paths(self.transitions, pairs),
            "impact": lambda p, given: graph.impact(graph.collapse(self.corpus.edges), named.select(F.col("entity_id").alias("seed")), 3),
            "conflicts": lambda p, given: machines.rule_conflicts(self.rules),
            "reachability": lambda p, given: graph.degrees(self.transitions.select(F.col("src").alias("node")).distinct(), self.transitions),
            "completeness": lambda p, given: q.withColumn("inputs", F.lit(len(given))).withColumn("filled", F.lit(sum(not x.isEmpty() for x in given.values()))),
        }
        plan = build_plan(template)
        out: dict[str, NodeOutput | str] = dict(run_plan(plan, executors))
        better = augment(plan, reflect(out))
        if better is not plan:  # one more round, with stand-ins for what failed or found nothing
            out = dict(run_plan(better, executors))
        chunks = out["chunk_search"].rows if "chunk_search" in out else None
        found = evidence(chunks).first() if chunks is not None else None
        text = found.evidence if found else ""
        return out | {"template": template, "answer": self.llm(text, question) if self.llm else text}

    def gather(self, questions: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
        """Evidence and verdict of the verifying loop for questions (query_id, query)."""
        return gather(lambda q: self.search(q, 5), questions, rounds)

    def explain(self, questions: DataFrame) -> DataFrame:
        """(query_id, part, head, nth, line): what the loaded rules and machines say about each question; see ``operators.explain``.

        States that were not loaded are those which transitions join, none of them initial or terminal.
        """
        ends = self.transitions.select("module", F.explode(F.array("src", "dst")).alias("name")).distinct()
        states = self.states if self.states is not None else ends.withColumns({"is_initial": F.lit(False), "is_terminal": F.lit(False)})
        moves = self.transitions if "ord" in self.transitions.columns else self.transitions.withColumn("ord", F.col("id"))
        named = stored(named_entities(questions, self.corpus.entities))
        return explain.explain(questions, named, search_terms(questions), self.corpus.entities, self.rules, states, moves)

    def tools(self, limit: int = 5) -> Tools:
        """The seven tools of an agent over what is loaded."""
        asked = lambda query: self.spark.createDataFrame([(0, query)], "query_id long, query string")
        seed = lambda name: self.corpus.entities.where(F.lower("name") == F.lit(name.lower())).select(F.col("entity_id").alias("seed"))
        known = {
            "search_chunks": lambda query, top_k=5: self.search(asked(query), top_k),
            "query_graph": lambda name, hops=1: graph.expand(self.corpus.edges, seed(name), hops),
            "query_rules": lambda word: self.rules.where(F.contains(F.lower(F.concat_ws(" ", "condition", "action")), F.lit(word.lower()))),
            "query_state_machine": lambda state: state_moves(self.transitions, self.spark.createDataFrame([(state,)], "state string")),
            "trace_path": lambda start, goal, hops=6: graph.simple_paths(self.transitions, self.spark.createDataFrame([(start, goal)], "start string, goal string"), hops),
            "analyze_impact": lambda name, depth=3: graph.impact(self.corpus.edges, seed(name), depth),
            "check_reachability": lambda: graph.degrees(self.transitions.select(F.col("src").alias("node")).distinct(), self.transitions),
        }
        return Tools(known, limit)
