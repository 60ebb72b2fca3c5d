"""Agents over the engine: decomposition, tools, verifying rounds, reflection and citations.

Everything that grows is a DataFrame over a set of questions; driver code walks over a handful of plan nodes or rounds. A language
model is never needed: where the flow calls for one, a column or a callable takes its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import agent_tokens, text_of
from docloom.operators.evaluation import coverage_score
from docloom.operators.reasoning import new_steps
from docloom.plans.planner import NodeOutput, Plan, build_plan
from docloom.sources.storage import stored

ENOUGH, PARTS, GAPS, ROUNDS = 0.7, 4, 2, 3


def sub_questions(c: Column | str, most: int = PARTS) -> Column:
    """A question's parts at commas, semicolons, question marks and conjunctions, at most ``most``; the whole where there is no other."""
    parts = F.filter(F.transform(F.split(text_of(c), r"[，,；;？?]|以及|并且|\band\b"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.slice(F.array_distinct(parts), 1, most)).otherwise(F.array(text_of(c)))


def keyword_gaps(questions: DataFrame, evidence: DataFrame, most: int = GAPS) -> DataFrame:
    """(query_id, covered, gaps): the share of a question's tokens that its evidence (query_id, text) holds, and the first missing ones."""
    asked = questions.select("query_id", F.posexplode(agent_tokens("query")).alias("nth", "token"))
    hits = asked.join(evidence.select("query_id", "text"), "query_id").where(F.contains(F.lower("text"), F.lower("token"))).select("query_id", "nth").distinct()
    told = asked.join(hits.withColumn("hit", F.lit(True)), ["query_id", "nth"], "left")
    missing = F.transform(F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.struct("nth", "token")))), lambda x: x["token"])
    grouped = told.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("covered"), F.slice(missing, 1, most).alias("gaps"))
    return questions.select("query_id").join(grouped, "query_id", "left").select("query_id", F.coalesce("covered", F.lit(1.0)).alias("covered"), F.coalesce("gaps", F.array().cast("array<string>")).alias("gaps"))


def citations(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """(query_id, cited): ids (query_id, id) that occur in their question's answer (query_id, answer)."""
    return answers.join(ids, "query_id").where(F.contains("answer", F.col("id"))).select("query_id", F.col("id").alias("cited")).distinct()


def gather(search: Callable[[DataFrame], DataFrame], questions: DataFrame, rounds: int = ROUNDS, enough: float = ENOUGH) -> tuple[DataFrame, DataFrame]:
    """(evidence, verdict) for all questions at once: each round searches the open steps, then asks for what is still missing.

    evidence: query_id, source, chunk_id, text, coverage. verdict: query_id, coverage, covered, gaps. A question is done once its
    tokens are covered to ``enough``; a step (by source and query) is never taken twice, so rounds end by themselves.
    """
    steps = stored(questions.select("query_id", F.lit("question").alias("source"), F.explode(sub_questions("query")).alias("query")).distinct())
    done, evidence = None, None
    for k in range(rounds):
        keyed = steps.withColumn("step", F.xxhash64("query_id", "source", "query"))
        hits = search(keyed.select(F.col("step").alias("query_id"), "query")).withColumnRenamed("query_id", "step")
        told = hits.join(keyed.select("step", F.col("query_id").alias("of"), "source", "query"), "step")
        share = F.size(F.filter(agent_tokens("query"), lambda x: F.contains(F.lower("text"), F.lower(x)))) / F.greatest(F.size(agent_tokens("query")), F.lit(1))
        found = told.select(F.col("of").alias("query_id"), "source", "chunk_id", "text", share.alias("coverage"))
        evidence = stored(found if evidence is None else evidence.unionByName(found).dropDuplicates(["query_id", "source", "chunk_id"]))
        done = steps if done is None else done.unionByName(steps)
        open_ = keyword_gaps(questions, evidence).where(F.col("covered") < enough)
        steps = stored(new_steps(done, open_.select("query_id", F.lit(f"gap-{k}").alias("source"), F.explode("gaps").alias("query"))))
        if steps.isEmpty():
            break
    return evidence, questions.select("query_id").join(coverage_score(evidence, questions), "query_id", "left").join(keyword_gaps(questions, evidence), "query_id")


def reflect(outputs: dict[str, NodeOutput], sufficient: bool = True) -> list[tuple[str, str]]:
    """(kind, node) of what went wrong in a plan: fail, gap (no rows), and quality where the whole is not sufficient."""
    found = [("fail", n) for n, o in outputs.items() if o.status != "ok"]
    found += [("gap", n) for n, o in outputs.items() if o.status == "ok" and o.rows is not None and o.rows.isEmpty()]
    return found + ([] if sufficient else [("quality", "completeness")])


#: What stands in for a node that failed or found nothing.
AUGMENTED = {"state_machine": "rule_lookup", "path_finder": "state_machine", "impact": "chunk_search", "rule_lookup": "chunk_search", "conflicts": "rule_lookup", "reachability": "state_machine"}


def augment(plan: Plan, issues: list[tuple[str, str]]) -> Plan:
    """The plan with a stand-in for each node that failed or found nothing; it is the plan itself if there is none to add."""
    more = [AUGMENTED[n] for _, n in issues if AUGMENTED.get(n) and AUGMENTED[n] not in plan.nodes]
    if not more:
        return plan
    nodes = [*plan.nodes[:-1], *dict.fromkeys(more), plan.nodes[-1]]
    edges = plan.edges + [("intent", n) for n in dict.fromkeys(more)] + [(n, plan.nodes[-1]) for n in dict.fromkeys(more)]
    return Plan(plan.template, nodes, edges, plan.params)


@dataclass
class Tools:
    """At most ``limit`` calls of named tools, each a callable to a DataFrame; the calls are kept as an audit trail."""

    tools: dict[str, Callable[..., DataFrame]]
    limit: int = 5
    calls: list[tuple[str, dict]] = field(default_factory=list)

    def call(self, name: str, **given: object) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"no tool {name}; there are {', '.join(sorted(self.tools))}")
        if len(self.calls) >= self.limit:
            raise RuntimeError(f"{self.limit} calls are used up")
        self.calls.append((name, given))
        return self.tools[name](**given)


def plan_for(template: str, keep: tuple[str, ...]) -> Plan:
    """The nodes of a template that a data set can serve."""
    plan = build_plan(template)
    return build_plan(template, disabled=tuple(n for n in plan.nodes if n not in keep and n != "completeness"))
