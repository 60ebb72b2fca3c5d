"""Template routing, plan rows and their level-wise execution: data where it grows, driver code where it is a handful of nodes."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import text_of
from docloom.plans.domain import DEFINITION_WORDS, TIME_SPANS, Domain
from docloom.sources.storage import stored


@dataclass(frozen=True)
class Template:
    """A plan's nodes and edges besides completeness (which every node feeds, and which comes last), and the words that call for it."""

    nodes: tuple[str, ...]
    edges: tuple[tuple[str, str], ...]
    triggers: tuple[str, ...]


# Each plan template's nodes, edges and trigger words (a template's order breaks ties).
TEMPLATES = {
    "factual_lookup": Template(
        nodes=("intent", "chunk_search"),
        edges=(("intent", "chunk_search"),),
        triggers=("是什么", "定义", "取值", "编码", "含义", "描述", "有哪些", "列出", "参数", "配置", "PIN", "管脚"),
    ),
    "state_transition": Template(
        nodes=("intent", "state_machine", "rule_lookup", "chunk_search"),
        edges=(("intent", "state_machine"), ("intent", "rule_lookup"), ("intent", "chunk_search"), ("state_machine", "rule_lookup")),
        triggers=("迁移", "转移", "进入", "退出", "如何到达", "状态", "Abandoned", "Inactive", "Convenience", "Driving", "前置条件", "触发条件", "guard"),
    ),
    "impact_analysis": Template(
        nodes=("intent", "impact", "state_machine", "rule_lookup", "chunk_search"),
        edges=(("intent", "impact"), ("intent", "chunk_search"), ("impact", "state_machine"), ("impact", "rule_lookup"), ("state_machine", "rule_lookup")),
        triggers=("影响", "impact", "导致", "后果", "连锁", "失效", "故障会影响", "会影响", "后果是什么"),
    ),
    "path_finding": Template(
        nodes=("intent", "path_finder", "state_machine", "rule_lookup", "chunk_search"),
        edges=(("intent", "path_finder"), ("intent", "chunk_search"), ("path_finder", "state_machine"), ("path_finder", "rule_lookup"), ("state_machine", "rule_lookup")),
        triggers=("如何从", "怎么从", "路径", "几步", "到达", "最短", "所有路径", "经过"),
    ),
    "diagnostic": Template(
        nodes=("intent", "rule_lookup", "impact", "state_machine", "conflicts", "chunk_search"),
        edges=(("intent", "rule_lookup"), ("intent", "chunk_search"), ("intent", "conflicts"), ("rule_lookup", "impact"), ("rule_lookup", "state_machine"), ("impact", "state_machine"), ("state_machine", "rule_lookup")),
        triggers=("为什么不能", "为何无法", "故障", "诊断", "失效", "错误", "异常", "不工作", "无法启动", "无法进入", "检测条件", "故障反应", "恢复"),
    ),
    "reachability_check": Template(
        nodes=("intent", "reachability", "state_machine", "rule_lookup", "chunk_search"),
        edges=(("intent", "reachability"), ("intent", "chunk_search"), ("reachability", "state_machine"), ("reachability", "rule_lookup"), ("state_machine", "rule_lookup")),
        triggers=("不可达", "死锁", "活锁", "是否存在", "所有状态", "连通", "可达", "永远无法"),
    ),
}


def template(name: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(nodes, edges) of a template, completeness included."""
    known = TEMPLATES[name]
    return [*known.nodes, "completeness"], [*known.edges, *((n, "completeness") for n in known.nodes)]


def route(question: Column | str, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first rule's name of which all words occur, or null."""
    q, out = F.lower(text_of(question)), F.lit(None).cast("string")
    for name, words in reversed(rules):
        hit = reduce(lambda a, w: a & F.contains(q, F.lit(w.lower())), words, F.lit(True))
        out = F.when(hit, name).otherwise(out)
    return out


def select_template(question: Column | str, domain: Domain) -> Column:
    """Keyword override, then state with definition, then most trigger words (first of equals; no lookup of facts if a state is named), then defaults."""
    q = F.lower(text_of(question))
    any_of = lambda words: reduce(lambda a, w: a | F.contains(q, F.lit(w)), words, F.lit(False))
    state = any_of(list(domain.state_names))
    scores = []
    for n, name in enumerate(TEMPLATES):
        s = sum((F.contains(q, F.lit(w.lower())).cast("int") for w in TEMPLATES[name].triggers), F.lit(0))
        scores.append(F.struct((F.when(state, 0).otherwise(s) if name == "factual_lookup" else s).alias("score"), F.lit(-n).alias("k"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.coalesce(route(question, domain.router), F.when(state & any_of(list(DEFINITION_WORDS)), "state_transition"), F.when(best["score"] > 0, best["name"]), F.when(state, "state_transition"), F.lit("factual_lookup"))


def resolve_dates(question: str, as_of: date) -> tuple[str, dict[str, int]]:
    """The question with today's words replaced, and the day spans it names; ``as_of`` is always explicit."""
    today = as_of.isoformat()
    out = question.replace("今天", today)
    if "日期" not in out:
        out = out.replace("现在", today)
    spans = {k: v for k, v in TIME_SPANS.items() if k in question}
    for y, m, d in re.findall(r"(\d{4})[年/-](\d{1,2})[月/-](\d{1,2})", question):
        spans[f"{y}-{int(m):02d}-{int(d):02d}"] = (as_of - date(int(y), int(m), int(d))).days
    return out, spans


def topological_levels(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Kahn's levels; edges that would close a cycle are left out (a plan has a handful of nodes, so this is driver work)."""
    kept: list[tuple[str, str]] = []

    def reaches(a: str, b: str) -> bool:
        return a == b or any(reaches(y, b) for x, y in kept if x == a)

    for a, b in edges:
        if not reaches(b, a):
            kept.append((a, b))
    left, out = list(nodes), []
    while left:
        level = [n for n in left if not any(b == n and a in left for a, b in kept)]
        out.append(level)
        left = [n for n in left if n not in level]
    return out


@dataclass
class NodeOutput:
    node: str
    status: str
    rows: DataFrame | None = None
    error: str = ""


@dataclass
class Plan:
    template: str
    nodes: list[str]
    edges: list[tuple[str, str]]
    params: dict[str, dict] = field(default_factory=dict)


def build_plan(name: str, params: dict[str, dict] | None = None, disabled: tuple[str, ...] = ()) -> Plan:
    nodes, edges = template(name)
    kept = [n for n in nodes if n not in disabled]
    return Plan(name, kept, [(a, b) for a, b in edges if a in kept and b in kept], params or {})


def run_plan(plan: Plan, executors: dict[str, Callable[[dict, dict[str, DataFrame]], DataFrame]], threads: int = 4) -> dict[str, NodeOutput]:
    """Level by level, nodes of a level in driver threads (the FAIR scheduler shares the cluster); a failed node is recorded, not raised.

    An executor gets its parameters and its predecessors' DataFrames; static parameters win over what flows in.
    """
    out: dict[str, NodeOutput] = {}

    def one(node: str) -> NodeOutput:
        given = {a: out[a].rows for a, b in plan.edges if b == node and a in out and out[a].rows is not None}
        try:
            rows = executors[node](plan.params.get(node, {}), given)
            return NodeOutput(node, "ok", stored(rows) if rows is not None else None)  # so that what fails at run time fails here
        except Exception as e:  # noqa: BLE001  a node's failure is a result
            return NodeOutput(node, "failed", None, f"{type(e).__name__}: {e}"[:500])

    for level in topological_levels(plan.nodes, plan.edges):
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for result in pool.map(one, level):
                out[result.node] = result
    return out


def follow(path: str, data: dict) -> object:
    """A data-flow expression ``a.b[*].c``, ``a[0]``, ``a[-1]`` on nested dictionaries and lists; None where nothing is there."""
    values, many = [data], False
    for name, index in re.findall(r"([^.\[\]]+)(?:\[(\*|-?\d+)\])?", path):
        values = [v[name] for v in values if isinstance(v, dict) and name in v]
        if index == "*":
            many, values = True, [x for v in values if isinstance(v, list) for x in v]
        elif index:
            values = [v[int(index)] for v in values if isinstance(v, list) and -len(v) <= int(index) < len(v)]
    return values if many else values[0] if values else None
