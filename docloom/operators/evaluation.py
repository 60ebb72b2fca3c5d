"""Retrieval, reasoning and routing metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import text_of

def ir_metrics(results: DataFrame, breakdown: str | None = None) -> DataFrame:
    """hit@1/3/5 and MRR from (query_id, rank, relevant[, breakdown]); queries without a relevant row count as misses.

    With ``breakdown`` a rollup adds the total (null).
    """
    keys = ["query_id"] + ([breakdown] if breakdown else [])
    best = results.groupBy(*keys).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}")
    grouped = best.rollup(breakdown) if breakdown else best.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n"), hit(1), hit(3), hit(5), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def recall(found: Column, expected: Column) -> Column:
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(F.array_distinct(found), F.array_distinct(expected))) / F.size(F.array_distinct(expected))).otherwise(1.0)


def path_score(path: Column, expected: Column, conditions: Column, key_conditions: Column, forbidden: Column) -> Column:
    """0.35 steps in place, 0.15 hops, 0.35 key conditions that occur in the path's, 0.15 unless a forbidden path begins it.

    A part without an expectation counts half; no path at all scores 0. ``forbidden`` is an array of paths.
    """
    same = F.size(F.filter(F.zip_with(F.slice(path, 1, F.size(expected)), expected, lambda a, e: a == e), lambda x: x))
    hops, want = F.size(path) - 1, F.size(expected) - 1
    text = F.lower(F.array_join(conditions, " "))
    found = F.size(F.filter(key_conditions, lambda c: F.contains(text, F.lower(c))))
    bad = F.exists(forbidden, lambda f: (F.size(f) <= F.size(path)) & (F.slice(path, 1, F.size(f)) == f))
    steps = F.when(F.size(expected) > 0, same / F.size(expected)).otherwise(0.5)
    near = F.when(want > 0, F.greatest(F.lit(0.0), 1 - F.abs(hops - want) / want)).otherwise(0.5)
    said = F.when(F.size(key_conditions) > 0, found / F.size(key_conditions)).otherwise(0.5)
    return F.when(F.size(path) == 0, 0.0).otherwise(0.35 * steps + 0.15 * near + 0.35 * said + 0.15 * F.when(bad, 0.0).otherwise(1.0))


def impact_score(found: Column, expected: Column, forbidden: Column, depth: Column, least_depth: Column) -> Column:
    """0.5 recall, 0.3 without forbidden entities, 0.2 depth, whatever the case of names; nothing found scores 0."""
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    wrong = F.size(F.array_intersect(low(found), low(forbidden))) / F.greatest(F.size(low(found)), F.lit(1))
    hit = F.when(F.size(expected) > 0, recall(low(found), low(expected))).otherwise(0.5)
    deep = F.when(least_depth > 0, F.least(F.lit(1.0), depth / least_depth)).otherwise(0.5)
    return F.when(F.size(found) == 0, 0.0).otherwise(0.5 * hit + 0.3 * (1 - wrong) + 0.2 * deep)


def issue_score(found: Column, expected: Column, forbidden: Column) -> Column:
    """Mean of recall and precision less 0.2 for each forbidden kind; without expectations 1 less 0.2 for each kind found."""
    hits = F.size(F.array_intersect(found, expected))
    precision = F.when(F.size(found) > 0, hits / F.size(F.array_distinct(found))).otherwise(0.5)
    score = 0.5 * recall(found, expected) + 0.5 * precision - 0.2 * F.size(F.array_intersect(found, forbidden))
    alone = 1 - 0.2 * F.size(F.array_distinct(found))
    return F.greatest(F.lit(0.0), F.when(F.size(expected) > 0, score).otherwise(alone))


def _share(found: Column, expected: Column) -> Column:
    """``recall``, or half where nothing is expected."""
    return F.when(F.size(expected) > 0, recall(found, expected)).otherwise(0.5)


def said_share(text: Column, expected: Column) -> Column:
    """The share of expected phrases, each once, that occur in a text whatever the case; half where nothing is expected."""
    low = F.array_distinct(F.transform(expected, F.lower))
    return F.when(F.size(low) > 0, F.size(F.filter(low, lambda x: F.contains(F.lower(text), x))) / F.size(low)).otherwise(0.5)


def guard_score(guards: Column, sources: Column, sections: Column, expected_guards: Column, expected_sources: Column, expected_sections: Column) -> Column:
    """0.5 expected phrases in the guards, 0.25 source states, 0.25 sections; a part without an expectation counts half."""
    return 0.5 * said_share(F.array_join(guards, " "), expected_guards) + 0.25 * _share(sources, expected_sources) + 0.25 * _share(sections, expected_sections)


def cause_score(texts: Column, expected: Column) -> Column:
    """The share of expected root causes that occur in the texts of rules and guards; half without an expectation."""
    return said_share(F.array_join(texts, " "), expected)


def retrieval_report(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(scope, value, n, hit_1, hit_3, hit_5, mrr, module_accuracy, latency_ms, results) over all questions, each expected module and each question type.

    questions: query_id, expected_module, expected_section, question_type, latency_ms. results: query_id, rank (from 1), module, section_path.
    Ranks are those of the expected module; its section anywhere among the results counts as a hit at 1. Questions without results are
    misses; those that expect no module are left out of the modules' rows.
    """
    asked = questions.select("query_id", text_of("expected_module").alias("want"), text_of("expected_section").alias("where_"), text_of("question_type").alias("type"), "latency_ms")
    rows = results.select("query_id", "rank", "module", "section_path").join(asked, "query_id")
    first = F.min(F.when((F.col("want") != "") & (F.col("module") == F.col("want")), F.col("rank")))
    placed = F.coalesce(F.bool_or((F.col("where_") != "") & (F.col("section_path") == F.col("where_"))), F.lit(False))
    best = rows.groupBy("query_id").agg(first.alias("first"), placed.alias("placed"), F.count(F.lit(1)).alias("n"))
    q = asked.join(best, "query_id", "left")
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    by = q.groupingSets([[], [F.col("want")], [F.col("type")]], F.col("want"), F.col("type")).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), share((F.col("first") == 1) | F.col("placed")).alias("hit_1"), share(F.col("first") <= 3).alias("hit_3"), share(F.col("first") <= 5).alias("hit_5"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), share(F.col("first") == 1).alias("module_accuracy"), F.avg("latency_ms").alias("latency_ms"), F.avg(F.coalesce("n", F.lit(0))).alias("results"),
    )
    scope = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "module").otherwise("type")
    value = F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.col("want")).otherwise(F.col("type"))
    return by.where("g <> 1 or want <> ''").select(scope.alias("scope"), value.alias("value"), "n", "hit_1", "hit_3", "hit_5", "mrr", "module_accuracy", "latency_ms", "results")


# Sources that reason rather than search, and what notes hold by kind of question (the first kind whose word occurs).
DEEP_SOURCES = ("state_machine", "rule_engine", "path_finder")
EXPECTED_NOTES = (
    (("路径", "如何进入", "如何退出", "迁移"), ("→", "hops", "path", "sequence")),
    (("影响", "impact", "导致"), ("impact", "depth", "affected")),
    (("条件", "触发", "为什么"), ("condition", "guard", "前置")),
)


def coverage_score(steps: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(query_id, coverage): 0.3 for sources (a third each), 0.3 x mean coverage, 0.2 x expected notes found, 0.2 for a deep source with results.

    steps: query_id, source, coverage, optionally results and notes. questions (query_id, query) tell which notes are expected; where none
    are, that part is 0. At most 1; a question without steps has no row.
    """
    results = F.col("results") if "results" in steps.columns else F.lit(1)
    notes = text_of("notes") if "notes" in steps.columns else F.lit("")
    marks = [m for _, found in EXPECTED_NOTES for m in found]
    deep = F.bool_or(F.col("source").isin(*DEEP_SOURCES) & (results > 0))
    seen = F.filter(F.array(*[F.when(F.bool_or(F.contains(F.lower(notes), F.lit(m))), m) for m in marks]), lambda x: x.isNotNull())
    by = steps.groupBy("query_id").agg((F.least(F.count_distinct("source") / 3, F.lit(1.0)) * 0.3 + F.coalesce(F.avg("coverage"), F.lit(0.0)) * 0.3 + F.when(deep, 0.2).otherwise(0.0)).alias("base"), seen.alias("seen"))
    share = F.lit(0.0)
    if questions is not None:
        by, low, share = by.join(questions.select("query_id", "query"), "query_id", "left"), F.lower(text_of("query")), F.lit(0.0)
        for words, found in reversed(EXPECTED_NOTES):
            asked = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
            share = F.when(asked, F.size(F.array_intersect("seen", F.array(*map(F.lit, found)))) / len(found)).otherwise(share)
    return by.select("query_id", F.least(F.lit(1.0), F.col("base") + 0.2 * share).alias("coverage"))


def node_health(outputs: DataFrame) -> DataFrame:
    """(node, runs, ok, failed, utilisation, mean_confidence) over the nodes of many plans; outputs: query_id, node, status, confidence."""
    total = outputs.select("query_id").distinct().agg(F.count(F.lit(1)).alias("all"))
    by = outputs.groupBy("node").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_distinct("query_id").alias("q"), F.avg("confidence").alias("mean_confidence"))
    return by.crossJoin(total).select("node", "runs", "ok", "failed", (F.col("q") / F.col("all")).alias("utilisation"), "mean_confidence")  # one row of totals


def completeness(counts: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(query_id, score, gaps, sufficient): weighted mean of min(n / cap, 1) over the dimensions; sufficient from 0.6 without gaps.

    counts: query_id, dimension, n. dimensions: dimension, cap, weight, threshold. A dimension without a row counts 0.
    """
    grid = counts.select("query_id").distinct().crossJoin(dimensions)  # a handful of dimensions for each query
    joined = grid.join(counts, ["query_id", "dimension"], "left").withColumn("s", F.least(F.coalesce("n", F.lit(0)) / F.col("cap"), F.lit(1.0)))
    out = joined.groupBy("query_id").agg((F.sum(F.col("s") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(0.01))).alias("score"), F.sum((F.col("s") < F.col("threshold")).cast("int")).alias("gaps"))
    return out.withColumn("sufficient", (F.col("score") >= 0.6) & (F.col("gaps") == 0))


def hallucination(sentences: DataFrame, evidence: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, sentences, unsupported, ratio): sentences of which fewer than ``least`` of the words occur in the evidence.

    sentences: id, sentence, words. evidence: id, words.
    """
    joined = sentences.join(evidence.select("id", F.col("words").alias("known")), "id", "left")
    share = F.when(F.size("words") > 0, F.size(F.array_intersect("words", F.coalesce("known", F.array().cast("array<string>")))) / F.size(F.array_distinct("words"))).otherwise(1.0)
    return joined.groupBy("id").agg(F.count(F.lit(1)).alias("sentences"), F.sum((share < least).cast("int")).alias("unsupported")).withColumn("ratio", F.col("unsupported") / F.col("sentences"))


def confusion(results: DataFrame) -> DataFrame:
    """(expected, actual, n)."""
    return results.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def group_counts(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """(columns..., n): rows counted by several sets of columns in one pass; a column that a set leaves out is null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[df[c] for c in s] for s in sets], *(df[c] for c in columns)).agg(F.count(F.lit(1)).alias("n"))
