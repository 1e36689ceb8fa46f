"""Offline evaluation over DataFrames of cases and of what was retrieved, computed or routed for them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions.text import is_overview
from sheaf.functions.values import contains_all
from sheaf.sources import extract
from sheaf.sources.tablestore import TableStore

from . import answers, chunking, detect, guard, retrieval
from .dialogue import route

CASES = """id string, category string, lang string, question string, expect string, must_contain array<string>, must_not_contain array<string>, sources array<string>,
evidence_contains array<string>, gold_sql string, gold_result string, intent string, requires_dense boolean, note string"""
TOLERANCE, WORSE = 0.005, 0.02


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines; fields that aren't known are ignored, missing ones null."""
    return spark.read.schema(CASES).json(path)


def judge_retrieval(cases: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Per case (id, sources, evidence_contains, expect): status, has_fact, right_source, rank.

    candidates: (id, rank, source, text), selected: (id, source, text), what the gate let through of them. A case that expects an
    answer passes if the selected texts of the right files hold all facts; one that expects none, if nothing was selected. rank is
    of the first candidate of a right file with all facts.
    """
    facts = F.coalesce("evidence_contains", F.array().cast("array<string>"))
    named = F.coalesce(F.size("sources"), F.lit(0)) > 0
    c = cases.select("id", "expect", "sources", facts.alias("facts"))
    right = F.coalesce(F.array_contains("sources", F.col("source")), F.lit(False))
    pool = c.join(selected, "id").where(~named | right).groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("pool"))  # the few a gate lets through
    passed = selected.groupBy("id").agg(F.count("*").alias("n_selected"))
    first = c.join(candidates, "id").where(right & contains_all(F.col("text"), F.col("facts"))).groupBy("id").agg(F.min("rank").alias("rank"))
    j = c.join(pool, "id", "left").join(passed, "id", "left").join(first, "id", "left")
    fact = F.coalesce(contains_all(F.col("pool"), F.col("facts")), F.lit(False)) & F.col("pool").isNotNull()
    ok = F.when(F.col("expect") == "abstain", F.col("n_selected").isNull()).otherwise(fact)
    return j.select("id", F.when(ok, "pass").otherwise("fail").alias("status"), fact.alias("has_fact"), F.col("pool").isNotNull().alias("right_source"), "rank")


def same_cell(a: Column, b: Column) -> Column:
    """Equal, or both numbers and at most TOLERANCE apart."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= TOLERANCE).otherwise(a.eqNullSafe(b))


def same_rows(got: DataFrame, want: DataFrame, by: str = "id") -> DataFrame:
    """(id, same): whether two results (id, row, cells array<string>) have equal cells, row by row in their order."""
    g, w = got.select(by, "row", F.col("cells").alias("g")), want.select(by, "row", F.col("cells").alias("w"))
    equal = (F.size("g") == F.size("w")) & F.forall(F.zip_with("g", "w", lambda a, b: same_cell(a, b)), lambda x: x)
    return g.join(w, [by, "row"], "full").groupBy(by).agg(F.min(F.coalesce(equal, F.lit(False))).alias("same"))


def judge_analytics(cases: DataFrame, detected: DataFrame, got: DataFrame, want: DataFrame) -> DataFrame:
    """Per case: status, routed (was the question taken for a computation) and sql_correct (are the gold query's rows right)."""
    j = cases.select("id").join(detected.select("id", F.col("analytical").alias("routed")), "id", "left").join(same_rows(got, want), "id", "left")
    routed, correct = F.coalesce("routed", F.lit(False)), F.coalesce("same", F.lit(False))
    return j.select("id", F.when(routed & correct, "pass").otherwise("fail").alias("status"), routed.alias("routed"), correct.alias("sql_correct"))


def judge_routing(cases: DataFrame) -> DataFrame:
    """Per case (id, question, expect, intent): whether the rules alone decide as expected: blocked, left to the documents, or an intent."""
    r = route(F.col("question"))
    want = F.when(F.col("expect") == "blocked", "BLOCKED").when(F.col("expect") == "rag", "RAG_QUERY").otherwise(F.col("intent"))
    return cases.select("id", F.when(r.eqNullSafe(want), "pass").otherwise("fail").alias("status"), r.alias("route"))


def mean_reciprocal_rank(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of 1 / rank over all cases that weren't skipped; a case without a rank adds 0."""
    return outcomes.where("status <> 'skipped'").groupBy(*(by or [])).agg(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))


def pivoted(outcomes: DataFrame, by: str) -> DataFrame:
    """n, pass, fail and skipped of each category, in one aggregation."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "skipped")]
    return outcomes.groupBy(by).agg(F.count("*").alias("n"), *counts)


def regressions(new: DataFrame, old: DataFrame, tolerance: float = WORSE) -> DataFrame:
    """Metrics (metric, value) that are worse than before by more than the tolerance; latencies, totals and means don't count."""
    o = old.select("metric", F.col("value").alias("before")).where(~F.col("metric").rlike("^(latency|total_|mean_)"))
    return new.join(o, "metric").where(F.col("value") < F.col("before") - tolerance).select("metric", "before", "value")


# ---- the offline run over a folder of files and its cases --------------------------------------

CANDIDATES = 12
ANSWERED, ROUTED = ("lookup", "table", "multilingual", "cross_lingual", "summary"), ("routing", "injection")


def retrieved(chunks: DataFrame, questions: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(id, question, doc_id, source, text, rank, rrf_score, overview) of the candidates for each question, by keywords; a request for
    an overview gets an evenly spaced sample of all documents instead.

    chunks: (doc_id, source, ordinal, text), questions: (id, question).
    """
    whole = is_overview(F.col("question"))
    s = retrieval.scores(retrieval.build_index(chunks), chunks, questions.where(~whole), question_col="id")
    ranked = retrieval.fuse([retrieval.top_k(s, ["id"], [F.desc("score"), F.asc("doc_id")], k)], limit=k, by="id").withColumn("overview", F.lit(False))
    sample = retrieval.overview_sample(chunks, k, doc_col="source").select("doc_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source", "ordinal")).alias("rank"))  # at most k rows
    parts = questions.where(whole).select("id").join(F.broadcast(sample), F.col("rank") <= k).select("id", "doc_id", (1.0 / (F.col("rank") + 1)).alias("rrf_score"), "rank", F.lit(True).alias("overview"))
    return ranked.select("id", "doc_id", "rrf_score", "rank", "overview").unionByName(parts).join(chunks.select("doc_id", "source", "text"), "doc_id").join(questions, "id")


def offline(spark: SparkSession, files: DataFrame, cases: DataFrame, folder: str) -> DataFrame:
    """(id, category, status, rank, routed, sql_correct) of each case, without any model: files are extracted and chunked, sheets become
    tables, questions are answered as far as retrieval, rules and the gold queries go. Cases that need vectors are skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    chunks = chunking.chunk(extract.extract(files)).select(F.concat_ws("#", "path", "ordinal").alias("doc_id"), name.alias("source"), "ordinal", "text")
    live = cases.where(~F.coalesce("requires_dense", F.lit(False)))
    by = {"retrieval": ~F.col("category").isin(*ROUTED, "aggregation"), "routing": F.col("category").isin(*ROUTED), "analytics": F.col("category") == "aggregation"}
    found = retrieved(chunks, live.where(by["retrieval"]).select("id", "question"))
    selected = retrieval.gate(found, by="id")
    none = {"rank": "int", "routed": "boolean", "sql_correct": "boolean"}
    shape = lambda d: d.select("id", "status", *((F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()))
    out = shape(judge_retrieval(live.where(by["retrieval"]), found, selected)).unionByName(shape(judge_routing(live.where(by["routing"]))))

    store = TableStore(spark, folder)
    store.load("evaluation", {r.path: files.where(F.col("path") == r.path) for r in files.where(name.rlike(r"(?i)\.(csv|tsv|xlsx|xlsm)$")).select("path").collect()})  # a row for each sheet file
    views, got, want = store.views("evaluation"), [], []
    for r in live.where(by["analytics"]).select("id", "gold_sql", "gold_result").collect():  # cases are written by hand: few
        want += [(r.id, i, [None if v is None else str(v) for v in row]) for i, row in enumerate(json.loads(r.gold_result or "[]"))]
        try:
            got += [(r.id, i, [None if v is None else str(v) for v in row]) for i, row in enumerate(guard.fetch(spark, views, r.gold_sql, max_seconds=60).rows)]
        except guard.Rejected:
            pass
    rows = lambda data: spark.createDataFrame(data, "id string, row int, cells array<string>")
    detected = detect.analyze(live.where(by["analytics"]), answers.catalog_frame(spark, store.session_tables("evaluation")), True, question="id")
    out = out.unionByName(shape(judge_analytics(live.where(by["analytics"]), detected, rows(got), rows(want))))
    return cases.select("id", "category").join(out, "id", "left").withColumn("status", F.coalesce("status", F.lit("skipped")))


def headline(outcomes: DataFrame) -> DataFrame:
    """(metric, value) of an offline run."""
    o = outcomes.where("status <> 'skipped'")
    share = lambda where, what: F.round(F.avg(F.when(where, what.cast("double"))), 4)
    passed, of = F.col("status") == "pass", lambda *c: F.col("category").isin(*c)
    metrics = {
        "retrieval_hit_rate": share(of(*ANSWERED), passed), "abstain_gate_rate": share(of("abstain"), passed), "sql_correct_rate": share(of("aggregation"), F.col("sql_correct")),
        "sql_routed_rate": share(of("aggregation"), F.col("routed")), "routing_rate": share(of(*ROUTED), passed), "mrr": F.round(F.avg(F.when(of(*ANSWERED), F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 4),
    }
    return o.agg(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items())).alias("m")).select(F.inline("m"))
