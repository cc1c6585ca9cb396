"""Evaluation: set scores, ranked-retrieval metrics, resolution pairs, answers, and sweeps over settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.frames import apart, stacked
from loomgraph.functions.text import clamp5, key_fact_recall, lexical_f1, safe_json


def _over(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _over(tp, tp + fp), _over(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), _over(2 * p * r, p + r).alias("f1")]


def set_counts(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row of tp, fp, fn of two sets of rows."""
    rows = stacked(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1)), allow_missing=True)
    flags = rows.groupBy(*keys).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    return flags.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def set_prf(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    return set_counts(predicted, gold, keys).select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def first_occurrences(ranked: DataFrame, item: str) -> DataFrame:
    """query_id, item, rank: each item once, where it first stands, ranks closed up."""
    firsts = ranked.groupBy("query_id", item).agg(F.min("rank").alias("rank"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked (query_id, item, rank) with rel; relevant: query_id, item."""
    return ranked.join(relevant.select("query_id", "item").distinct().withColumn("rel", F.lit(1)), ["query_id", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def relevant_sizes(relevant: DataFrame) -> DataFrame:
    """query_id and n_rel, the number of its relevant items."""
    return relevant.select("query_id", "item").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """One row for each query that has relevant items or hits: precision, recall, rr, hit, r_precision, ap, ndcg.

    ranked: query_id, item, rank (each item once); relevant: query_id, item. Precision divides by what was retrieved
    within k; a query without hits scores 0 everywhere. sizes (query_id, n_rel): how many items are relevant, where these are known
    without listing them; relevant then needs to hold those among ranked only.
    """
    sizes = relevant_sizes(relevant) if sizes is None else sizes
    rows = judged(ranked, relevant).join(sizes, "query_id", "full")
    n_rel = F.coalesce("n_rel", F.lit(0))
    running = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("n_rel", n_rel).withColumn("hits", running)
    inside = F.col("rank") <= k
    rel = F.col("rel") == 1
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    at_r = F.col("rank") <= F.col("n_rel")
    grouped = rows.groupBy("query_id").agg(
        F.max("n_rel").alias("n_rel"),
        F.count_if(inside).alias("got"),
        F.count_if(inside & rel).alias("good"),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
        F.count_if(at_r).alias("got_r"),
        F.count_if(at_r & rel).alias("good_r"),
        F.sum(F.when(rel, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.when(inside & rel, gain).otherwise(0.0)).alias("dcg"),
    )
    top = F.least(F.col("n_rel"), F.lit(k)).cast("int")
    ideal = F.when(top > 0, F.aggregate(F.sequence(F.lit(1), top), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(0.0)
    return grouped.select(
        "query_id",
        _over(F.col("good"), F.col("got")).alias("precision"),
        _over(F.col("good"), F.col("n_rel")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.col("good") > 0).cast("double").alias("hit"),
        _over(F.col("good_r"), F.col("got_r")).alias("r_precision"),
        _over(F.col("ap"), F.col("n_rel")).alias("ap"),
        _over(F.col("dcg"), ideal).alias("ndcg"),
    )


METRICS = ["precision", "recall", "rr", "hit", "r_precision", "ap", "ndcg"]


def means(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over queries, 0 without any."""
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS if m in metrics.columns])


def gold_items(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """relevant (query_id, item) where an item that is the uri of one of the query's hits becomes its title."""
    titles = hits.groupBy("query_id", F.col("uri").alias("item")).agg(F.max_by("title", "rank").alias("title"))
    return relevant.join(titles, ["query_id", "item"], "left").select("query_id", F.coalesce("title", "item").alias("item")).distinct()


def pairwise_prf(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of clusters (name, cluster) against pairs (a, b, should_merge)."""
    side = lambda p: clusters.select(F.col("name").alias(p), F.col("cluster").alias(f"c{p}"))
    rows = pairs.join(apart(side("a")), "a", "left").join(apart(side("b")), "b", "left")
    merged = F.coalesce("ca", "a") == F.coalesce("cb", "b")
    counts = rows.agg(F.count_if(F.col("should_merge") & merged).alias("tp"), F.count_if(~F.col("should_merge") & merged).alias("fp"), F.count_if(F.col("should_merge") & ~merged).alias("fn"))
    return counts.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def sweep(hits: DataFrame, relevant: DataFrame, grid: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """Means of the metrics for every setting of grid (graph_boost, title_boost, top_k), from one retrieval.

    hits: query_id, item, base (fused score), g and t (boosts at weight 1), rank. All settings of grid are evaluated in one
    job; a grid of up to 10,000 is broadcast, a larger one is joined without. Relevant items are counted once and only those among the
    hits are taken along to the settings; sizes: as in retrieval_metrics.
    """
    few = grid.limit(10_001).count() <= 10_000
    rows = hits.join(F.broadcast(grid) if few else grid, F.col("rank") <= F.col("top_k"))
    setting = ["graph_boost", "title_boost", "top_k"]
    score = F.round(F.col("base") * (1 + F.col("graph_boost") * F.col("g") + F.col("title_boost") * F.col("t")), 12)
    case = F.concat_ws("|", *setting, "query_id")
    order = Window.partitionBy(case).orderBy(F.desc(score), "rank")
    ranked = rows.withColumn("case", case).withColumn("_r", F.row_number().over(order))
    cases = ranked.select("case", *setting, "query_id").distinct()
    sizes = relevant_sizes(relevant) if sizes is None else sizes
    relevant = relevant.join(hits.select("query_id", "item").distinct(), ["query_id", "item"], "left_semi")
    rel = cases.join(relevant, "query_id").select(F.col("case").alias("query_id"), "item")
    sizes = cases.join(sizes, "query_id").select(F.col("case").alias("query_id"), "n_rel")
    items = first_occurrences(ranked.select(F.col("case").alias("query_id"), "item", F.col("_r").alias("rank")), "item")
    scored = retrieval_metrics(items, rel, k, sizes).withColumnRenamed("query_id", "case").join(cases, "case")
    return means(scored, setting)


def compare(metrics: DataFrame, run: str, first: str) -> DataFrame:
    """Means for each run and their differences from the first run."""
    rows = means(metrics, [run])
    base = rows.where(F.col(run) == first).select(*[F.col(m).alias(f"_{m}") for m in METRICS])
    return rows.join(F.broadcast(base.limit(1)), how="left").select(run, "n", *METRICS, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in METRICS])


def grade_answers(answers: DataFrame, judgement: str | None = None, threshold: float = 0.6) -> DataFrame:
    """Scores of answers (generated, expected, key_facts, n_citations, uncited) with an optional column of judge output.

    Where the judge says nothing readable, or there is no reference answer, the scores come from the lexical ones.
    """
    f1, kfr = lexical_f1("generated", "expected"), key_fact_recall("generated", "key_facts", threshold)
    rows = answers.withColumn("lexical_f1", f1).withColumn("key_fact_recall", kfr)
    rows = rows.withColumn("grounded", ~F.col("uncited") & (F.col("n_citations") > 0))
    correct = F.round(5.0 * F.col("lexical_f1"), 2)
    complete = F.round(5.0 * (0.5 * F.col("lexical_f1") + 0.5 * F.col("key_fact_recall")), 2)
    reason = F.lit("scored by shared words; no judge spoke")
    told = F.lit(False)
    if judgement:
        data = safe_json(judgement)
        get = lambda f: F.try_variant_get(data, f"$.{f}", "string")
        told = (F.col("expected") != "") & (get("correct").isNotNull() | get("complete").isNotNull())
        correct = F.when(told, clamp5(F.coalesce(get("correct"), F.lit("0")))).otherwise(correct)
        complete = F.when(told, clamp5(F.coalesce(get("complete"), F.lit("0")))).otherwise(complete)
        reason = F.when(told, F.left(F.coalesce(get("reason"), F.lit("")), F.lit(200))).otherwise(reason)
    return rows.withColumn("judge_correct", correct).withColumn("judge_complete", complete).withColumn("judge_reason", reason).withColumn("judged", told)


def answer_report(graded: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c)
    return graded.agg(F.count("*").alias("n"), mean("judge_correct"), mean("judge_complete"), mean("key_fact_recall"), mean("lexical_f1"), F.coalesce(F.avg(F.col("grounded").cast("int")), F.lit(0.0)).alias("grounded_rate"), F.coalesce(F.bool_or("judged"), F.lit(False)).alias("judged_by_llm"))
