"""Command line: python -m loomgraph.cli --store PATH COMMAND ...

Commands: ingest, ask, search, stats, resolve, reindex, reset, backfill, healthcheck, doctor, eval, eval-answers,
eval-compare, eval-sweep. Each prints lines or a table; exit codes: 0 done, 1 not done, 2 wrong use. Settings come
from LOOMGRAPH_ variables and a .env file.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.frames import stacked
from loomgraph.operators import evaluate
from loomgraph.plans.engine import Engine
from loomgraph.providers import language_model
from loomgraph.sources import loaders


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph", description="A knowledge graph with vector and keyword search on Spark.")
    p.add_argument("--store", default="loomgraph-store", help="folder of the tables")
    p.add_argument("--dim", type=int, help="size of the embeddings, in place of the settings' one")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **options):
        return sub.add_parser(name, **options)

    c = add("ingest", help="load a folder, a file or a saved page")
    c.add_argument("path", nargs="?")
    c.add_argument("--url")
    c.add_argument("--html", help="the saved page of --url, which is not fetched then")
    c.add_argument("--no-resolve", action="store_true")
    c.add_argument("--debug", action="store_true", help="the first error ends the run")
    c.add_argument("-j", "--concurrency", type=int, help="calls of models at once, for each task")
    c.add_argument("--progress", action=argparse.BooleanOptionalAction)
    c = add("backfill", help="correct the spans of stored chunks")
    c.add_argument("path")
    c.add_argument("--dry-run", action="store_true")
    for name in ("ask", "search"):
        c = add(name)
        c.add_argument("question")
        c.add_argument("--top-k", type=int)
        c.add_argument("--hops", type=int)
    for name in ("stats", "resolve", "healthcheck", "doctor"):
        add(name)
    again = add("reindex")
    again.add_argument("--recreate", action="store_true", help="embed every chunk anew")
    again.add_argument("--entities", action="store_true", help="rebuild the index of entity names and aliases, too")
    add("reset").add_argument("--yes", action="store_true")
    c = add("eval")
    c.add_argument("--gold", required=True)
    c.add_argument("--k", type=int, default=6)
    c.add_argument("--use-existing", action="store_true")
    c.add_argument("--show-cases", action="store_true")
    c = add("eval-answers")
    c.add_argument("--questions", required=True)
    c.add_argument("--k", type=int)
    c.add_argument("--show-cases", action="store_true")
    c.add_argument("--no-judge", action="store_true", help="score by shared words alone")
    c.add_argument("--judge-model", help="in place of the answering model")
    c.add_argument("--corpus", help="a folder to ask in place of the store")
    c = add("eval-compare", help="give just one of the three lists, by comma")
    c.add_argument("--gold", required=True)
    c.add_argument("--embed-dims", help="sizes of the embedding")
    c.add_argument("--embed-models")
    c.add_argument("--extract-models")
    c.add_argument("--k", type=int, default=6)
    c = add("eval-sweep")
    c.add_argument("--gold", required=True)
    c.add_argument("--graph-boost", default="0,0.5,1")
    c.add_argument("--title-boost", default="0,0.4")
    c.add_argument("--top-k", default="6")
    c.add_argument("--metric", default="ap", choices=["ap", "ndcg", "r_precision"])
    c.add_argument("--top", type=int, default=10)
    c.add_argument("--k", type=int, default=6)
    return p


def _show(df, limit: int | None = None) -> None:
    """All rows, or the first `limit` where that is asked for; they stream through the driver."""
    for row in (df if limit is None else df.limit(limit)).toLocalIterator():
        print("  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in row.asDict().items()))


def banner(engine: Engine) -> None:
    """Where data will go and who is asked."""
    m = engine.config.models
    print(f"store {engine.store.path}, provider {m.provider}" + (f" at {m.url}" if engine.model else "") + f", embeddings of {m.dimensions or 'any'} numbers")


def _gold(spark, path: str):
    """The gold set's corpus path, and its cases as tables with numbers."""
    gold = loaders.load_gold(spark, path)
    corpus = gold.select("corpus").first()["corpus"]
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    numbered = lambda c, names: gold.select(F.posexplode(c).alias("n", "x")).select(*names)
    retrieval = numbered("retrieval", [F.col("n").alias("query_id"), F.col("x.query").alias("text"), F.col("x.relevant").alias("relevant")])
    extraction = numbered("extraction", [F.col("n").alias("case_id"), "x.text", "x.entities", "x.triples"])
    resolution = numbered("resolution", [F.col("n").alias("case_id"), "x.entities", "x.should_merge", "x.should_not_merge"])
    return os.path.join(base, corpus or "."), retrieval, extraction, resolution


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    config = EngineConfig.from_env()
    if a.dim is not None:
        config = config.with_(models={"dimensions": a.dim})
    if getattr(a, "concurrency", None):
        config = config.with_(models={"calls": max(1, a.concurrency)})
    engine = Engine(spark, a.store, config)
    one = lambda text: spark.createDataFrame([(1, text)], "query_id long, text string")
    if a.command in ("ingest", "reset", "doctor", "eval-answers"):
        banner(engine)
    if a.command == "ingest":
        shown = sys.stderr.isatty() if a.progress is None else a.progress
        options = {"raise_errors": a.debug, "progress": (lambda phase, done, total: print(f"{phase} {done}/{total}", file=sys.stderr)) if shown else None}
        if a.path:
            report = engine.ingest_folder(a.path, not a.no_resolve, **options)
        elif a.url and a.html:
            html = spark.read.text(a.html, wholetext=True).select(F.lit(a.url).alias("url"), F.col("value").alias("html"))
            report = engine.ingest_pages(html, not a.no_resolve, **options)
        elif a.url:
            report = engine.ingest_urls(spark.createDataFrame([(a.url,)], "url string"), not a.no_resolve, **options)
        else:
            print("give a path or --url", file=sys.stderr)
            return 2
        _show(report)
        _show(engine.errors)
        row = report.first()
        if row["documents_failed"] and not row["chunks_written"]:
            print("nothing was written; see doctor, or run again with --debug")
    elif a.command == "backfill":
        _show(engine.backfill(a.path, a.dry_run))
        if a.dry_run:
            print("nothing was written")
    elif a.command == "search":
        hits = engine.search(one(a.question), a.top_k, a.hops).orderBy("rank")
        _show(hits.select("rank", "score", "via", "title", "citation", F.left("chunk_text", F.lit(200)).alias("text")))
    elif a.command == "ask":
        row = engine.ask(one(a.question), a.top_k, a.hops).first()
        print(row["answer"])
        if row["uncited"]:
            print("(the answer cites no source)")
        for c in row["citations"]:
            print(c["marker"], c["title"], c["span"], c["uri"])
        for e in row["edges"][:12]:
            print(f"{e['subject']} -[{e['relation']}]-> {e['object']}")
    elif a.command == "stats":
        _show(engine.stats())
    elif a.command == "resolve":
        _show(engine.resolve().select("duplicate", "canonical", "string_score", "embed_score", "reason"))
    elif a.command == "reindex":
        for name, n in engine.reindex(a.recreate, a.entities).items():
            print(f"{name} rebuilt: {n} rows")
    elif a.command == "reset":
        if not engine.stats().where("value > 0").take(1):
            print("nothing to reset")
        elif a.yes or input("remove everything? [y/N] ").strip().lower().startswith("y"):
            engine.store.clear()
            print("all tables are empty")
        else:
            return 1
    elif a.command == "healthcheck":
        try:
            engine.stats().collect()
            row = engine.extracted(engine.embedded(one("Health Check"), "text", "vector")).first()
            if row["embed_error"] or row["extract_error"]:
                raise RuntimeError(row["embed_error"] or row["extract_error"])
        except Exception as e:
            print(f"not healthy: {e}", file=sys.stderr)
            return 1
        print("healthy")
    elif a.command == "doctor":
        found = engine.doctor()
        _show(engine.stats())
        for k, v in found.items():
            print(f"{k}: {v}")
        return int(bool(found["dim_mismatch"]) or any(found["violations"].values()))
    elif a.command == "eval-answers":
        if "://" not in a.questions and not os.path.exists(a.questions):
            print(f"no such file: {a.questions}", file=sys.stderr)
            return 2
        cases = loaders.load_answers(spark, a.questions).withColumn("query_id", F.monotonically_increasing_id()).withColumnRenamed("query", "text")
        used = engine
        if a.corpus:
            used = Engine(spark, "temporary", config)
            used.ingest_folder(a.corpus)
        judge = None if a.no_judge or used.model is None else language_model(config.with_(models={"answering": a.judge_model or config.models.answering})).complete
        graded = used.eval_answers(cases, judge, a.k)
        if a.show_cases:
            _show(graded.select("text", "judge_correct", "judge_complete", "key_fact_recall", "lexical_f1", "grounded"))
        _show(evaluate.answer_report(graded))
        if judge is None:
            print("no judge was asked: correct and complete follow the shared words")
    else:
        return _evaluate(spark, engine, a)
    return 0


def _evaluate(spark: SparkSession, engine: Engine, a) -> int:
    corpus, retrieval, extraction, resolution = _gold(spark, a.gold)

    def fresh(**models) -> Engine:
        """An engine of its own over the gold set's corpus."""
        own = Engine(spark, "temporary", engine.config.with_(models=models))
        own.ingest_folder(corpus)
        return own

    if a.command == "eval":
        used = engine if a.use_existing else fresh()
        metrics = used.eval_retrieval(retrieval, a.k)
        if a.show_cases:
            _show(metrics.orderBy("query_id"))
        _show(evaluate.means(metrics))
        _show(used.eval_extraction(extraction))
        _show(used.eval_resolution(resolution))
    elif a.command == "eval-compare":
        lists = {"dimensions": a.embed_dims, "embedding": a.embed_models, "extraction": a.extract_models}
        told = {k: [x.strip() for x in v.split(",") if x.strip()] for k, v in lists.items() if v}
        if len(told) != 1:
            print("give just one of --embed-dims, --embed-models and --extract-models", file=sys.stderr)
            return 2
        (what, values), parts = next(iter(told.items())), None
        for v in values:
            # another embedding model may have another size
            used = fresh(**{what: int(v) if what == "dimensions" else v}, **({"dimensions": 0} if what == "embedding" else {}))
            graph = {f"{r['kind']}_f1": r["f1"] for r in used.eval_extraction(extraction).collect()} | {"resolution_f1": used.eval_resolution(resolution).first()["f1"]}
            print(f"{what} {v}: " + "  ".join(f"{k}={x:.4f}" for k, x in sorted(graph.items())))
            own = used.eval_retrieval(retrieval, a.k).withColumn("run", F.lit(v))
            parts = own if parts is None else stacked(parts, own)
        _show(evaluate.compare(parts, "run", values[0]))
    else:
        numbers = lambda s, kind: [kind(x) for x in s.split(",")]
        used = fresh()
        rows = used.eval_sweep(retrieval, numbers(a.graph_boost, float), numbers(a.title_boost, float), numbers(a.top_k, int), a.k)
        _show(rows.orderBy(F.desc(a.metric), "graph_boost", "title_boost", "top_k"), a.top)
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("loomgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
