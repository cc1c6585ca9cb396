"""The engine: ingest, resolve, search, ask and evaluate over a store, for batches of documents and questions."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import providers
from loomgraph.config import EngineConfig
from loomgraph.frames import stacked
from loomgraph.functions.vectors import hash_embedding
from loomgraph.operators import answer, cells, chunking, evaluate, extract, graph, ingest, resolve, retrieve
from loomgraph.plans.store import Change, Conflict, checkpointed, open_store, owner_of
from loomgraph.schemas import TABLES
from loomgraph.sources import loaders

Progress = Callable[[str, int, int], None]
TABLES_OF = {name: [x.strip().split(" ")[0] for x in kind.split(", ")] for name, kind in TABLES.items()}
ERRORS = "document_id string, position int, phase string, error string"


class Engine:
    """A knowledge graph with vector and keyword search, kept in a Store.

    embed is an expression over text or an embedder (embed_one), extractor an expression that gives an extract.EXTRACTION or a language
    model (complete_json). By default both are those of the settings: expressions offline, calls of a server otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, embed=None, extractor=None, seeds: str | None = None):
        self.spark, self.config, self.store = spark, config or EngineConfig(), open_store(spark, path)
        offline = self.config.models.provider == "offline"
        self.embedder = embed or ((lambda text: hash_embedding(text, self.config.models.dimensions)) if offline else providers.embedder(self.config))
        self.extractor = extractor or (extract.heuristic_extraction if offline else providers.language_model(self.config, "extraction"))
        self.model = None if offline else providers.language_model(self.config, "ranking")
        self.seeds = loaders.alias_seeds(spark, seeds or self.config.matching.seeds or None)
        self.errors = spark.createDataFrame([], ERRORS)

    def embedded(self, rows: DataFrame, text: str, out: str, done=None) -> DataFrame:
        """rows with the vector of a text column and `embed_error`; done: an accumulator of finished calls."""
        if hasattr(self.embedder, "embed_one"):
            return providers.with_vectors(rows, text, self.embedder, self.config.models.calls, out, "embed_error", done)
        return rows.withColumn(out, self.embedder(F.col(text))).withColumn("embed_error", F.lit(None).cast("string"))

    def extracted(self, rows: DataFrame, text: str = "text", done=None) -> DataFrame:
        """rows with the EXTRACTION of a text column and `extract_error`; done: an accumulator of finished calls."""
        if hasattr(self.extractor, "complete_json"):
            told = extract.with_answers(rows.withColumn("_prompt", extract.extraction_prompt(text)), "_prompt", self.extractor.complete_json, "_answer", self.config.models.calls, "extract_error", done)
            return told.withColumn("extraction", extract.validated("_answer")).drop("_prompt", "_answer")
        return rows.withColumn("extraction", self.extractor(F.col(text))).withColumn("extract_error", F.lit(None).cast("string"))

    # writing

    def ingest_folder(self, path: str, resolve_after: bool = True, pdf_parser=None, **options) -> DataFrame:
        return self.ingest(loaders.load_path(self.spark, path, pdf_parser), resolve_after, **options)

    def ingest_pages(self, pages: DataFrame, resolve_after: bool = True, **options) -> DataFrame:
        return self.ingest(loaders.load_web(pages), resolve_after, **options)

    def ingest_urls(self, urls: DataFrame, resolve_after: bool = True, fetch: Callable[[str], str] = loaders.fetched, **options) -> DataFrame:
        """Fetches the pages of urls (url) and stores those that came; the others are in errors."""
        pages = checkpointed(loaders.fetch_pages(urls, fetch, self.config.models.calls))
        report = self.ingest_pages(pages.where("error IS NULL"), resolve_after, **options)
        failed = pages.where("error IS NOT NULL").select(F.col("url").alias("document_id"), F.lit(None).cast("int").alias("position"), F.lit("load").alias("phase"), "error")
        self.errors = stacked(self.errors, failed)
        return report.withColumn("documents_failed", F.col("documents_failed") + F.lit(failed.count()))

    def ingest(self, docs: DataFrame, resolve_after: bool = True, raise_errors: bool = False, progress: Progress | None = None, tries: int = 3) -> DataFrame:
        """Stores new and changed documents with their chunks, entities and relations, all in one commit; returns one row of counts.

        A document whose meta has an error is left out, a chunk that cannot be embedded too; one that cannot be extracted is kept
        without entities. These are in `errors` (document_id, position, phase, error) until the next run; raise_errors
        makes the first of them an exception, before anything is written. progress gets (phase, done, total) as phases start and end, and between as tasks
        of model calls finish.
        If another writer has changed the same documents, entities or relations meanwhile, all is done again from what it wrote, up to `tries` times.
        """
        c, store = self.config.chunking, self.store
        tick = progress or (lambda *_: None)
        bad = F.col("meta").isNotNull() & F.map_contains_key(F.col("meta"), "error")
        unread = docs.where(bad).select(F.col("uri").alias("document_id"), F.lit(None).cast("int").alias("position"), F.lit("load").alias("phase"), F.col("meta")["error"].alias("error"))
        clean = checkpointed(ingest.normalized(docs.where(~F.coalesce(bad, F.lit(False))))).withColumn("ord", F.struct("uri", "id"))
        old = store.tables()
        status = checkpointed(ingest.dedupe_status(clean, old["documents"], "ord"))
        fresh = status.where("status <> 'duplicate'")
        last = fresh.groupBy("id").agg(F.max_by(F.struct(*[x for x in fresh.columns if x != "id"]), "version").alias("r")).select("id", "r.*")
        last = checkpointed(last)
        chunks = checkpointed(chunking.chunk_documents(last, c.characters, c.overlap))
        total = chunks.count()
        model = getattr(self.embedder, "model", "engine")
        with self._watched("embed", total, progress) as (spread, done):
            rows = self.embedded(spread(chunks), "text", "embedding", done)
            chunks = checkpointed(rows.withColumn("embed_model", F.lit(model)).withColumn("embed_dim", F.size("embedding")))
        written = chunks.where("embed_error IS NULL")
        kept = written.count()
        with self._watched("extract", kept, progress) as (spread, done):
            written = checkpointed(self.extracted(spread(written), done=done))
        place = lambda phase, e: (F.col("document_id"), F.col("position"), F.lit(phase).alias("phase"), F.col(e).alias("error"))
        errors = stacked(unread, chunks.where("embed_error IS NOT NULL").select(*place("embed", "embed_error")), written.where("extract_error IS NOT NULL").select(*place("extract", "extract_error")))
        self.errors = checkpointed(errors)
        if raise_errors and (first := self.errors.orderBy("document_id", "position").first()):
            raise RuntimeError(f"{first['phase']} of {first['document_id']}, chunk {first['position']}: {first['error']}")
        rows, calls, relations = extract.graph_rows(written.withColumn("ord", F.struct("document_id", "position")))
        # a part of each table: its rows come in the place of those of the same documents, names or relations
        gone = last.select(F.col("id").alias("owner"))
        names = rows.select("name").distinct()
        known = old["entities"].join(names, "name", "left_semi")
        base = old["entities"].agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m")).first()["m"]
        named = ingest.upsert_entities(rows).withColumn("ord", F.struct("ord", "name"))
        counts = calls.groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("mention_count"))
        numbered = self._numbered(named, base)
        both = stacked(known.select("name", "label", "aliases", "summary", "ord"), numbered.select("name", "label", "aliases", "summary", "ord"))
        merged = ingest.upsert_entities(both)
        mentioned = stacked(known.select("name", "mention_count"), counts).groupBy("name").agg(F.sum("mention_count").alias("mention_count"))
        links = last.select(F.col("id").alias("document_id"), F.explode("links").alias("dst_uri"))
        new = {
            "documents": Change(last.select(*TABLES_OF["documents"])),
            "chunks": Change(written.select(*TABLES_OF["chunks"]), gone),
            "chunk_tokens": Change(retrieve.postings(written), gone),
            "mentions": Change(calls.distinct(), gone),
            "relations": Change(relations.distinct()),
            "doc_links": Change(links.distinct()),
            "entities": Change(merged.join(mentioned, "name", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))),
            "entity_tokens": Change(graph.entity_tokens(merged), names.withColumnRenamed("name", "owner")),
        }
        centres = cells.stored(old["centroids"])
        if centres is not None:
            new["vector_cells"] = Change(cells.assigned(written, centres), gone)
        if last.take(1):
            try:
                store.commit(new, old)
            except Conflict:
                if tries < 2:
                    raise
                return self.ingest(docs, resolve_after, raise_errors, progress, tries - 1)
        tick("write", kept, kept)
        merges = self.resolve().count() if resolve_after else 0
        failed = {r["phase"]: r["n"] for r in self.errors.groupBy("phase").agg(F.count("*").alias("n")).collect()}
        sizes = written.agg(F.coalesce(F.sum(F.size("extraction.entities")), F.lit(0)).alias("e"), F.coalesce(F.sum(F.size("extraction.relations")), F.lit(0)).alias("r")).first()
        own = {"documents_failed": failed.get("load", 0), "chunks_written": kept, "chunks_failed": failed.get("embed", 0), "extractions_failed": failed.get("extract", 0), "entities_extracted": sizes["e"], "relations_extracted": sizes["r"], "merges": merges}
        return ingest.ingest_report(status).withColumns({k: F.lit(v).cast("long") for k, v in own.items()})

    @contextlib.contextmanager
    def _watched(self, phase: str, total: int, progress: Progress | None):
        """Tells progress of a phase from a thread while its job runs; gives what spreads rows over tasks, and the accumulator they count in."""
        if progress is None:
            yield (lambda rows: rows), None
            return
        done, over, told = self.spark.sparkContext.accumulator(0), threading.Event(), [0]
        progress(phase, 0, total)

        def watch() -> None:
            while not over.wait(0.1):
                # a task that is run again counts again
                now = min(done.value, total - 1)
                if now > told[0]:
                    told[0] = now
                    progress(phase, now, total)

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            # tasks of few calls each, as a task tells its count when it ends
            yield (lambda rows: rows.repartition(max(1, min(total, 4 * self.spark.sparkContext.defaultParallelism)))), done
        finally:
            over.set()
            watcher.join()
        progress(phase, total, total)

    def reindex(self, recreate: bool = False, entities: bool = False) -> dict[str, int]:
        """Rebuilds the token index from the chunks; entities (or recreate) that of entity names and aliases, too; recreate also embeds every chunk anew with the present settings; where the settings name
        a share, the vector index is learned anew. Counts of all tables rebuilt."""
        chunks = self.store.table("chunks")
        new = {"chunk_tokens": retrieve.postings(chunks)}
        if entities or recreate:
            new["entity_tokens"] = graph.entity_tokens(self.store.table("entities"))
        if recreate:
            fresh = checkpointed(self.embedded(chunks.drop("embedding", "embed_model", "embed_dim"), "text", "embedding"))
            new["chunks"] = chunks = fresh.withColumn("embed_model", F.lit(getattr(self.embedder, "model", "engine"))).withColumn("embed_dim", F.size("embedding"))
        if self.config.retrieval.share > 0:
            centres = cells.learned(chunks.select("id", "embedding"))
            new |= {"centroids": centres.table(self.spark), "vector_cells": cells.assigned(chunks, centres)}
        # a commit of whole tables leaves one part of each, which says how many rows it has
        now = self.store.snapshot(self.store.commit(new))
        return {name: sum(part["rows"] for part in now.parts.get(name, [])) for name in new}

    def backfill(self, path: str, dry_run: bool = False, pdf_parser=None) -> DataFrame:
        """Chunks the sources at path anew and corrects the spans of stored chunks whose document has not changed; counts by outcome."""
        t, c = self.store.tables(), self.config.chunking
        chunks, counts = ingest.backfill_spans(t["documents"], t["chunks"], loaders.load_path(self.spark, path, pdf_parser), c.characters, c.overlap)
        counts = checkpointed(counts)
        if not dry_run:
            self.store.commit({"chunks": chunks})
        return counts

    def _numbered(self, rows: DataFrame, base: int) -> DataFrame:
        """ord as a number after base, by one range sort: the place in the partition after the sizes of those before it."""
        ranged = checkpointed(rows.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)))
        sizes = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect())  # one row per partition
        starts, at = [], base + 1
        for p, n in sizes:
            starts.append((p, at))
            at += n
        table = self.spark.createDataFrame(starts or [(0, 0)], "_p int, _s long")
        return ranged.join(F.broadcast(table), "_p").withColumn("ord", F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")

    def _settled(self, pairs: DataFrame) -> DataFrame:
        """pairs (a_name, b_name) with `same`, as the settings' model says; a call that fails settles nothing, and the pair stays apart."""
        prompt = F.concat(F.lit("Do these two names stand for one and the same thing? Reply with yes or no.\n\n1. "), F.col("a_name"), F.lit("\n2. "), F.col("b_name"))
        told = extract.with_answers(pairs.withColumn("_prompt", prompt), "_prompt", self.model.complete, "_answer", self.config.models.calls, "_error")
        return checkpointed(told.withColumn("same", F.coalesce(F.lower(F.trim("_answer")).startswith("y"), F.lit(False))).drop("_prompt", "_answer", "_error"))

    def resolve(self, same: Column | Callable[[DataFrame], DataFrame] | None = None, use_embeddings: bool = True) -> DataFrame:
        """Merges entities that are the same; returns the decisions.

        same: what settles ambiguous pairs (see resolve.plan); by default the settings' model, where there is one.
        """
        t = self.store.tables()
        embeddings = None
        if use_embeddings:
            names = resolve.names_to_embed(t["entities"], self.config.matching.similarity, self.config.matching.edits)
            embeddings = resolve.context_embeddings(t["mentions"], t["chunks"], names)
        if same is None and self.model is not None:
            same = self._settled
        decisions = checkpointed(resolve.plan(t["entities"], self.seeds, embeddings, self.config, same))
        if not decisions.take(1):
            return decisions
        roots = checkpointed(resolve.merge_roots(decisions))
        # only what the merged names touch is read on and written: their entities, the mentions of their documents, their relations
        merged = roots.select(F.col("duplicate").alias("name"))
        touched = stacked(merged, roots.select(F.col("root").alias("name"))).distinct()
        documents = t["mentions"].join(merged.withColumnRenamed("name", "entity"), "entity", "left_semi").select(owner_of("mentions").alias("owner")).distinct()
        mentions = t["mentions"].withColumn("owner", owner_of("mentions")).join(documents, "owner", "left_semi").drop("owner")
        ends = [t["relations"].join(merged.withColumnRenamed("name", end), end, "left_semi").select("subject", "relation", "object") for end in ("subject", "object")]
        relations = stacked(*ends).distinct()
        new_entities, new_mentions, new_relations = ingest.merge_entities(t["entities"].join(touched, "name", "left_semi"), mentions, relations, roots)
        base = t["merge_history"].agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
        history = self._numbered(decisions.select("duplicate", "canonical", "ord"), base).select(F.col("ord").alias("seq"), "duplicate", "canonical")
        self.store.commit(
            {
                "entities": Change(new_entities, merged.withColumnRenamed("name", "owner")),
                "entity_tokens": Change(graph.entity_tokens(new_entities), touched.withColumnRenamed("name", "owner")),
                "mentions": Change(new_mentions, documents),
                "relations": Change(new_relations, relations.select(owner_of("relations").alias("owner"))),
                "merge_history": Change(history),
            },
            t,
        )
        return decisions

    # reading

    def search(self, queries: DataFrame, top_k: int | None = None, hops: int | None = None, complete: Callable[[str], str] | None = None) -> DataFrame:
        """Ranked hits of queries (query_id, text): query_id, rank, id, score, via, title, uri, citation, chunk_text.

        complete: a model for query expansion and reranking, where the settings turn these on.
        """
        c = self.config.retrieval
        k, hops = top_k or c.hits, c.hops if hops is None else hops
        complete = complete or (self.model.complete if self.model else None)
        t = self.store.tables()
        asked = queries.select("query_id", "text")
        if c.expand and complete:
            asked = checkpointed(retrieve.expanded(asked, complete, c.extra_terms))  # the model is asked once
        else:
            asked = asked.withColumn("search_text", F.col("text"))
        vectors = self.embedded(asked.select("query_id", "search_text"), "search_text", "vector").select("query_id", "vector")
        by_vector = self._nearest(vectors, t, k)
        by_text = retrieve.pruned_topk(asked.select("query_id", F.col("search_text").alias("text")), t["chunk_tokens"], k)
        fused = checkpointed(retrieve.rrf_fuse({"vector": by_vector, "fulltext": by_text}, k, c.fusion))  # at most k rows for each query
        rows = retrieve.with_documents(fused, t["chunks"], t["documents"]).join(queries.select("query_id", "text"), "query_id").withColumn("label", F.col("span.label"))
        boosts = None
        if c.graph_weight > 0:
            seeds = self._seeds(queries, t).select("query_id", F.col("name").alias("node"))
            mentions = checkpointed(retrieve.mentions_of(fused, t["mentions"]))
            _, nodes = graph.expand(t["relations"], seeds, hops, retrieve.nodes_of(fused, mentions))
            boosts = retrieve.graph_factor(fused, mentions, nodes, c.graph_weight, c.neighbour_share)
        out = retrieve.rescore(rows, boosts, c.graph_weight, c.title_weight)
        if c.rank and complete:
            out = retrieve.rerank(out.withColumn("query", F.col("text")).withColumn("text", F.col("chunk_text")), complete, c.passages, c.snippet)
        return out.select("query_id", "rank", "id", "score", "via", "document_id", "title", "uri", "span", "citation", "chunk_text")

    def _seeds(self, queries: DataFrame, t) -> DataFrame:
        """Entities that queries name, by the stored index; a store of before that index is read from its entities until a reindex."""
        index = t["entity_tokens"] if t.parts.get("entity_tokens") else None
        return graph.match_entities(queries, t["entities"], self.config.retrieval.hits, index=index)

    def keyword_search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """query_id, id, score and rank by BM25 over the stored postings; they need a reindex where they were written without counts."""
        return retrieve.bm25_stored(queries, self.store.table("chunk_tokens"), top_k or self.config.retrieval.hits)

    def _nearest(self, vectors: DataFrame, t, k: int) -> DataFrame:
        """The nearest chunks of vectors: by the stored index where the settings name a share and it was built, else by an exact search."""
        share = self.config.retrieval.share
        centres = cells.stored(t["centroids"]) if share > 0 else None
        if centres is None:
            return retrieve.vector_topk(vectors, t["chunks"].select("id", "embedding"), k)
        return cells.cells_topk(vectors, t["vector_cells"], centres, k, share)

    def retrieve(self, queries: DataFrame, top_k: int | None = None, hops: int | None = None, complete: Callable[[str], str] | None = None) -> DataFrame:
        """Context bundles: chunks, edges and entities for each query."""
        hops = self.config.retrieval.hops if hops is None else hops
        hits = checkpointed(self.search(queries, top_k, hops, complete))
        t = self.store.tables()
        seeds = hits.select("query_id", F.col("id").alias("chunk_id")).join(t["mentions"], "chunk_id").select("query_id", F.col("entity").alias("node")).distinct()
        edges, nodes = graph.expand(t["relations"], seeds, hops)
        return answer.bundles(queries, hits, edges, nodes)

    def ask(self, queries: DataFrame, top_k: int | None = None, hops: int | None = None, answerer: Column | None = None) -> DataFrame:
        """Bundles with prompt, answer, citations and uncited; answerer: an expression over `prompt`, by default the settings' model."""
        limit, found = self.config.retrieval.prompt_relations, self.retrieve(queries, top_k, hops)
        if answerer is None and self.model is not None:
            prompts = found.withColumn("prompt", answer.answer_prompt("text", "chunks", "edges", limit))
            told = extract.with_answers(prompts, "prompt", providers.language_model(self.config).complete, "told", self.config.models.calls)
            return answer.synthesize(told, F.coalesce("told", "error"), limit).drop("told", "error")
        return answer.synthesize(found, answerer, limit)

    def documents_by_uri(self, uris: DataFrame) -> DataFrame:
        """The stored documents of uris (uri)."""
        return ingest.by_uri(self.store.table("documents"), uris)

    def stats(self) -> DataFrame:
        return self.store.stats()

    def doctor(self) -> dict[str, object]:
        """Whether the tables can be read, keys that stand twice, and embeddings of another size than the settings say."""
        dims = [r["embed_dim"] for r in self.store.table("chunks").where("embed_dim IS NOT NULL").select("embed_dim").distinct().limit(10).collect()]
        return {"violations": self.store.violations(), "embed_dims": sorted(dims), "dim_mismatch": any(d != (self.config.models.dimensions or 256) for d in dims), "indexed": bool(self.store.parts("chunk_tokens"))}

    # evaluation

    def eval_retrieval(self, cases: DataFrame, k: int) -> DataFrame:
        """Metrics for each case (query_id, text, relevant: titles or uris)."""
        hits = checkpointed(self.search(cases.select("query_id", "text"), k))
        relevant = evaluate.gold_items(hits, cases.select("query_id", F.explode("relevant").alias("item")))
        items = evaluate.first_occurrences(hits.withColumn("item", F.col("title")), "item")
        return evaluate.retrieval_metrics(items, relevant, k)

    def eval_extraction(self, cases: DataFrame) -> DataFrame:
        """Micro scores of entities and of triples over cases (case_id, text, entities, triples): two rows."""
        rows = checkpointed(self.extracted(cases).withColumnRenamed("extraction", "x"))
        ents = evaluate.set_prf(rows.select("case_id", F.explode("x.entities").alias("e")).select("case_id", "e.name", "e.label"), rows.select("case_id", F.explode("entities").alias("e")).select("case_id", F.col("e")[0].alias("name"), F.col("e")[1].alias("label")), ["case_id", "name", "label"])
        keys = ["case_id", "subject", "relation", "object"]
        got = rows.select("case_id", F.explode("x.relations").alias("r")).select("case_id", "r.subject", F.upper("r.relation").alias("relation"), "r.object")
        gold = rows.select("case_id", F.explode("triples").alias("t")).select("case_id", F.col("t")[0].alias("subject"), F.upper(F.col("t")[1]).alias("relation"), F.col("t")[2].alias("object"))
        return stacked(ents.withColumn("kind", F.lit("entities")), evaluate.set_prf(got, gold, keys).withColumn("kind", F.lit("triples")))

    def eval_resolution(self, cases: DataFrame) -> DataFrame:
        """Micro scores over cases (case_id, entities, should_merge, should_not_merge), all cases in one run, by strings alone."""
        rows = cases.select("case_id", F.posexplode("entities").alias("ord", "e")).select("case_id", "ord", F.col("e")[0].alias("name"), F.col("e")[1].alias("label"))
        own = rows.groupBy("case_id", "name").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"), F.count("*").alias("mention_count"))
        # names are compared and seeded as they are, inside their case; the case's key goes in front of them for the merge roots
        tag = lambda c: F.concat_ws("|", F.col("case_id").cast("string"), c)
        pairs = lambda c, flag: cases.select("case_id", F.explode(c).alias("p")).select(tag(F.col("p")[0]).alias("a"), tag(F.col("p")[1]).alias("b"), F.lit(flag).alias("should_merge"))
        decisions = checkpointed(resolve.plan(own, self.seeds, None, self.config, by=["case_id"]))
        tagged = decisions.select(tag(F.col("duplicate")).alias("duplicate"), tag(F.col("canonical")).alias("canonical"), "ord")
        found = resolve.clusters(own.select(tag(F.col("name")).alias("name")), resolve.merge_roots(tagged))
        return evaluate.pairwise_prf(found, stacked(pairs("should_merge", True), pairs("should_not_merge", False)))

    def eval_answers(self, questions: DataFrame, judge: Callable[[str], str] | None = None, k: int | None = None) -> DataFrame:
        """Graded answers to questions (query_id, text, expected, key_facts)."""
        answers = self.ask(questions.select("query_id", "text"), k).select("query_id", F.col("answer").alias("generated"), F.size("citations").alias("n_citations"), "uncited")
        rows = answers.join(questions, "query_id")
        if judge is None:
            return evaluate.grade_answers(rows, threshold=self.config.fact_share)
        ask = "\n\nHow well does the given answer agree with the model answer? Reply with a JSON object of correct and complete (whole numbers from 0 to 5), grounded (true or false) and reason (one sentence)."
        prompt = F.concat(F.lit("Question:\n"), F.col("text"), F.lit("\n\nModel answer:\n"), F.col("expected"), F.lit("\n\nGiven answer:\n"), F.col("generated"), F.lit(ask))
        judged = extract.with_answers(rows.withColumn("prompt", prompt), "prompt", judge, "judgement")
        return evaluate.grade_answers(judged, "judgement", self.config.fact_share)

    def eval_sweep(self, cases: DataFrame, graph_boosts: Sequence[float], title_boosts: Sequence[float], top_ks: Sequence[int], k: int) -> DataFrame:
        """Metric means for every combination of settings from one retrieval."""
        t = self.store.tables()
        asked = cases.select("query_id", "text")
        vectors = self.embedded(asked, "text", "vector").select("query_id", "vector")
        fused = []
        for top in sorted(set(top_ks)):
            by_vector = retrieve.vector_topk(vectors, t["chunks"].select("id", "embedding"), top)
            by_text = retrieve.fulltext_topk(asked, t["chunk_tokens"], top)
            fused.append(retrieve.rrf_fuse({"vector": by_vector, "fulltext": by_text}, top, self.config.retrieval.fusion).withColumn("top", F.lit(top)))
        grid = self.spark.createDataFrame([(float(g), float(b), int(n)) for g in graph_boosts for b in title_boosts for n in top_ks], "graph_boost double, title_boost double, top_k int")
        seeds = self._seeds(asked, t).select("query_id", F.col("name").alias("node"))
        _, nodes = graph.expand(t["relations"], seeds, self.config.retrieval.hops)
        out = None
        for top, hits in zip(sorted(set(top_ks)), fused, strict=True):
            rows = retrieve.with_documents(hits, t["chunks"], t["documents"]).join(asked, "query_id")
            boosts = retrieve.graph_factor(hits, t["mentions"], nodes, 1.0, self.config.retrieval.neighbour_share)
            rows = rows.join(boosts, ["query_id", "id"], "left").select("query_id", F.col("title").alias("item"), F.col("score").alias("base"), F.coalesce("boost", F.lit(0.0)).alias("g"), retrieve.title_factor(F.col("text"), F.col("title"), F.col("span.label"), 1.0).alias("t"), "rank")
            part = evaluate.sweep(rows, cases.select("query_id", F.explode("relevant").alias("item")), grid.where(F.col("top_k") == top), k)
            out = part if out is None else stacked(out, part)
        return out
