"""One object with the operators under their everyday names; every method gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.functions import vectors
from hyperloom.operators import answers, browse, counterfactual, entities, gaps, graph, ingest, search
from hyperloom.policy import Session
from hyperloom.sources import readers
from hyperloom.sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, store: Store, session: Session, dim: int = vectors.FULL, semantic: bool = True):
        self.spark, self.store, self.session, self.dim, self.semantic = spark, store, session, dim, semantic

    def _all(self) -> DataFrame:
        found = self.store.load("experiments")
        return found if found is not None else self.spark.createDataFrame([], schema.EXPERIMENT)

    def _visible(self) -> DataFrame:
        return entities.visible(self._all(), not self.session.sees_sensitive)

    def ingest(self, experiments: DataFrame) -> str:
        """Encodes and stores experiments; those of a known id are replaced."""
        self.session.require("ingest")
        version = self.store.upsert("experiments", experiments)
        self.store.upsert("encoded", search.encode_experiments(experiments, self.dim, self.semantic))
        self.store.append_audit(self.session.username, self.session.role, "ingest", version)
        return version

    def experiments_page(self, limit: int, skip: int = 0) -> tuple[DataFrame, int]:
        """A page, and the number of all."""
        return self.experiments(limit, skip), self._visible().count()

    def experiments(self, limit: int | None = None, skip: int = 0) -> DataFrame:
        """A page if a limit is given; without one, all, and skip is ignored."""
        self.session.require("experiments")
        rows = self._visible().orderBy("ord", "id")
        return rows if limit is None else rows.offset(skip).limit(limit)

    def browse(self, geography: str | None = None, year: int | None = None, words: str = "", public_only: bool = False) -> DataFrame:
        self.session.require("experiments")
        return browse.corpus_page(self._visible(), public_only, geography, year, words).orderBy("ord", "id")

    def options(self) -> DataFrame:
        self.session.require("experiments")
        return browse.options(self._visible())

    def documents(self) -> DataFrame:
        self.session.require("documents")
        return entities.documents_rollup(self._visible(), "ord")

    def statistics(self) -> DataFrame:
        self.session.require("statistics")
        return entities.coverage(self._visible())

    def total(self) -> int:
        """How many experiments may be seen."""
        self.session.require("statistics")
        return self._visible().count()

    def parse(self, question: str) -> DataFrame:
        """type, value: the entities that a question names."""
        return search.parse(question, entities.entities(self._all()))

    def _ranked(self, query: DataFrame | str, size: int, f: schema.SearchFilter) -> tuple[DataFrame, DataFrame, int]:
        """(the best `size` hits with rank and hybrid score, the gate's verdict in one row, the number of all hits)."""
        wanted = search.sanitize((self.parse(query) if isinstance(query, str) else query).withColumn("pos", F.monotonically_increasing_id())).select("pos", "type", "value")
        rows = [(r.type, r.value) for r in wanted.orderBy("pos").collect()]  # a question's few entities
        self.store.append_audit(self.session.username, self.session.role, "search", str(rows))
        few, encoded = self.spark.createDataFrame(rows, "type string, value string"), self.store.load("encoded")
        seen = search.metadata_filter(self._visible(), f)
        if not rows or encoded is None:
            scored, total = seen.limit(0).withColumns({"similarity": F.lit(0.0), "rank": F.lit(1), "overlap": F.lit(0.0), "hits": F.lit(0)}), 0
        else:
            best = search.search(encoded, seen, few, size, dim=self.dim, semantic=self.semantic)
            total = seen.join(encoded.select("id"), "id", "left_semi").count()
            keys = search.query_keys(few).first().query_keys
            overlap = search.entity_overlap(F.array(*map(F.lit, keys)), search.own_keys())
            rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))  # of the best hits alone
            scored = best.withColumns({"rank": rank, "overlap": overlap, "hits": F.lit(total)})
        verdict = search.gate(search.scope_signals(few).crossJoin(search.confidence_signals(scored)))
        return search.rerank(scored.drop("hits", "overlap"), few, search.graph_flags(graph.edges(scored), scored)), verdict, total

    def gate(self, query: DataFrame | str, f: schema.SearchFilter = schema.SearchFilter()) -> DataFrame:
        """One row: whether the query's hits are evidence, the signals, and why not."""
        self.session.require("search")
        return self._ranked(query, search.POOL, f)[1]

    def search(self, query: DataFrame | str, limit: int = 5, f: schema.SearchFilter = schema.SearchFilter(), skip: int = 0) -> DataFrame:
        """A page of the most similar experiments, reranked; none if the gate finds no evidence."""
        return self.search_page(query, limit, f, skip)[0]

    def search_page(self, query: DataFrame | str, limit: int = 5, f: schema.SearchFilter = schema.SearchFilter(), skip: int = 0) -> tuple[DataFrame, int]:
        """The page, and the number of all hits (0 if the gate finds no evidence)."""
        self.session.require("search")
        ranked, verdict, total = self._ranked(query, max(search.POOL, skip + limit), f)
        if verdict.first().should_empty:
            return ranked.limit(0), 0
        return (ranked.offset(skip) if skip else ranked).limit(limit), total

    def answer(self, query: DataFrame | str, f: schema.SearchFilter = schema.SearchFilter()) -> DataFrame:
        """One row: what an answer is written from, and the answer that is given without a model."""
        self.session.require("reason")
        hits = self.search(query, search.POOL, f)
        top = [r.id for r in hits.orderBy("rank").limit(1).collect()]
        every = self._all()
        told = answers.effect_texts(pairs := counterfactual.for_target(every, top[0] if top else ""), counterfactual.effects(pairs, every))
        return answers.synthesis(hits, answers.counterfactual_lines(told), answers.graph_lines(graph.expand(graph.edges(hits), hits.select("id"))))

    def reason(self, experiment_id: str) -> DataFrame:
        """id, other, text: what differs between an experiment and those that share all its inputs but one."""
        self.session.require("reason")
        self.store.append_audit(self.session.username, self.session.role, "reason", experiment_id)
        every = self._all()
        pairs = counterfactual.for_target(every, experiment_id)
        return answers.reasons(answers.effect_texts(pairs, counterfactual.effects(pairs, every)))

    def enrich_gap(self, configuration: list[tuple[str, str]]) -> DataFrame:
        """One row about one combination of values: its gap in words and what its nearest experiments foretell; none if it
        is no gap."""
        self.session.require("enrich_gap")
        told = ", ".join(f"{t}: {v}" for t, v in configuration)
        self.store.append_audit(self.session.username, self.session.role, "enrich_gap", told)
        every, encoded = self._all(), self.store.load("encoded")
        cells = self.spark.createDataFrame([tuple(v for _, v in configuration)], ", ".join(f"d{i} string" for i in range(len(configuration))))
        found = gaps.analyze(every, [t for t, _ in configuration], cells=cells)
        near = gaps.neighbours(every, encoded, cells, [t for t, _ in configuration], self.dim, self.semantic)
        predicted = gaps.extrapolate(near).select(F.format_string("%s: %.1f", "label", "predicted").alias("p")).agg(F.array_sort(F.collect_list("p")).alias("predicted"))
        shown = near.where("rank <= 2").groupBy("rank", "id").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("outputs"))
        values = F.array_join(F.transform(F.filter("input_entities", lambda e: e["type"].isin([t for t, _ in configuration])), lambda e: e["value"]), ", ")
        shown = shown.join(every.select("id", values.alias("inputs")), "id")
        row = found.select(F.lit(told).alias("configuration"), "gap_type", answers.gap_line(F.col("gap_type"), F.col("experiments")).alias("gap")).crossJoin(predicted)
        return row.select("gap_type", "gap", "configuration").join(answers.hypothesis(row, shown), "configuration")

    def ingest_corpus(self, folder: str, categories: list[str] | None = None, skip: int = 0, most: int | None = None, reader=None) -> DataFrame:
        """Reads new chunks of a folder's documents and stores their experiments; outcomes by status."""
        self.session.require("ingest")
        files = readers.in_order(readers.scan_directory(self.spark, folder, categories), categories or [], skip, most)
        self.store.save("outcomes", ingest.process_chunks(readers.document_chunks(files), self._all().select("id"), reader))
        outcomes = self.store.load("outcomes")
        made = ingest.experiments_of(outcomes)
        if made.limit(1).count():
            self.ingest(made)
        return ingest.outcome_counts(outcomes)

    def ingest_status(self) -> DataFrame:
        """status, chunks of the last ingestion; zeros if there was none."""
        self.session.require("ingest")
        found = self.store.load("outcomes")
        return ingest.outcome_counts(found if found is not None else self.spark.createDataFrame([], "status string"))

    def counterfactuals(self, experiment_id: str) -> DataFrame:
        self.session.require("counterfactuals")
        return counterfactual.for_target(self._all(), experiment_id)

    def gaps(self, dimensions: list[str], least: int = 3) -> DataFrame:
        self.session.require("gaps")
        return gaps.prioritized(gaps.analyze(self._all(), dimensions, least), len(dimensions))

    def graph(self, most: int = 50) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the first visible experiments."""
        self.session.require("graph")
        some = self._visible().orderBy("ord", "id").limit(most)
        return graph.nodes(some), graph.edges(some)

    def audit_logs(self) -> DataFrame:
        self.session.require("audit_logs")
        return self.store.audit()

    def new_chunks(self, chunks: DataFrame) -> DataFrame:
        """What an ingestion would work on, without doing it."""
        return ingest.new_rows(chunks, self._all())

    def new_files(self, folder: str, categories: list[str] | None = None, most: int | None = None) -> DataFrame:
        """The files that an ingestion would work on, with their numbers of chunks and new ones, without doing it."""
        return ingest.files_with_news(readers.document_chunks(readers.scan_directory(self.spark, folder, categories)), self._all(), most)
