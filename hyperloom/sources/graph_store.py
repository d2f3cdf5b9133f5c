"""The graph as stored tables: merges, ontology nodes, clearing, uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.functions import text
from hyperloom.operators import graph
from hyperloom.sources.store import Store

NODE, EDGE = "entity_id string, label string, name string", "source string, type string, target string"


class GraphStore:
    """nodes (entity_id, label, name) and edges (source, type, target) in a Store. A merge adds what is new and lets the
    last name of a node win, so that it may be replayed."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def nodes(self) -> DataFrame:
        found = self.store.load("nodes")
        return found if found is not None else self.spark.createDataFrame([], NODE)

    def edges(self) -> DataFrame:
        found = self.store.load("edges")
        return found if found is not None else self.spark.createDataFrame([], EDGE)

    def merge(self, nodes: DataFrame, edges: DataFrame | None = None) -> None:
        """Nodes by their id and edges by their source: only the buckets that these fall in are written."""
        empty = lambda ddl: self.spark.createDataFrame([], ddl)

        def last_name(old: DataFrame | None, new: DataFrame) -> DataFrame:
            rows = (empty(NODE) if old is None else old).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            return rows.groupBy("entity_id", "label").agg(F.max_by("name", F.struct("_new", "name")).alias("name"))

        def once(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return (empty(EDGE) if old is None else old).unionByName(new).distinct()

        self.store.merge("nodes", nodes.select("entity_id", "label", "name"), ["entity_id"], last_name)
        if edges is not None:
            self.store.merge("edges", edges.select("source", "type", "target"), ["source"], once)

    def insert(self, experiments: DataFrame) -> None:
        """Experiments with their entities, roles, relations and evidence."""
        self.merge(graph.nodes(experiments), graph.edges(experiments))

    def insert_ontology(self, entities: DataFrame) -> int:
        """Nodes of a vocabulary (type, value); those of unknown types are left out. How many were given that count."""
        known = entities.where(F.col("type").isin(schema.ENTITY_TYPES) & (text.strip("value") != ""))
        rows = known.select(text.entity_key("type", "value").alias("entity_id"), F.col("type").alias("label"), F.col("value").alias("name"))
        self.merge(rows)
        return known.count()

    def clear(self) -> tuple[int, int]:
        """Empties both tables; how many nodes and edges there were."""
        before = self.nodes().count(), self.edges().count()
        self.store.save("nodes", self.spark.createDataFrame([], NODE))
        self.store.save("edges", self.spark.createDataFrame([], EDGE))
        return before

    def check_unique(self) -> None:
        """Fails if two nodes of a label share an id."""
        twice = self.nodes().groupBy("label", "entity_id").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"nodes that share an id: {[(r.label, r.entity_id) for r in twice]}")
