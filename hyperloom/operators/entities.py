"""The exploded view that most operators share, and coverage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom import schema

ROLES = ("input", "process", "output")


def entities(experiments: DataFrame, roles: tuple[str, ...] = ROLES, *keep: str) -> DataFrame:
    """id, role, pos, type, value (and the columns to keep): one row for each entity, in the model's order."""

    def tagged(role: str) -> Column:
        return F.transform(f"{role}_entities", lambda e: F.struct(F.lit(role).alias("role"), e["type"].alias("type"), e["value"].alias("value")))

    return experiments.select("id", *keep, F.posexplode(F.concat(*map(tagged, roles))).alias("pos", "e")).select("id", *keep, F.col("e.role").alias("role"), "pos", F.col("e.type").alias("type"), F.col("e.value").alias("value"))


def visible(experiments: DataFrame, exclude_sensitive: bool) -> DataFrame:
    return experiments.where(~F.col("is_sensitive")) if exclude_sensitive else experiments


def coverage(experiments: DataFrame) -> DataFrame:
    """type, occurrences, distinct_values for every type of the model, zeros included."""
    types = experiments.sparkSession.createDataFrame([(t,) for t in schema.ENTITY_TYPES], "type string")
    counted = entities(experiments).groupBy("type").agg(F.count("*").alias("occurrences"), F.countDistinct("value").alias("distinct_values"))
    return types.join(counted, "type", "left").na.fill(0)


def documents_rollup(experiments: DataFrame, order: str = "id") -> DataFrame:
    """filename, experiments, and the first experiment's year, geography and source type."""
    rows = experiments.select(F.explode("evidence").alias("filename"), "year", "geography", "source_type", F.col(order).alias("_o"))
    first = lambda c: F.min_by(c, "_o").alias(c)
    return rows.groupBy("filename").agg(F.count("*").alias("experiments"), first("year"), first("geography"), first("source_type"))


def consensus(rows: DataFrame, group: str, prop: str, value: str, confidence: str) -> DataFrame:
    """For each group: contradictions (distinct values beyond the first of each property, at most n - 1) and the
    agreement ratio clamped to 0.15 .. 1."""
    per = rows.groupBy(group, prop).agg(F.countDistinct(value).alias("d"))
    contradictions = per.groupBy(group).agg(F.sum(F.col("d") - 1).alias("c"))
    n = rows.groupBy(group).agg(F.count("*").alias("hits"), F.avg(confidence).alias("mean_confidence"))
    c = F.least(F.col("c"), F.col("hits") - 1)
    ratio = F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.col("mean_confidence") * (1 - c / F.col("hits")) + 0.08))
    return n.join(contradictions, group).select(group, "hits", c.cast("long").alias("contradictions"), ratio.alias("ratio"))
