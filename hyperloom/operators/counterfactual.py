"""Experiments that differ in exactly one input of the same type, and what that does to the outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyperloom.functions import text
from hyperloom.operators.entities import entities
from hyperloom.sources.scratch import freed, written


def leave_one_out(experiments: DataFrame) -> DataFrame:
    """A row for each distinct input: id, type, key, value, and rest, a digest of the other inputs' sorted keys.

    Two experiments with sets of equal size that differ in one element each share (type, rest) with different keys;
    so the comparison of all pairs becomes an equi-join."""
    keyed = F.array_sort(F.transform("input_entities", lambda e: F.struct(text.entity_key(e["type"], e["value"]).alias("key"), e["type"].alias("type"), e["value"].alias("value"))))
    rows = experiments.select("id", keyed.alias("inputs")).withColumn("keys", F.transform("inputs", lambda e: e["key"]))
    distinct = F.filter("inputs", lambda e, i: F.array_position(F.col("keys"), e["key"]) == i + 1)
    one = rows.select("id", F.array_distinct("keys").alias("own"), F.explode(distinct).alias("e"))
    rest = F.md5(F.array_join(F.array_remove(F.col("own"), F.col("e.key")), "\u0001").cast("binary"))
    return one.select("id", F.col("e.key").alias("key"), F.col("e.type").alias("type"), F.col("e.value").alias("value"), rest.alias("rest"))


def all_pairs(experiments: DataFrame) -> DataFrame:
    """id, other, parameter, from_value, to_value: each ordered pair once. The result grows with the squares of the
    groups that share all inputs but one; use pair_counts where only numbers are asked for."""
    one = leave_one_out(experiments)
    other = one.select(F.col("id").alias("other"), "type", F.col("key").alias("other_key"), F.col("value").alias("to_value"), "rest")
    return one.join(other, ["type", "rest"]).where("key <> other_key and id <> other").select("id", "other", F.col("type").alias("parameter"), F.col("value").alias("from_value"), "to_value")


def pair_counts(experiments: DataFrame) -> DataFrame:
    """parameter and its number of ordered pairs, from group sizes alone: no pair is ever made."""
    one = leave_one_out(experiments)
    same = one.groupBy("type", "rest", "key").agg(F.count("*").alias("n"))
    groups = same.groupBy("type", "rest").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return groups.groupBy(F.col("type").alias("parameter")).agg(F.sum(F.col("n") * F.col("n") - F.col("squares")).alias("pairs"))


#: Inputs of a target that go to all tasks at most; beyond it, they are joined by a shuffle.
BROADCAST_INPUTS = 10_000
#: Paired experiments' ids that go to all tasks at most.
BROADCAST_IDS = 500_000


def for_target(experiments: DataFrame, target: str) -> DataFrame:
    """The pairs of one experiment; none for an unknown id. Its few rows go to all tasks."""
    one = leave_one_out(experiments.where(F.col("id") == target))
    others = leave_one_out(experiments.where(F.col("id") != target))
    mine = one.select("type", "rest", F.col("key").alias("own_key"), F.col("value").alias("from_value"))
    with freed(experiments.sparkSession):
        known = mine.limit(BROADCAST_INPUTS + 1).collect()
    mine = F.broadcast(experiments.sparkSession.createDataFrame(known, mine.schema)) if len(known) <= BROADCAST_INPUTS else mine
    return others.join(mine, ["type", "rest"]).where("key <> own_key").select(F.lit(target).alias("id"), F.col("id").alias("other"), F.col("type").alias("parameter"), "from_value", F.col("value").alias("to_value"))


def outputs(experiments: DataFrame) -> DataFrame:
    """id, property, value: outputs by name, others by type; the last one of a name counts."""
    rows = entities(experiments, ("output",))
    named = F.when(F.col("type") == "Property", text.split_output("value"))
    return rows.groupBy("id", F.coalesce(named["name"], F.col("type")).alias("property")).agg(F.max_by(F.coalesce(named["value"], F.col("value")), "pos").alias("value"))


def effects(pairs: DataFrame, experiments: DataFrame) -> DataFrame:
    """id, other, property, from_output, to_output where a pair's outputs differ. Only the outputs of paired experiments are
    sought, by one pass; if these are few, the experiments aren't shuffled for it."""
    pairs = written(pairs.select("id", "other"))
    ids = written(pairs.select("id").union(pairs.select("other")).distinct())
    paired = experiments.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    own = written(outputs(paired))
    mine = pairs.select("id", "other").join(own.select("id", "property", F.col("value").alias("from_output")), "id")
    theirs = pairs.select("id", "other").join(own.select(F.col("id").alias("other"), "property", F.col("value").alias("to_output")), "other")
    return mine.join(theirs, ["id", "other", "property"], "full_outer").where(~F.col("from_output").eqNullSafe(F.col("to_output")))
