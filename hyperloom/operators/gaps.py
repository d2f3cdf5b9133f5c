"""Research gaps over a grid of the most frequent values of some dimensions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from hyperloom import schema
from hyperloom.functions import text, vectors
from hyperloom.sources.scratch import written

# Parts of a geography that make it domestic.
DOMESTIC = ["росси", "рф", "domestic", "ссср"]


def is_domestic(geography: Column, words: list[str] = DOMESTIC) -> Column:
    return F.coalesce(geography.isNotNull() & (text.hits(F.lower(geography), words) > 0), F.lit(False))


def combinations(experiments: DataFrame, dimensions: list[str], domestic: Column) -> DataFrame:
    """d0, d1, ... (arrays), n, home: each combination of the dimensions' values among inputs and processes with how many
    experiments have it. Axes and counts both come from this table, so the experiments are read and shuffled once."""
    every = F.concat("input_entities", "process_entities")
    values = lambda d: F.transform(F.filter(every, lambda e: e["type"] == d), lambda e: e["value"])
    names = [f"d{i}" for i in range(len(dimensions))]
    rows = experiments.select(domestic.alias("domestic"), *(values(d).alias(n) for n, d in zip(names, dimensions)))
    return rows.groupBy(*names).agg(F.count("*").alias("n"), F.count_if("domestic").alias("home"))


def combination_counts(combined: DataFrame, dimensions: int) -> DataFrame:
    """d0, d1, ..., experiments, domestic: how often a combination of values occurs. An experiment counts once for each of
    its value occurrences, and only if it has every dimension."""
    names = [f"d{i}" for i in range(dimensions)]
    for name in names:
        combined = combined.withColumn(name, F.explode(name))
    return combined.groupBy(*names).agg(F.sum("n").alias("experiments"), F.sum("home").alias("domestic"))


def grid(combined: DataFrame, dimensions: int, cap: int | None = None) -> DataFrame:
    """All combinations of each dimension's most frequent values (ties by value). The caps bound its size whatever the
    data's: 500 rows for one dimension, 10 000 for two, 8 000 for three, and 10 to the power of more."""
    most = cap or schema.DIMENSION_CAPS.get(dimensions, schema.DIMENSION_CAP_REST)
    axes = []
    for i in range(dimensions):
        counted = combined.select(F.explode(f"d{i}").alias(f"d{i}"), "n").groupBy(f"d{i}").agg(F.sum("n").alias("n"))
        axes.append(counted.orderBy(F.desc("n"), f"d{i}").limit(most).select(f"d{i}"))
    return reduce(lambda a, b: a.crossJoin(b), axes)


def classify(cells: DataFrame, counts: DataFrame, dimensions: int, least: int = 3) -> DataFrame:
    """cells with gap_type and experiments, without those that are no gap."""
    keys = [f"d{i}" for i in range(dimensions)]
    n, home = F.coalesce("experiments", F.lit(0)), F.coalesce("domestic", F.lit(0))
    kind = F.when(n == 0, "missing").when(n < least, "weak").when(home == 0, "foreign_only").when(home == n, "domestic_only")
    joined = cells.join(counts, keys, "left").select(*keys, n.alias("experiments"), kind.alias("gap_type"))
    return joined.where("gap_type is not null")


def prioritized(gaps: DataFrame, dimensions: int, most: int = 100) -> DataFrame:
    """One-sided gaps first, then weak, then missing ones, each in the grid's order."""
    priority = F.when(F.col("gap_type").isin("domestic_only", "foreign_only"), 0).when(F.col("gap_type") == "weak", 1).otherwise(2)
    return gaps.withColumn("priority", priority).orderBy("priority", *(f"d{i}" for i in range(dimensions))).limit(most)


def analyze(experiments: DataFrame, dimensions: list[str], least: int = 3, cap: int | None = None, domestic: Column | None = None, cells: DataFrame | None = None) -> DataFrame:
    """All gaps. `cells` (d0, d1, ...) asks for these combinations and no others. The combinations are written, as each axis
    and the counts read them."""
    combined = combinations(experiments, dimensions, is_domestic(F.col("geography")) if domestic is None else domestic)
    combined = written(combined) if cells is None else combined
    n = len(dimensions)
    return classify(grid(combined, n, cap) if cells is None else cells, combination_counts(combined, n), n, least)


def neighbours(experiments: DataFrame, encoded: DataFrame, cells: DataFrame, dimensions: list[str], dim: int, semantic: bool = True, most: int = 5, make=vectors.generate) -> DataFrame:
    """cell, rank, id, similarity, value: for each of a few gaps (d0, d1, ...; at most a hundred or so) its nearest
    experiments with a row for each of their outputs. Fillers come from the codebook, never from numbers' places. encoded: id
    and hv, packed bytes or an array of words as `bundles.as_arrays` makes them.

    The cells' vectors go to the tasks together; a task hands on its own nearest of each cell."""
    rows = cells.select(*(f"d{i}" for i in range(len(dimensions)))).collect()
    names = ["/".join(r) for r in rows]
    book = vectors.Codebook(dim, semantic, make=make)
    bundled = [vectors.bundle([vectors.bind(book(f"Role:{d}"), book(f"{d}:{' '.join(v.lower().split())}")) for d, v in zip(dimensions, r)], owner="query", make=make) for r in rows]
    if not rows:
        return experiments.select(F.lit("").alias("cell"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("similarity"), F.lit("").alias("value")).limit(0)
    words = isinstance(encoded.schema["hv"].dataType, ArrayType)
    wanted = np.stack([np.packbits(np.pad(v > 0, (0, -dim % 64)), bitorder="little") for v in bundled]) if words else np.stack([np.frombuffer(vectors.pack(v), np.uint8) for v in bundled])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, object), np.empty(0))] * len(names)
        for batch in batches:
            if not len(batch):
                continue
            hv, ids = batch.column("hv"), batch.column("id")
            own = (hv.flatten().to_numpy(zero_copy_only=False).view(np.uint8) if words else np.frombuffer(b"".join(hv.to_pylist()), np.uint8)).reshape(len(batch), -1)
            for c, q in enumerate(wanted):
                s = 1 - 2 * np.bitwise_count(own ^ q).sum(1, dtype=np.int64) / dim
                # Of this batch those no farther than its own last that could count, and ties of that one.
                at = np.flatnonzero(s >= max(np.partition(s, -most)[-most] if len(s) > most else -np.inf, best[c][1][-1] if len(best[c][1]) == most else -np.inf))
                i, s = np.concatenate([best[c][0], np.array(ids.take(pa.array(at)).to_pylist(), object)]), np.concatenate([best[c][1], s[at]])
                first = np.lexsort((i, -s))[:most]
                best[c] = i[first], s[first]
        for name, (i, s) in zip(names, best):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i)), pa.array(list(i), pa.string()), pa.array(s)], ["cell", "id", "similarity"])

    best = encoded.select("id", "hv").mapInArrow(near, "cell string, id string, similarity double")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("similarity"), "id"))
    ranked = written(best.withColumn("rank", rank).where(F.col("rank") <= most))
    outputs = experiments.join(F.broadcast(ranked.select("id").distinct()), "id", "left_semi").select("id", F.explode("output_entities").alias("o")).select("id", F.col("o.value").alias("value"))
    return F.broadcast(ranked).join(outputs, "id").select("cell", "rank", "id", "similarity", "value")  # a few rows for each cell


def extrapolate(neighbours: DataFrame) -> DataFrame:
    """cell, label, predicted, support from the outputs of a cell's neighbours (cell, rank, similarity, value).

    Numbers of the first five's properties are candidates; the first three with a similarity over 0.05 support every
    candidate that is the same number within 1e-6, whatever its name. Equal numbers meet in a bucket of their rounded
    value or the next, so this is an equi-join."""
    number = text.first_number("value")
    rows = neighbours.where("rank <= 5").withColumn("number", number).where("number is not null")
    candidates = rows.select("cell", text.number_label("value").alias("label"), "number").distinct()
    near = candidates.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("number") * 1e5).cast("long") + i for i in (-1, 0, 1)))))
    support = rows.where("rank <= 3 and similarity > 0.05").select("cell", F.col("number").alias("other"), "similarity", F.floor(F.col("number") * 1e5).cast("long").alias("bucket"))
    met = near.join(support, ["cell", "bucket"]).where(F.abs(F.col("number") - F.col("other")) < 1e-6)
    return met.groupBy("cell", "label").agg(F.sum(F.col("number") * F.col("similarity")).alias("s"), F.sum("similarity").alias("w"), F.count("*").alias("support")).select("cell", "label", (F.col("s") / F.col("w")).alias("predicted"), "support")


def of_pairs(experiments: DataFrame, dimensions: list[str], least: int = 3, cap: int | None = None, domestic: Column | None = None) -> DataFrame:
    """first, second, d0, d1, experiments, gap_type: the gaps of every two of the dimensions, by one scan of the experiments.

    Their combinations are counted once and written. A combination gives its cells of all pairs as one array, so that one
    aggregate keyed by pair and values counts them all, as grouping sets would; but an experiment with several values of a
    third dimension, or none, counts as it does when a pair is asked for alone. A value counts in its axis likewise."""
    combined = written(combinations(experiments, dimensions, is_domestic(F.col("geography")) if domestic is None else domestic))
    every = list(itertools.combinations(range(len(dimensions)), 2))
    most = cap or schema.DIMENSION_CAPS[2]

    def cells(k: int, i: int, j: int) -> Column:
        one = lambda a, b: F.struct(F.lit(k).alias("pair"), a.alias("d0"), b.alias("d1"))
        return F.flatten(F.transform(f"d{i}", lambda a: F.transform(f"d{j}", lambda b: one(a, b))))

    counts = combined.select(F.explode(F.concat(*(cells(k, i, j) for k, (i, j) in enumerate(every)))).alias("c"), "n", "home")
    counts = counts.groupBy("c.pair", "c.d0", "c.d1").agg(F.sum("n").alias("experiments"), F.sum("home").alias("domestic"))
    values = lambda i: F.transform(f"d{i}", lambda v: F.struct(F.lit(i).alias("dim"), v.alias("v")))
    axis = combined.select(F.explode(F.concat(*map(values, range(len(dimensions))))).alias("a"), "n").groupBy("a.dim", "a.v").agg(F.sum("n").alias("n"))
    axis = written(axis)
    top = [axis.where(F.col("dim") == i).orderBy(F.desc("n"), "v").limit(most).select("v") for i in range(len(dimensions))]  # capped by the model
    asked = reduce(DataFrame.unionByName, (top[i].withColumnRenamed("v", "d0").crossJoin(top[j].withColumnRenamed("v", "d1")).withColumn("pair", F.lit(k)) for k, (i, j) in enumerate(every)))
    n, home = F.coalesce("experiments", F.lit(0)), F.coalesce("domestic", F.lit(0))
    kind = F.when(n == 0, "missing").when(n < least, "weak").when(home == 0, "foreign_only").when(home == n, "domestic_only")
    name = lambda side: F.get(F.array(*(F.lit(dimensions[p[side]]) for p in every)), F.col("pair"))
    joined = asked.join(counts, ["pair", "d0", "d1"], "left")
    return joined.select(name(0).alias("first"), name(1).alias("second"), "d0", "d1", n.alias("experiments"), kind.alias("gap_type")).where("gap_type is not null")
