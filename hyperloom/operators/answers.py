"""What a reader is told: texts made from hits, counterfactuals, gaps and the graph, without a model.

Every function gives rows or one row; nothing is gathered beyond the few hits, effects and names that a text shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom import schema

# The texts' wording.
SIMILAR = "Опыт %s: %s (Сходство с запросом: %.1f%%)"
NOTHING_FOUND = "Релевантных экспериментов не найдено."
CHANGED = "свойство '%s' изменилось с '%s' на '%s'"
IF_CHANGED = "- Если изменить '%s' с '%s' на '%s', то наблюдается: %s."
NO_EFFECT = "без значительных изменений"
NO_PAIRS = "Нет близких контрфактических экспериментов для выявления прямых зависимостей."
COMPARED = "- Сравнение с опытом %s:\n  Изменен параметр '%s' с '%s' на '%s'.\n  Наблюдаемые эффекты: %s."
GAP_TEXTS = {
    "missing": "- Данная комбинация параметров полностью не изучена (0 экспериментов в базе).",
    "weak": "- Данная область слабо освещена (найдено всего %s экспериментов).",
    "foreign_only": "- Эта технология описана только в зарубежной литературе, отечественного опыта не найдено.",
    "domestic_only": "- Эта технология описана только в отечественной практике.",
}
PREDICTED = "- Рекомендации (спрогнозированные значения): %s"
NAMES = {"expert": "Связанные эксперты: %s", "publication": "Связанные публикации: %s", "contradiction": "Противоречия: %s"}
PATHS = "Графовые пути: %s"
#: Hits, counterfactuals and names that a text shows, and the similarity from which a hit counts as relevant.
SHOWN_HITS, SHOWN_PAIRS, SHOWN_NAMES, RELEVANT = 2, 2, 5, 0.05


def similarity_lines(hits: DataFrame, most: int = SHOWN_HITS) -> DataFrame:
    """One row: the best hits (rank, id, similarity, output_entities) as lines of text."""
    outputs = F.array_join(F.transform("output_entities", lambda e: F.concat(e["type"], F.lit(": "), e["value"])), ", ")
    line = F.format_string(SIMILAR, "id", outputs, F.col("similarity") * 100)
    best = hits.where(F.col("rank") <= most).select("rank", line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return best.agg(F.coalesce(F.nullif(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("")), F.lit(NOTHING_FOUND)).alias("similar"))


def effect_texts(pairs: DataFrame, effects: DataFrame) -> DataFrame:
    """pairs (id, other, parameter, from_value, to_value) with `effects`, their outputs' changes as one text."""
    change = F.format_string(CHANGED, "property", "from_output", "to_output")
    own = effects.groupBy("id", "other").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("property", change.alias("t")))), lambda x: x["t"]), ", ").alias("effects"))
    return pairs.join(own, ["id", "other"], "left").withColumn("effects", F.coalesce("effects", F.lit(NO_EFFECT)))


def counterfactual_lines(told: DataFrame, most: int = SHOWN_PAIRS) -> DataFrame:
    """id, text: the first counterfactuals of each experiment, ordered by the other's id."""
    line = F.format_string(IF_CHANGED, "parameter", "from_value", "to_value", "effects")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("other", "parameter", "from_value", "to_value"))
    first = told.select("id", rank.alias("rank"), line.alias("line")).where(F.col("rank") <= most)
    return first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("text"))


def reasons(told: DataFrame) -> DataFrame:
    """id, other, text: every counterfactual of an experiment told in full."""
    return told.select("id", "other", F.format_string(COMPARED, "other", "parameter", "from_value", "to_value", "effects").alias("text"))


def gap_line(kind: Column, experiments: Column, predicted: Column | None = None) -> Column:
    """A gap in words; null for what is none. `predicted`: an array of values."""
    out = F.lit(None).cast("string")
    for name, words in GAP_TEXTS.items():
        out = F.when(kind == name, F.format_string(words, experiments.cast("string")) if "%s" in words else F.lit(words)).otherwise(out)
    if predicted is None:
        return out
    return F.when(F.size(predicted) > 0, F.concat(out, F.lit("\n"), F.format_string(PREDICTED, F.array_join(predicted, ", ")))).otherwise(out)


def graph_lines(expanded: DataFrame, most: int = SHOWN_NAMES) -> DataFrame:
    """One row: the first names of each kind of an expansion (id, kind, node), and the number of its paths: one for each
    publication and one for the entities of an experiment."""
    name = F.regexp_replace("node", r"^[^:]*:", "")
    names = expanded.where(F.col("kind").isin(*NAMES)).select("kind", name.alias("name")).distinct()
    first = names.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("name"))).where(F.col("r") <= most)
    shown = first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    line = F.lit(None).cast("string")
    for kind, words in NAMES.items():
        line = F.when(F.col("kind") == kind, F.format_string(words, "names")).otherwise(line)
    order = {kind: i for i, kind in enumerate(NAMES)}
    place = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col("kind"))
    paths = expanded.agg((F.count_if(F.col("kind") == "publication") + F.count_distinct(F.when(F.col("kind") == "entity", F.col("id")))).alias("paths"))
    lines = shown.select(place.alias("place"), line.alias("line")).unionByName(paths.where("paths > 0").select(F.lit(len(order)).alias("place"), F.format_string(PATHS, F.col("paths").cast("string")).alias("line")))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("graph"))


def asks_for_gaps(hits: DataFrame, query: DataFrame) -> DataFrame:
    """type, value: with fewer than three relevant hits, the first entity of each type of the query (pos, type, value)
    that a gap can have; else nothing."""
    few = hits.agg((F.count_if(F.col("similarity") > RELEVANT) < 3).alias("few"))
    own = query.where(F.col("type").isin(schema.DOMAIN_TYPES))
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("pos"))).where("n = 1")
    return first.crossJoin(F.broadcast(few)).where("few").select("pos", "type", "value")


def synthesis(hits: DataFrame, counterfactual_text: DataFrame, graph: DataFrame) -> DataFrame:
    """One row: everything that an answer is written from (similar, counterfactuals, graph), and `answer`, what is said
    where no model writes one."""
    causes = counterfactual_text.agg(F.coalesce(F.first("text"), F.lit(NO_PAIRS)).alias("counterfactuals"))
    row = similarity_lines(hits).crossJoin(causes).crossJoin(graph)
    return row.withColumn("answer", F.concat_ws("\n\n", "similar", "counterfactuals", F.nullif("graph", F.lit(""))))


def hypothesis(gap: DataFrame, neighbours: DataFrame) -> DataFrame:
    """One row about a gap (configuration, predicted array) and its nearest experiments (rank, id, inputs, outputs)."""
    line = F.format_string("  * %s (%s) -> %s", "id", "inputs", "outputs")
    near = neighbours.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("near"))
    known = F.when(F.size("predicted") > 0, F.array_join("predicted", ", ")).otherwise(F.lit("Неизвестно"))
    none = F.lit("  * Нет близких базовых экспериментов.")
    return gap.crossJoin(near).select("configuration", known.alias("predicted"), F.format_string("Научная гипотеза для: [%s]\nПрогнозируемые свойства: %s\nБлизкие опыты:\n%s", "configuration", known, F.coalesce(F.nullif("near", F.lit("")), none)).alias("hypothesis"))
