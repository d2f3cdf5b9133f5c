"""Retrieval quality: precision, recall, reciprocal rank; judges of answers; reports of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions import text


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """question, precision_at_k, recall_at_k, reciprocal_rank from ranked (question, rank, id) and relevant (question, id).
    Every relevant question has a row; each pair counts once."""
    hits = ranked.join(relevant.distinct(), ["question", "id"], "left_semi")
    own = hits.groupBy("question").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"))
    wanted = relevant.distinct().groupBy("question").agg(F.count("*").alias("wanted"))
    found = F.coalesce("found", F.lit(0))
    return wanted.join(own, "question", "left").select("question", (found / k).alias("precision_at_k"), (found / F.col("wanted")).alias("recall_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("questions"), *(F.avg(c).alias(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank")))


def run_rollup(questions: DataFrame) -> DataFrame:
    """One row for a run over questions (judge_pass, latencies in ms, and a model's times, scores and verdicts if there):
    the share that passed of those judged, and means. What wasn't measured is left out of its mean."""
    judged, passed = F.count("judge_pass"), F.count_if("judge_pass")
    rate = F.round(F.coalesce(passed / F.when(judged > 0, judged), F.lit(0.0)), 4)
    means = [F.round(F.avg(F.nullif(c, F.lit(0.0)) if c != "e2e_ms" else c), 2).alias(f"mean_{c}") for c in ("e2e_ms", "vector_ms", "graph_ms")]
    means += [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("ttft_s", "ttfa_s", "llm_judge_score") if c in questions.columns]
    if "llm_judge_pass" in questions.columns:
        means.append(F.round(F.count_if("llm_judge_pass") / F.nullif(F.count("llm_judge_score"), F.lit(0)), 4).alias("llm_judge_pass_rate"))
    return questions.agg(F.count("*").alias("questions"), judged.alias("questions_judged"), passed.alias("questions_passed"), rate.alias("success_rate"), *means)


def judge_verdicts(answers: DataFrame, column: str = "verdict") -> DataFrame:
    """Adds score (0 to 1), passed (from 0.5 on) and reasoning of a judging model's JSON answer, which may stand in
    other text or a fence; all null where it is no object."""
    root, number = F.col("_root"), F.col("_number")
    read = answers.withColumn("_root", text.json_root(column))
    read = read.withColumn("_number", F.coalesce(F.get_json_object(root, "$.score").try_cast("double"), F.when(root.startswith("{"), 0.0)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    judged = {"score": F.when(number.isNotNull(), F.round(score, 4)), "passed": F.when(number.isNotNull(), score >= 0.5), "reasoning": F.when(number.isNotNull(), F.coalesce(F.get_json_object(root, "$.reasoning"), F.lit("")))}
    return read.withColumns(judged).drop("_root", "_number")


def asked(questions: DataFrame) -> DataFrame:
    """The golden questions that retrieval is measured by: those with expected experiments that aren't for answers only."""
    return questions.where((F.size("expected_experiment_ids") > 0) & ~F.coalesce(F.col("eval_mode") == "e2e_only", F.lit(False)))


def failures(questions: DataFrame) -> DataFrame:
    """id, status, reason of the questions (id, retrieval_skipped, skip_reason, error, judge_pass, judge_details) that a
    report lists; secrets in errors are redacted."""
    skipped, failed = F.coalesce("retrieval_skipped", F.lit(False)), F.col("error").isNotNull()
    status = F.when(skipped, "retrieval_skipped").when(failed, "error").when(F.col("judge_pass") == False, "judge_fail")  # noqa: E712
    reason = F.when(skipped, F.coalesce("skip_reason", F.lit("no expected_experiment_ids"))).when(failed, text.redact("error")).otherwise(F.coalesce("judge_details", F.lit("rule judge failed")))
    return questions.select("id", status.alias("status"), reason.alias("reason")).where("status is not null")


def layers(parsed: DataFrame, hits: DataFrame, reranked: DataFrame, pairs: DataFrame, answers: DataFrame, limit: int = 5) -> DataFrame:
    """question, stage, pos, payload (JSON): what each layer of a run gave. parsed (question, pos, type, value), hits and
    reranked (question, rank, id, similarity, and hybrid), pairs (question, id, other, parameter), answers (question,
    answer, e2e_ms). A store writes it divided by stage."""
    row = lambda df, stage, pos, *columns: df.select("question", F.lit(stage).alias("stage"), pos.cast("long").alias("pos"), F.to_json(F.struct(*columns)).alias("payload"))
    score = lambda c: F.round(c, 4).alias(c)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("hybrid"), "rank"))
    placed = reranked.withColumn("place", place)
    other = F.row_number().over(Window.partitionBy("question").orderBy("id", "other"))
    parts = [
        row(parsed, "L0", F.col("pos"), "type", "value"),
        row(hits, "L1_pre_rerank", F.col("rank"), "id", score("similarity")),
        row(placed, "L1", F.col("place"), "id", score("similarity"), score("hybrid")),
        row(placed.where(F.col("place") <= limit), "L2", F.col("place"), "id", score("similarity"), score("hybrid"), "geography", "year"),
        row(pairs, "L3", other, "id", "other", "parameter"),
        row(answers, "L4", F.lit(1), F.left("answer", F.lit(500)).alias("answer_preview"), F.length("answer").alias("answer_length"), "e2e_ms"),
    ]
    return reduce(DataFrame.unionByName, parts)


def rule_judge(answers: DataFrame) -> DataFrame:
    """answers (answer, keywords array, recall, min_recall, retrieved, expect_empty) with passed and score: the mean of
    the criteria that a question has. An empty answer fails."""
    c = F.col
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    hit = F.filter(words, lambda w: text.keyword_in_answer(c("answer"), w))
    n = F.size(words)
    parts = F.filter(
        F.array(
            F.when(n > 0, F.size(hit) / n),
            F.when(c("min_recall").isNotNull(), F.when(F.coalesce(c("recall"), F.lit(0.0)) >= c("min_recall"), 1.0).otherwise(F.coalesce(c("recall"), F.lit(0.0)) / F.greatest(c("min_recall"), F.lit(1e-9)))),
            F.when(F.coalesce(c("expect_empty"), F.lit(False)), F.when(c("retrieved") == 0, 1.0).otherwise(0.0)),
        ),
        lambda x: x.isNotNull(),
    )
    blank = F.coalesce(text.strip("answer") == "", F.lit(True))
    score = F.when(blank, 0.0).when(F.size(parts) == 0, 1.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    return answers.withColumn("score", score).withColumn("passed", ~blank & (F.size(parts) >= 0) & F.forall(parts, lambda x: x >= 1.0))
