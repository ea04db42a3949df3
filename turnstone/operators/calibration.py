"""Rubric scores: validation, weighting, calibration against a teacher's, and learned weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.sources.datasets import BEHAVIOURS

# The rubric (dimension, label, weight, description), and the limits of scores.
RUBRIC = (
    ("class_grounding", "수업 근거 충실성", 0.25, "수업 사실·숙제·휴강 등을 검색 근거 없이 꾸며내지 않고 근거와 답변이 일치한다."),
    ("scope_boundary", "범위 판단과 안전성", 0.20, "직접 언급, 간접 추론, 관련 일반 이론, 무관한 질문을 구분하고 불확실성을 밝힌다."),
    ("correctness_relevance", "정확성과 관련성", 0.20, "질문에 맞고 화학적으로 정확하며 모순되거나 엉뚱한 설명이 없다."),
    ("completeness_actionability", "충분성과 실행 가능성", 0.15, "필요한 설명·풀이·과제를 구체적으로 제공하고 학생이 다음 행동을 알 수 있다."),
    ("student_clarity", "학생 눈높이와 명료성", 0.10, "학생이 이해하기 쉬운 구조와 표현을 사용하고 불필요하게 장황하지 않다."),
    ("citation_traceability", "근거 추적 가능성", 0.10, "수업 근거를 사용했다면 유효한 청크 ID로 어떤 내용에 근거했는지 확인할 수 있다."),
)
DIMENSIONS = tuple(d for d, *_ in RUBRIC)
LEAST, MOST, PASS_SCORE, PASS_DIMENSION = 1.0, 5.0, 70.0, 3.0
MOST_OFFSET, LEAST_CORRELATION, LEARN_FROM, SHRINK = 1.0, 0.05, 6, 0.5
GATES, CITATIONS = ("class_grounding", "scope_boundary"), "citation_traceability"


def rubric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d, label, w, text) for k, (d, label, w, text) in enumerate(RUBRIC)], "pos int, dim string, label string, weight double, description string")


def score_problem(scores: Column, dims=DIMENSIONS) -> Column:
    """What is wrong with a map of scores, or null."""
    missing = F.array_except(F.array(*map(F.lit, dims)), F.coalesce(F.map_keys(scores), F.array().cast("array<string>")))
    bad = F.exists(F.array(*map(F.lit, dims)), lambda d: F.coalesce(~F.try_element_at(scores, d).between(LEAST, MOST), F.lit(True)))
    return F.when(F.size(missing) > 0, F.concat(F.lit("no score for "), F.array_join(missing, ", "))).when(bad, F.lit("a score is no number from 1 to 5"))


def weighted(scores: Column, weights: Column, dims=DIMENSIONS) -> Column:
    """The weighted mean of a map of scores in per cent of the best, to two places."""
    total, whole = F.lit(0.0), F.lit(0.0)
    for d in dims:
        total, whole = total + scores[d] / MOST * weights[d], whole + weights[d]
    return F.round(total / whole * 100, 2)


def calibrate(scores: Column, offsets: Column, dims=DIMENSIONS) -> Column:
    """Scores moved by the offsets, kept between 1 and 5, to two places."""
    moved = [F.round(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), scores[d] + offsets[d])), 2) for d in dims]
    return F.map_from_arrays(F.array(*map(F.lit, dims)), F.array(*moved))


def passes(scores: Column, overall: Column) -> Column:
    ok = overall >= PASS_SCORE
    for d in GATES:
        ok = ok & (scores[d] >= PASS_DIMENSION)
    return ok


def _long(feedback: DataFrame) -> DataFrame:
    """dim, teacher, evaluator, overall of each feedback record and dimension."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.try_element_at("teacher_scores", F.lit(d)).alias("teacher"), F.try_element_at("evaluator_scores", F.lit(d)).alias("evaluator")) for d in DIMENSIONS)))
    return feedback.select("teacher_overall_score", each.alias("x")).select("x.*", F.col("teacher_overall_score").alias("overall"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns over the rows of a group that have both; 0 for under two or a constant column.

    The engine's aggregates keep centred sums, so large values lose nothing.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when((F.count(x) < 2) | flat, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)))


def offsets(feedback: DataFrame) -> DataFrame:
    """dim, offset: the mean of teacher less evaluator, at most one point; 0 without pairs."""
    diff = F.avg(F.col("teacher") - F.col("evaluator"))
    moved = F.round(F.least(F.lit(MOST_OFFSET), F.greatest(F.lit(-MOST_OFFSET), diff)), 3)
    return _long(feedback).groupBy("dim").agg(F.coalesce(moved, F.lit(0.0)).alias("offset"))


def weights(feedback: DataFrame) -> DataFrame:
    """dim, weight, method: the rubric's weights; with enough overall scores half of each is learned.

    A dimension's share is its correlation with the overall score, at least a little.
    """
    learned = _long(feedback.where("teacher_overall_score is not null")).groupBy("dim").agg(F.greatest(F.lit(LEAST_CORRELATION), pearson(F.col("teacher"), F.col("overall"))).alias("r"), F.count("teacher").alias("n"))
    all_dims = Window.partitionBy(F.lit(1))  # six rows
    rows = rubric(feedback.sparkSession).select("pos", "dim", F.col("weight").alias("given")).join(learned, "dim", "left")
    blend = F.round(F.col("given") * SHRINK + F.col("r") / F.sum("r").over(all_dims) * (1 - SHRINK), 4)
    enough = F.coalesce(F.col("n") >= LEARN_FROM, F.lit(False))
    rows = rows.withColumn("blend", blend)
    weight = F.when(enough, F.round(F.col("blend") / F.sum("blend").over(all_dims), 4)).otherwise(F.col("given"))
    return rows.select("pos", "dim", weight.alias("weight"), F.when(enough, "learned").otherwise("default").alias("method"))


def profile(feedback: DataFrame) -> DataFrame:
    """One row: counts, and maps of offsets and weights."""
    spark = feedback.sparkSession
    counts = feedback.agg(F.count(F.lit(1)).alias("feedback_count"), F.count_if(F.size("evaluator_scores") > 0).alias("paired_count"), F.count("teacher_overall_score").alias("overall_count"))
    both = rubric(spark).select("dim").join(offsets(feedback), "dim", "left").join(weights(feedback), "dim")
    maps = both.agg(F.map_from_entries(F.collect_list(F.struct("dim", F.coalesce("offset", F.lit(0.0))))).alias("offsets"), F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("weights"), F.first("method").alias("weight_method"))
    return counts.crossJoin(maps)


def grade(answers: DataFrame, profile_row: DataFrame) -> DataFrame:
    """Calibrated scores of graded answers.

    ``answers`` has id, scores (map), cited_chunk_ids and retrieved_ids.  A citation that wasn't
    retrieved puts the citation dimension to 1.
    """
    rows = answers.crossJoin(F.broadcast(profile_row.select("offsets", "weights")))
    rows = rows.withColumn("invalid_citations", F.array_sort(F.array_except("cited_chunk_ids", "retrieved_ids")))
    calibrated = calibrate(F.col("scores"), F.col("offsets"))
    forced = F.transform_values(calibrated, lambda k, v: F.when((k == CITATIONS) & (F.size("invalid_citations") > 0), F.lit(LEAST)).otherwise(v))
    rows = rows.withColumn("calibrated", forced).withColumn("overall", weighted(F.col("calibrated"), F.col("weights")))
    return rows.withColumn("passed", passes(F.col("calibrated"), F.col("overall"))).drop("offsets", "weights")


def grading_summary(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("overall"), 2).alias("mean_overall"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))


def select_examples(feedback: DataFrame, limit: int = 6, behaviours=BEHAVIOURS) -> DataFrame:
    """The latest record of each behaviour, then the latest others, at most ``limit``; equal records count once.

    ``feedback`` has pos, a unique place of any type that compares, and expected_behavior; of equal records the
    latest is kept.  Behaviours come in alphabetical order.  Two small top-k jobs, no sort of all feedback.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    content = [c for c in feedback.columns if c != "pos"]
    once = feedback.groupBy(F.sha2(F.to_json(F.struct(*content)), 256).alias("k")).agg(F.max_by(F.struct(*content), "pos").alias("r"), F.max("pos").alias("pos")).select("pos", "r.*")
    latest = once.where(F.col("expected_behavior").isin(*behaviours)).groupBy("expected_behavior").agg(F.max("pos").alias("pos"))
    firsts = latest.select("pos", F.lit(True).alias("first"))
    rows = once.join(F.broadcast(firsts), "pos", "left")  # at most one for each behaviour
    return rows.orderBy(F.coalesce("first", F.lit(False)).desc(), F.when(F.col("first"), F.col("expected_behavior")), F.col("pos").desc()).limit(limit).drop("first")
