"""Sinks: JSON reports, timed text, and the append-only feedback log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions.text import clock
from turnstone.operators import calibration
from turnstone.sources.datasets import BEHAVIOURS, UNCATEGORISED, require


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def report_name(query: Column) -> Column:
    """The name of a query's report."""
    return F.substring(F.sha2(query, 256), 1, 12)


def timed_lines(segments: DataFrame) -> DataFrame:
    """lesson, line: '[start - end] [speaker] text' of timed segments."""
    line = F.format_string("[%s - %s] [%s] %s", clock(F.col("start_sec")), clock(F.col("end_sec")), "speaker", "text")
    return segments.select("lesson", "start_sec", line.alias("line"))


def write_timed_text(segments: DataFrame, path: str) -> None:
    """One folder for each lesson, its lines in order of time."""
    rows = timed_lines(segments).repartition("lesson").sortWithinPartitions("lesson", "start_sec")
    rows.select("lesson", "line").write.mode("overwrite").partitionBy("lesson").text(path)


def feedback_records(records: DataFrame) -> DataFrame:
    """Records ready to be appended: with an id, a time and a verdict where they lack them.

    Raises if a record lacks its question, answer or id, has a bad score or an unknown behaviour.
    """
    scores = F.col("teacher_scores")
    problem = (
        F.when(F.coalesce(F.col("question_id") == "", F.lit(True)) | F.coalesce(F.col("question") == "", F.lit(True)) | F.coalesce(F.col("answer") == "", F.lit(True)), "question_id, question or answer is missing")
        .when(calibration.score_problem(scores).isNotNull(), calibration.score_problem(scores))
        .when(F.col("teacher_overall_score").isNotNull() & ~F.col("teacher_overall_score").between(0, 100), "the overall score is not between 0 and 100")
        .when(~F.coalesce(F.col("expected_behavior").isin(*BEHAVIOURS), F.lit(True)), "unknown behaviour")
    )
    require(records.select(problem.alias("problem")).where("problem is not null"))
    given = F.create_map(*(x for d, _, w, _ in calibration.RUBRIC for x in (F.lit(d), F.lit(w))))
    return records.withColumns({
        "feedback_id": F.coalesce("feedback_id", F.uuid()), "recorded_at": F.coalesce("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")),
        "category": F.coalesce("category", F.lit(UNCATEGORISED)), "teacher_pass": F.coalesce("teacher_pass", calibration.weighted(scores, given) >= calibration.PASS_SCORE), "teacher_notes": F.coalesce("teacher_notes", F.lit("")),
    })


def append_feedback(records: DataFrame, path: str) -> None:
    feedback_records(records).write.mode("append").json(path)


def changed_sources(manifest: DataFrame, sources: DataFrame, keys=("source_sha256", "model", "language", "keywords")) -> DataFrame:
    """Sources that no manifest row matches in all keys: the ones to transcribe."""
    return sources.join(manifest.select(*keys).distinct(), [*keys], "left_anti")
