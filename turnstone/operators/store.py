"""Enriched chunks and their store: Parquet partitioned by lesson, replaced lesson by lesson, validated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import tagging
from turnstone.functions.rules import TagRules
from turnstone.functions.text import nfkc, ratio, sha256, slug, strip
from turnstone.sources.shared import children, exists, move, remove

# The default subject, language and layout of ids.
SUBJECT, LANGUAGE = "화학", "ko"
ORDER = ["chunk_id", "lesson_id", "chunk_index", "turn_start", "turn_end", "source_line_start", "source_line_end", "start_sec", "end_sec", "speakers", "topics", "content_types", "terms", "question_numbers", "char_count", "content_sha256", "text"]


def lesson_id(date, name, rules_nfkc: bool = True):
    """A lesson's default id, of its date and its file's stem."""
    joined = F.concat_ws("_", F.nullif(date, F.lit("")), name)
    return slug(nfkc(joined) if rules_nfkc else joined)


def enrich(chunks: DataFrame, rules: TagRules = TagRules()) -> DataFrame:
    """Chunks (lesson_id, chunk_index, speakers, text and ranges) with ids, tags, digest and length."""
    text = strip(F.col("text"))
    speakers = F.filter(F.transform(F.coalesce("speakers", F.array().cast("array<string>")), strip), lambda s: s != "")
    rows = chunks.withColumns({"text": text, "speakers": speakers})
    t = F.col("text")
    return rows.withColumns({
        "chunk_id": F.concat(F.col("lesson_id").cast("string"), F.lit(":chunk:"), F.lpad(F.col("chunk_index").cast("string"), F.greatest(F.lit(4), F.length(F.col("chunk_index").cast("string"))), F.lit("0"))),
        "topics": tagging.topics(t, rules), "content_types": tagging.content_types(t, F.col("speakers"), rules), "terms": tagging.terms(t, rules),
        "question_numbers": tagging.question_numbers(t, rules), "char_count": F.length("text"), "content_sha256": sha256(t),
    }).select(*[c for c in ORDER if c in {*rows.columns, "chunk_id", "topics", "content_types", "terms", "question_numbers", "char_count", "content_sha256"}])


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the partitions of the lessons that ``chunks`` has; others stay."""
    chunks.repartition("lesson_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lesson_id").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("lesson_id", F.col("lesson_id").cast("string"))


def read_lessons(spark: SparkSession, home: str) -> DataFrame | None:
    """The lessons of a store, if it has any yet."""
    return spark.read.parquet(f"{home}/lessons") if exists(spark, f"{home}/lessons") else None


def load_lessons(spark: SparkSession, home: str, chunks: DataFrame, lessons: DataFrame) -> DataFrame:
    """Load enriched chunks of some lessons into a store, all or nothing; returns `validate_load` of what was written.

    The store has the folders chunks, one partition for each lesson, and lessons.  All is first written to a
    staging folder and validated there.  Only if every lesson passes, the loaded partitions and the lessons table
    are moved to their places; else, or after an error, the store is as it was.
    """
    staging = f"{home}/staging-{uuid.uuid4().hex}"
    try:
        write_chunks(chunks, f"{staging}/chunks")
        written = read_chunks(spark, f"{staging}/chunks")
        merge_lessons(read_lessons(spark, home), lessons, F.current_timestamp()).write.parquet(f"{staging}/lessons")
        found = validate_load(written, chunks, spark.read.parquet(f"{staging}/lessons"))
        report = found.collect()  # a row for each loaded lesson
        if all(r.status == "PASS" for r in report):
            for name in children(spark, f"{staging}/chunks"):
                if name.startswith("lesson_id="):
                    move(spark, f"{staging}/chunks/{name}", f"{home}/chunks/{name}")
            move(spark, f"{staging}/lessons", f"{home}/lessons")
        return spark.createDataFrame(report, found.schema)
    finally:
        remove(spark, staging)


def merge_lessons(old: DataFrame | None, new: DataFrame, now) -> DataFrame:
    """The lessons table after a load: replaced rows keep their created_at, all loaded ones get updated_at."""
    fresh = new.withColumn("updated_at", now)
    if old is None:
        return fresh.withColumn("created_at", now)
    first = old.select("lesson_id", "created_at")
    kept = old.join(new.select("lesson_id"), "lesson_id", "left_anti")
    return fresh.join(first, "lesson_id", "left").withColumn("created_at", F.coalesce("created_at", now)).unionByName(kept)


def validate_load(stored: DataFrame, expected: DataFrame, lessons: DataFrame | None = None) -> DataFrame:
    """One row for each lesson: counts, fidelity, completeness, duplicates and the status of the load.

    Stored and expected chunks are paired by lesson and index; a stored chunk counts once for an expected one.
    With ``lessons`` also the number of orphans, chunks whose lesson isn't there; any fails the load.
    """
    mine = stored.groupBy("lesson_id", "chunk_index").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("content_sha256", "text"), "content_sha256").alias("s"), F.count_if((F.size("speakers") > 0) & (F.size("topics") > 0) & (F.size("content_types") > 0) & (F.length("content_sha256") > 0)).alias("complete"))
    want = expected.select("lesson_id", "chunk_index", F.struct("content_sha256", "text").alias("e"))
    rows = mine.join(want, ["lesson_id", "chunk_index"], "full")
    stored_n, expected_n = F.coalesce(F.sum("n"), F.lit(0)), F.count("e")
    per_lesson = rows.groupBy("lesson_id").agg(
        stored_n.alias("stored"), expected_n.alias("expected"), F.round(ratio(F.count_if(F.col("s") == F.col("e")), expected_n), 4).alias("fidelity"),
        F.round(ratio(F.coalesce(F.sum("complete"), F.lit(0)), stored_n), 4).alias("completeness"), F.count_if(F.col("n") > 1).alias("duplicates"),
    )
    ok = (F.col("stored") == F.col("expected")) & (F.col("fidelity") == 1) & (F.col("completeness") == 1) & (F.col("duplicates") == 0)
    if lessons is not None:
        lost = orphans(stored, lessons).groupBy("lesson_id").agg(F.count(F.lit(1)).alias("orphans"))
        per_lesson = per_lesson.join(lost, "lesson_id", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
        ok = ok & (F.col("orphans") == 0)
    return per_lesson.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def orphans(chunks: DataFrame, lessons: DataFrame) -> DataFrame:
    """Chunks of lessons that don't exist."""
    return chunks.join(lessons.select("lesson_id"), "lesson_id", "left_anti")


def distribution(chunks: DataFrame, column: str) -> DataFrame:
    """Values of an array column and the number of chunks that have each."""
    return chunks.select(F.explode(column).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("chunks"))


def question_numbers(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("question_numbers").alias("question_number")).distinct()
