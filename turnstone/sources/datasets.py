"""Readers and validators of chunk artifacts, question sets, answers and feedback.

A validator is a DataFrame of problems (one row each, with what is wrong); `require` raises if there
are any.  Nothing else is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.text import strip
from turnstone.sources.shared import exists

# Schemas, the form of a question id, and the permitted behaviours and rubric dimensions.
CHUNK = "struct<chunk_index:int,turn_start:int,turn_end:int,source_line_start:int,source_line_end:int,start_sec:double,end_sec:double,speakers:array<string>,char_count:int,text:string>"
ARTIFACT = f"stage int, source_file string, source_metadata struct<title:string,date:string,language:string>, chunking_config struct<target_chars:int,overlap_turns:int>, chunks array<{CHUNK}>"
QUESTION = "id string, category string, question string, relevant_chunk_ids array<string>, target_keywords array<string>, gold_answer string"
ANSWER_ITEM = "struct<id:string,category:string,answer_mode:string,question:string,relevant_chunk_ids:array<string>,target_keywords:array<string>,expected_behavior:string,required_points:array<string>,forbidden_claims:array<string>,grading_focus:array<string>,gold_answer:string>"
ANSWER_SET = f"schema_version string, dataset_name string, description string, usage_policy struct<gold_answer_restriction:string>, items array<{ANSWER_ITEM}>"
ANSWER = "id string, category string, question string, answer string, expected_behavior string, gold_answer string, required_points array<string>, forbidden_claims array<string>, grading_focus array<string>, retrieved_chunks array<struct<chunk_id:string,text:string>>"
GRADED = "id string, category string, question string, answer string, expected_behavior string, evaluator_raw_scores map<string,double>"
FEEDBACK = "feedback_id string, recorded_at string, question_id string, category string, question string, answer string, expected_behavior string, teacher_scores map<string,double>, teacher_overall_score double, teacher_pass boolean, teacher_notes string, evaluator_scores map<string,double>"
POSITION = "struct<recorded_at:string,written:timestamp,file:string,block:bigint,line:bigint>"
QUESTION_ID = r"^Q\d{2}$"
CATEGORIES = ("수업 운영·피드백", "개념 설명", "문제 풀이", "교사-학생 대화")
BEHAVIOURS = ("direct", "inferred", "related_general", "out_of_scope")
UNCATEGORISED = "미분류"


def require(problems: DataFrame) -> None:
    """Raise ValueError with the first few problems, if there are any."""
    found = problems.limit(5).collect()
    if found:
        raise ValueError("; ".join(str(r.problem) for r in found))


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Chunk artifacts, one row for each file, with the file's name as ``artifact``."""
    return spark.read.schema(ARTIFACT).json(path, multiLine=True).withColumn("artifact", F.input_file_name())


def artifact_chunks(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("artifact", F.inline("chunks"))


def artifact_problems(artifacts: DataFrame) -> DataFrame:
    """Artifacts of another stage, without chunks, or whose indexes aren't 0, 1, 2 and so on, or with a blank text."""
    index = F.transform("chunks", lambda c: c["chunk_index"])
    n = F.size("chunks")
    wanted = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    problem = (
        F.when(F.coalesce(F.col("stage") != 2, F.lit(True)), "not a chunk artifact")
        .when(F.coalesce(n <= 0, F.lit(True)), "no chunks")
        .when(F.exists(index, lambda i: i.isNull() | (i < 0)), "a chunk index is not a natural number")
        .when(F.array_sort(index) != wanted, "chunk indexes are not 0, 1, 2 and so on")
        .when(F.exists("chunks", lambda c: F.coalesce(strip(c["text"]) == "", F.lit(True))), "a chunk has no text")
    )
    return artifacts.select("artifact", problem.alias("problem")).where("problem is not null")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return normalised_questions(spark.read.schema(QUESTION).json(path, multiLine=True))


def normalised_questions(items: DataFrame) -> DataFrame:
    """Stripped fields; arrays without blanks, each value once, in order."""

    def listed(c: str):
        return F.array_distinct(F.filter(F.transform(c, strip), lambda v: v != "")).alias(c)

    return items.select(*(strip(F.col(c)).alias(c) for c in ("id", "category", "question")), listed("relevant_chunk_ids"), listed("target_keywords"), strip(F.col("gold_answer")).alias("gold_answer"))


def question_problems(items: DataFrame, chunk_ids: DataFrame, id_pattern: str = QUESTION_ID, categories=CATEGORIES) -> DataFrame:
    """What is wrong with a question set: fields, ids, categories, and relevant chunks that don't exist."""

    def missing(c: str):
        return F.coalesce((F.size(c) if c in ("relevant_chunk_ids", "target_keywords") else F.length(c)) <= 0, F.lit(True))

    problem = F.when(F.coalesce(~F.col("id").rlike(id_pattern), F.lit(True)), "id")
    for c in ("question", "relevant_chunk_ids", "target_keywords", "gold_answer"):
        problem = problem.when(missing(c), c)
    if categories:
        problem = problem.when(F.coalesce(~F.col("category").isin(*categories), F.lit(True)), "category")
    own = items.select("id", problem.alias("field")).where("field is not null").select(F.concat(F.coalesce("id", F.lit("a question")), F.lit(": "), "field", F.lit(" is missing or wrong")).alias("problem"))
    twice = items.groupBy("id").count().where("count > 1").select(F.concat("id", F.lit(": not unique")).alias("problem"))
    wanted = items.select("id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    unknown = wanted.join(chunk_ids.select("chunk_id"), "chunk_id", "left_anti").select(F.concat("id", F.lit(": no chunk "), "chunk_id").alias("problem"))
    return own.unionByName(twice).unionByName(unknown)


def qrels(items: DataFrame) -> DataFrame:
    """qid, chunk_id of the relevant pairs."""
    return items.select(F.col("id").alias("qid"), F.explode("relevant_chunk_ids").alias("chunk_id")).distinct()


def read_answer_set(spark: SparkSession, path: str) -> DataFrame:
    """Items of an answer-evaluation dataset, with their position; a dataset without items raises."""
    rows = spark.read.schema(ANSWER_SET).json(path, multiLine=True).select(F.posexplode("items").alias("pos", "item")).select("pos", "item.*")
    if not rows.head(1):
        raise ValueError("the dataset has no items")
    return rows


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that are a JSON array or have one object on each line; question and answer sets are small."""
    whole = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("value"))
    is_array = F.startswith("value", F.lit("["))
    listed = F.from_json("value", f"array<struct<{schema}>>")
    each = F.transform(F.filter(F.split("value", r"\r?\n"), lambda v: strip(v) != ""), lambda v: F.from_json(v, f"struct<{schema}>"))
    return whole.select(F.explode(F.when(is_array, listed).otherwise(each)).alias("r")).select("r.*")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return normalised_answers(_records(spark, path, ANSWER))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Graded answers (GRADED), of a file with the array per_question or with one object on each line."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"per_question array<struct<{GRADED}>>").alias("r"))
    return whole.select(F.explode("r.per_question").alias("q")).select("q.*").unionByName(_records(spark, path, GRADED).where("id is not null"))


def normalised_answers(items: DataFrame) -> DataFrame:
    """Stripped fields, defaults, and retrieved chunks once each by id, the first one kept."""

    def listed(c: str):
        return F.coalesce(F.filter(F.transform(c, strip), lambda v: v != ""), F.array().cast("array<string>")).alias(c)

    def full(c: str):
        return F.nullif(strip(F.col(c)), F.lit(""))

    chunks = F.transform("retrieved_chunks", lambda c: F.struct(strip(c["chunk_id"]).alias("chunk_id"), strip(c["text"]).alias("text")))
    ids = F.transform(chunks, lambda c: c["chunk_id"])
    once = F.filter(chunks, lambda c, k: F.array_position(ids, c["chunk_id"]) == k + 1)
    return items.select(
        full("id").alias("id"), F.coalesce(full("category"), F.lit(UNCATEGORISED)).alias("category"), full("question").alias("question"), full("answer").alias("answer"),
        once.alias("retrieved_chunks"), full("expected_behavior").alias("expected_behavior"), full("gold_answer").alias("gold_answer"), listed("required_points"), listed("forbidden_claims"), listed("grading_focus"),
    )


def answer_problems(items: DataFrame) -> DataFrame:
    problem = (
        F.when(F.col("id").isNull() | F.col("question").isNull() | F.col("answer").isNull(), "id, question or answer is missing")
        .when(F.col("retrieved_chunks").isNull(), "no retrieved chunks")
        .when(F.exists("retrieved_chunks", lambda c: F.coalesce((c["chunk_id"] == "") | (c["text"] == ""), F.lit(True))), "a retrieved chunk lacks its id or text")
        .when(~F.col("expected_behavior").isin(*BEHAVIOURS), "unknown behaviour")
    )
    return items.select("id", F.concat(F.coalesce("id", F.lit("an answer")), F.lit(": "), problem).alias("problem")).where("problem is not null")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback records with their place in the log (``pos``), blank lines skipped; a log that isn't there has none.

    Lines of one file are in their order.  A log that was appended to is a folder of files: its records are in
    the order of their times, then of the files'.  ``pos`` is unique and only serves to compare.  A line that isn't
    JSON raises with its number.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"pos {POSITION}, {FEEDBACK}")
    lines = spark.read.text(path)
    one_file = len(lines.inputFiles()) == 1
    file = F.col("_metadata")
    lines = lines.select(file.getField("file_modification_time").alias("written"), file.getField("file_path").alias("file"), file.getField("file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    parsed = lines.withColumn("r", F.from_json("text", f"{FEEDBACK}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    rows = parsed.where(strip(F.col("text")) != "")
    bad = rows.where("r._bad is not null").select("file", "block", "line").orderBy("file", "block", "line").limit(1).collect()
    if bad:
        at = bad[0]
        before = lines.where((F.col("file") == at.file) & ((F.col("block") < at.block) | (F.col("block") == at.block) & (F.col("line") < at.line))).count()
        raise ValueError(f"not JSON in line {before + 1}")
    recorded = F.lit("") if one_file else F.coalesce("r.recorded_at", F.lit(""))
    return rows.select(F.struct(recorded.alias("recorded_at"), "written", "file", "block", "line").alias("pos"), "r.*").drop("_bad")
