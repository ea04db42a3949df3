"""Commands over files and a store of lessons: chunk, load, search, evaluate, audit, answer, generate, grade, profile, feedback, serve.

Each exits with 0 if all went well, 1 if a gate failed, 2 on bad input.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions.text import one_line
from turnstone.operators import answering, audit, bm25, calibration, chunking, evaluation, store
from turnstone.sources import datasets, sinks, transcripts


def session() -> SparkSession:
    return SparkSession.builder.appName("turnstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def show(rows) -> None:
    for r in rows.collect():  # reports of bounded size
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def report(rows: DataFrame, path: str | None) -> None:
    """Print a report of bounded size and, if asked for, write it."""
    if path:
        sinks.write_report(rows, path)
        rows = rows.sparkSession.read.schema(rows.schema).json(path)
    show(rows)


def chunk(spark, a) -> int:
    turns, parsed, metadata = transcripts.load_transcripts(spark, a.transcript)
    turns = turns.cache()
    chunks = chunking.build_chunks(turns, a.target_chars, a.overlap_turns)
    metrics = chunking.chunk_metrics(turns, chunks, a.target_chars).join(parsed, "lesson", "left")
    item = F.struct(*(c for c in chunks.columns if c != "lesson"))
    artifact = chunks.groupBy("lesson").agg(F.array_sort(F.collect_list(item)).alias("chunks")).join(metadata, "lesson", "left")  # one lesson's chunks
    config = F.struct(F.lit(a.target_chars).alias("target_chars"), F.lit(a.overlap_turns).alias("overlap_turns"))
    sinks.write_report(artifact.select(F.lit(2).alias("stage"), F.col("lesson").alias("source_file"), F.struct("title", "date", "language").alias("source_metadata"), config.alias("chunking_config"), "chunks"), a.output)
    gate = chunking.chunk_gate(metrics)
    report(metrics.join(gate, "lesson"), a.metrics)
    return int(bool(gate.where("status = 'FAIL'").head(1)))


def load(spark, a) -> int:
    artifacts = datasets.read_artifact(spark, a.chunks)
    datasets.require(datasets.artifact_problems(artifacts))
    title = F.coalesce(F.nullif(F.col("source_metadata.title"), F.lit("")), transcripts.stem(F.col("source_file")))
    name = F.lit(a.lesson_id) if a.lesson_id else store.lesson_id(F.col("source_metadata.date"), transcripts.stem(F.col("source_file")))
    artifacts = artifacts.withColumn("lesson_id", name)
    lessons = artifacts.select("lesson_id", title.alias("title"), F.nullif(F.col("source_metadata.date"), F.lit("")).alias("lesson_date"), F.lit(a.subject).alias("subject"), F.coalesce("source_metadata.language", F.lit(store.LANGUAGE)).alias("language"), "source_file")
    found = store.load_lessons(spark, a.store, store.enrich(artifacts.select("lesson_id", F.inline("chunks"))), lessons)
    report(found, a.metrics)
    return int(bool(found.where("status = 'FAIL'").head(1)))


def _chunks(spark, home: str) -> DataFrame:
    try:
        return store.read_chunks(spark, f"{home}/chunks")
    except AnalysisException as error:
        raise ValueError(f"no lessons in {home}") from error


def _index(spark, home: str, chunks: DataFrame) -> tuple[bm25.Index, dict]:
    began = time.perf_counter()
    index, rebuilt = bm25.ensure_index(chunks, f"{home}/index")
    return index, {"rebuilt": rebuilt, "index_build_ms": round(1000 * (time.perf_counter() - began), 2)}


def found_chunks(spark, home: str, query: str, top_k: int = 5, lesson_id: str | None = None, topic: str | None = None, number: int | None = None) -> dict:
    """The best chunks for one query, with their lessons' titles and dates, and how long it took."""
    chunks = _chunks(spark, home)
    asked = spark.createDataFrame([(0, query)], "qid int, text string")
    datasets.require(bm25.termless(asked))
    index, state = _index(spark, home, chunks)
    among = chunks
    if lesson_id:
        among = among.where(F.col("lesson_id") == lesson_id)
    if topic:
        among = bm25.by_topic(among, topic)
    if number:
        among = bm25.by_question_number(among, number)
    began = time.perf_counter()
    found = bm25.search(index, asked, top_k, among=among if among is not chunks else None, order=chunks).join(chunks, "chunk_id")
    lessons = store.read_lessons(spark, home)
    if lessons is not None:
        found = found.join(F.broadcast(lessons.select("lesson_id", "title", "lesson_date").join(found.select("lesson_id"), "lesson_id", "left_semi")), "lesson_id", "left")  # top_k of them
    rows = [r.asDict(recursive=True) for r in found.orderBy("rank").drop("qid").collect()]  # top_k of them
    return {"query": query, "top_k": top_k, "candidate_count": rows[0]["candidate_count"] if rows else 0, "returned_count": len(rows), "query_latency_ms": round(1000 * (time.perf_counter() - began), 2), "index": state, "results": rows}


def search(spark, a) -> int:
    found = found_chunks(spark, a.store, a.query, a.top_k, a.lesson_id, a.topic, a.question_number)
    if a.metrics_dir:
        (name,) = spark.range(1).select(sinks.report_name(F.lit(a.query))).first()
        sinks.write_report(spark.createDataFrame([(json.dumps(found, ensure_ascii=False, default=str),)], "report string"), f"{a.metrics_dir}/query_{name}")
    if a.json:
        print(json.dumps(found, ensure_ascii=False, default=str))
        return 0
    for row in found["results"]:
        row["preview"] = spark.range(1).select(one_line(F.lit(row.pop("text")), a.show_chars)).first()[0]
        print(json.dumps(row, ensure_ascii=False, default=str))
    return 0


def _questions(spark, a):
    chunks = _chunks(spark, a.store)
    items = datasets.read_questions(spark, a.dataset)
    datasets.require(datasets.question_problems(items, chunks))
    return chunks, items.select(F.col("id").alias("qid"), F.col("question").alias("text"), "category", "target_keywords"), datasets.qrels(items)


def evaluate(spark, a) -> int:
    chunks, asked, good = _questions(spark, a)
    ks = evaluation.check_ks(a.k or evaluation.K_VALUES)
    index, state = _index(spark, a.store, chunks)
    began = time.perf_counter()
    found = evaluation.ranking_metrics(bm25.search(index, asked, ks[-1], order=chunks), good, ks).cache()
    n = max(1, found.select("qid").distinct().count())
    took = spark.createDataFrame([(1000 * (time.perf_counter() - began) / n,)], "ms double")  # the batch's time for each question
    rates = evaluation.keyword_rates(evaluation.keyword_diagnostics(asked.select("qid", F.explode("target_keywords").alias("keyword")), evaluation.relevant_terms(good, chunks, bm25.TermRules()), bm25.TermRules()))
    parts = [("summary", evaluation.summary(found).orderBy("k")), ("categories", evaluation.by_category(found, asked, ks[-1]).orderBy("category")), ("failed", evaluation.failed(found, ks[-1]).orderBy("qid")), ("keywords", rates), ("latency", evaluation.latency(took))]
    for name, rows in parts:
        report(rows, f"{a.output}/{name}" if a.output else None)
    return 0


def audit_hits(spark, a) -> int:
    chunks, asked, good = _questions(spark, a)
    found = audit.audit(_index(spark, a.store, chunks)[0], chunks, asked, good, a.top_k).cache()
    report(found.orderBy("qid"), a.output and f"{a.output}/questions")
    report(audit.audit_summary(found), a.output and f"{a.output}/summary")
    return 0


def _model(a):
    """The model that a command names: a function of a module, or an HTTP endpoint."""
    if a.model:
        module, _, name = a.model.partition(":")
        try:
            return getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError) as error:
            raise ValueError(f"no model {a.model}") from error
    if a.url:
        return answering.http_model(a.url)
    raise ValueError("name a model: --model module:function or --url")


def _evidence(spark, a, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, a.store)
    askable = asked.where(answering.question_problem(F.col("text")).isNull())
    found = bm25.search(_index(spark, a.store, chunks)[0], askable, a.top_k, order=chunks).join(chunks.select("chunk_id", "text"), "chunk_id")
    return found.select("qid", "rank", "chunk_id", "text"), answering.overview(chunks, store.read_lessons(spark, a.store))


def answer(spark, a) -> int:
    asked = spark.createDataFrame([("0", a.question)], "qid string, text string")
    datasets.require(asked.select(answering.question_problem(F.col("text")).alias("problem")).where("problem is not null"))
    evidence, overview = _evidence(spark, a, asked)
    found = answering.answer(asked, evidence, overview, _model(a)).cache()
    datasets.require(found.where("problem is not null"))
    show(found.drop("problem", "qid"))
    return 0


def generate(spark, a) -> int:
    """Answers to an evaluation dataset; gold answers join only after the model has answered."""
    if a.limit is not None and a.limit < 1:
        raise ValueError("--limit must be 1 or more")
    items = datasets.read_answer_set(spark, a.dataset)
    items = items.orderBy("pos").limit(a.limit) if a.limit else items
    asked = items.select(F.col("id").alias("qid"), F.col("question").alias("text"))
    evidence, overview = _evidence(spark, a, asked)
    found = answering.answer(asked, evidence, overview, _model(a)).cache()
    datasets.require(found.where("problem is not null").select(F.concat("qid", F.lit(": "), "problem").alias("problem")))
    held = evidence.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"))).alias("retrieved_chunks"))  # top_k of them
    rows = items.join(found.select(F.col("qid").alias("id"), "answer", F.col("scope").alias("answer_scope"), "cited_chunk_ids"), "id").join(held.withColumnRenamed("qid", "id"), "id", "left")
    behaviour = F.coalesce("expected_behavior", answering.behaviour_of_mode(F.col("answer_mode")))
    rows = rows.select("id", F.coalesce("category", F.lit(datasets.UNCATEGORISED)).alias("category"), "question", "answer", "answer_scope", "cited_chunk_ids", "retrieved_chunks", behaviour.alias("expected_behavior"), "required_points", "forbidden_claims", "grading_focus", "gold_answer")
    sinks.write_report(rows, a.output)
    print(json.dumps({"answers": rows.count(), "output": a.output}))
    return 0


def grade(spark, a) -> int:
    items = datasets.read_answers(spark, a.answers)
    datasets.require(datasets.answer_problems(items))
    log = datasets.read_feedback(spark, a.feedback)
    profile_row, examples = calibration.profile(log), calibration.select_examples(log, a.example_limit)
    if a.dry_run:
        first = answering.grader_prompts(items.orderBy("id").limit(1), profile_row, examples)
        report(profile_row.crossJoin(first.select(F.col("prompt").alias("first_prompt"))).crossJoin(items.agg(F.count(F.lit(1)).alias("question_count"))), a.output)
        return 0
    replies = answering.grade_answers(items, profile_row, examples, _model(a)).cache()
    datasets.require(replies.select(F.concat("id", F.lit(": "), calibration.score_problem(F.col("scores"))).alias("problem")).where("problem is not null"))
    graded = calibration.grade(replies, profile_row).join(items.select("id", "category", "question", "answer", "expected_behavior"), "id").withColumnRenamed("scores", "evaluator_raw_scores").cache()
    sinks.write_report(graded, a.output)
    show(calibration.grading_summary(graded))
    return 0


def profile(spark, a) -> int:
    show(calibration.profile(datasets.read_feedback(spark, a.feedback)))
    return 0


def given_scores(values: list[str]) -> dict[str, float]:
    """The six scores of 'dimension=score' arguments, each given once."""
    found: dict[str, float] = {}
    for value in values:
        name, equals, score = value.partition("=")
        name = name.strip()
        if not equals or name not in calibration.DIMENSIONS or name in found:
            raise ValueError(f"not a dimension and its score, or given twice: {value}")
        found[name] = float(score)
    missing = sorted(set(calibration.DIMENSIONS) - set(found))
    if missing:
        raise ValueError(f"no score for {', '.join(missing)}")
    return found


def feedback(spark, a) -> int:
    """Append a teacher's scores; question and answer come from a graded file, or from the arguments."""
    scores = given_scores(a.score)
    item = {"question": a.question, "answer": a.answer, "category": None, "expected_behavior": None, "evaluator_raw_scores": None}
    if a.evaluation:
        rows = datasets.read_evaluation(spark, a.evaluation).where(F.col("id") == a.question_id).limit(1).collect()
        if not rows:
            raise ValueError(f"no question {a.question_id} in {a.evaluation}")
        item = rows[0].asDict(recursive=True)
    row = (a.question_id, item["category"], item["question"], item["answer"], item["expected_behavior"], scores, a.overall_score, a.verdict, a.notes, item["evaluator_raw_scores"])
    schema = "question_id string, category string, question string, answer string, expected_behavior string, teacher_scores map<string,double>, teacher_overall_score double, teacher_pass boolean, teacher_notes string, evaluator_scores map<string,double>"
    rows = spark.createDataFrame([row], schema)
    for name in ("feedback_id", "recorded_at"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    sinks.append_feedback(rows.coalesce(1), a.feedback)
    show(calibration.profile(datasets.read_feedback(spark, a.feedback)).select("feedback_count", "paired_count", "offsets"))
    return 0


MOST_QUERY_CHARS = 1000


def server(spark, home: str, host: str, port: int) -> HTTPServer:
    """An HTTP server: GET /health, /lessons, and /search?q=...&top_k=&lesson_id=&topic=&question_number=, all JSON."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json; charset=utf-8")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            at = urlparse(self.path)
            one = {k: v[0].strip() for k, v in parse_qs(at.query).items()}
            try:
                if at.path == "/health":
                    self.reply(200, {"status": "ok"})
                elif at.path == "/lessons":
                    lessons = store.read_lessons(spark, home)
                    self.reply(200, {"lessons": [] if lessons is None else [r.asDict() for r in lessons.orderBy("lesson_date", "lesson_id").limit(answering.OVERVIEW).collect()]})
                elif at.path == "/search":
                    query = one.get("q", "")
                    if not query or len(query) > MOST_QUERY_CHARS:
                        raise ValueError(f"a query has 1 to {MOST_QUERY_CHARS} characters")
                    number = one.get("question_number")
                    self.reply(200, found_chunks(spark, home, query, int(one.get("top_k", 5)), one.get("lesson_id"), one.get("topic"), int(number) if number else None))
                else:
                    self.reply(404, {"error": "no such page"})
            except ValueError as error:
                self.reply(400, {"error": str(error)})

        def log_message(self, *_):
            pass

    return HTTPServer((host, port), Handler)


def serve(spark, a) -> int:
    server(spark, a.store, a.host, a.port).serve_forever()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnstone")
    commands = top.add_subparsers(required=True)

    def command(name, run, *arguments):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    def option(name, **options):
        return [name], options

    kept, top_k, output, metrics = option("--store", default="data/lessons"), option("--top-k", type=int, default=5), option("--output"), option("--metrics")
    model = option("--model", help="module:function"), option("--url")
    log = option("--feedback", default="artifacts/feedback")
    command("chunk", chunk, option("transcript"), option("--output", default="artifacts/chunks"), metrics, option("--target-chars", type=int, default=chunking.TARGET_CHARS), option("--overlap-turns", type=int, default=chunking.OVERLAP_TURNS))
    command("load", load, option("chunks"), kept, option("--lesson-id"), option("--subject", default=store.SUBJECT), metrics)
    command("search", search, option("query"), kept, top_k, option("--lesson-id"), option("--topic"), option("--question-number", type=int), option("--show-chars", type=int, default=350), option("--json", action="store_true"), option("--metrics-dir"))
    command("evaluate", evaluate, option("dataset"), kept, option("--k", type=int, action="append"), output)
    command("audit", audit_hits, option("dataset"), kept, top_k, output)
    command("answer", answer, option("question"), kept, top_k, *model)
    command("generate", generate, option("dataset"), kept, top_k, option("--limit", type=int), option("--output", default="artifacts/answers"), *model)
    command("grade", grade, option("answers"), log, option("--output", default="artifacts/grades"), option("--example-limit", type=int, default=6), option("--dry-run", action="store_true"), *model)
    command("profile", profile, option("feedback"))
    command("feedback", feedback, option("feedback"), option("question_id"), option("--evaluation"), option("--question"), option("--answer"), option("--score", action="append", default=[]), option("--overall-score", type=float), option("--pass", dest="verdict", action="store_true", default=None), option("--fail", dest="verdict", action="store_false"), option("--notes", default=""))
    command("serve", serve, kept, option("--host", default="127.0.0.1"), option("--port", type=int, default=8765))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        return a.run(spark or session(), a)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
