"""Registered queries of the retrieval engine over the driver's tables, each as the operators compose it.

Documents are the chunk corpus (lesson: source), benchmark items the questions, conversations the
turns, labels the teacher's scores, events the feedback log.  A question's relevant chunks are the
documents that contain its text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import tagging
from turnstone.functions.rules import LATIN_EXACT, LATIN_TAGS, LATIN_TERMS
from turnstone.functions.text import lower_each
from turnstone.operators import answering, audit, bm25, calibration, chunking, evaluation, store
from turnstone.sources import datasets, sinks, transcripts
from turnstone.sources.shared import shared_dir

TOP_K, KS = 5, (1, 3, 5)
FILTERED = ("src1", "src3", "src5")
BEHAVIOURS = ("click", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("lesson_id"), F.col("doc_id").alias("chunk_index"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    """The index of the documents, stored in the shared folder; written anew if the table has changed."""
    home = f"{shared_dir(spark)}/bm25-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return bm25.ensure_index(corpus(spark, sf_dir), home, LATIN_EXACT)[0]


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, chunk_id: documents that contain a question's text.

    Candidates hold all its terms but the outermost, which may be glued to other letters; only these
    are read for the comparison of texts.
    """
    asked = questions(spark, sf_dir)
    inner = asked.withColumn("text", F.regexp_replace("text", r"^\S+\s+|\s+\S+$", ""))
    wanted = bm25.query_terms(inner, LATIN_EXACT)
    counts = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hits = index(spark, sf_dir).meet(wanted).groupBy("qid", "chunk_id").agg(F.count(F.lit(1)).alias("found"))
    full = hits.join(counts, "qid").where("found = n").select("qid", "chunk_id")
    texts = corpus(spark, sf_dir).select("chunk_id", F.col("text").alias("whole"))
    return full.join(asked, "qid").join(texts, "chunk_id").where(F.contains("whole", F.col("text"))).select("qid", "chunk_id")


def ranked(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    return bm25.search(index(spark, sf_dir), questions(spark, sf_dir), TOP_K, LATIN_EXACT, among)


def bm25_topk(spark, sf_dir):
    return ranked(spark, sf_dir)


def bm25_filtered(spark, sf_dir):
    return ranked(spark, sf_dir, corpus(spark, sf_dir).where(F.col("lesson_id").isin(*FILTERED)))


def bm25_candidates(spark, sf_dir):
    return bm25.candidate_counts(bm25.scores(index(spark, sf_dir), bm25.query_terms(questions(spark, sf_dir), LATIN_EXACT)))


def search_terms(spark, sf_dir):
    return bm25.query_terms(questions(spark, sf_dir), LATIN_TERMS)


def term_df_stats(spark, sf_dir):
    return bm25.term_stats(index(spark, sf_dir)).select("key", "df")


def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(index(spark, sf_dir)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def corpus_fingerprint(spark, sf_dir):
    return bm25.fingerprint(corpus(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("lesson"), F.col("turn").cast("int").alias("turn_index"), F.col("role").alias("speaker"), "text", (F.col("turn") + 1).cast("int").alias("source_line"), none.alias("start_sec"), none.alias("end_sec"))


def chunk_windows(spark, sf_dir):
    return chunking.build_chunks(turns(spark, sf_dir)).select("lesson", "chunk_index", "turn_start", "turn_end", F.array_join("speakers", ",").alias("speakers"), "char_count", "text")


def _metrics(spark, sf_dir):
    own = turns(spark, sf_dir)
    return chunking.chunk_metrics(own, chunking.build_chunks(own))


def chunk_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


def chunk_gate(spark, sf_dir):
    return chunking.chunk_gate(_metrics(spark, sf_dir)).select("lesson", "coverage_ok", "empty_ok", "oversize_ok", "duplicate_ok", "status")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    speakers = F.when(F.col("chunk_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return store.enrich(rows.withColumn("speakers", speakers), LATIN_TAGS)


def _listed(spark, sf_dir, column):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    tag = {"topics": tagging.topics, "terms": tagging.terms, "question_numbers": tagging.question_numbers}[column]
    return rows.select("doc_id", F.array_join(tag(F.col("text"), LATIN_TAGS).cast("array<string>"), ",").alias(column))


def topic_tags(spark, sf_dir):
    return _listed(spark, sf_dir, "topics")


def term_tags(spark, sf_dir):
    return _listed(spark, sf_dir, "terms")


def question_number_tags(spark, sf_dir):
    return _listed(spark, sf_dir, "question_numbers")


def content_type_tags(spark, sf_dir):
    return tags(spark, sf_dir).select(F.col("chunk_index").alias("doc_id"), F.array_join("content_types", ",").alias("content_types"))


def topic_distribution(spark, sf_dir):
    return store.distribution(tags(spark, sf_dir), "topics").orderBy(F.col("chunks").desc(), "value")


def content_type_distribution(spark, sf_dir):
    return store.distribution(tags(spark, sf_dir), "content_types").orderBy(F.col("chunks").desc(), "value")


def distinct_question_numbers(spark, sf_dir):
    return store.question_numbers(tags(spark, sf_dir)).orderBy("question_number")


def corpus_overview(spark, sf_dir):
    row = answering.overview(tags(spark, sf_dir))
    return row.select(F.array_join("topics", ",").alias("topics"), F.array_join("terms", ",").alias("terms"))


def load_validation(spark, sf_dir):
    wanted = corpus(spark, sf_dir).select("lesson_id", "chunk_index", F.sha2("text", 256).alias("content_sha256"), "text")
    return store.validate_load(tags(spark, sf_dir), wanted)


def ranking_metrics(spark, sf_dir):
    found = evaluation.ranking_metrics(ranked(spark, sf_dir), relevant(spark, sf_dir), KS)
    return found.select("qid", "k", *(F.round(m, 6).alias(m) for m in evaluation.METRICS), "first_rank")


def ranking_summary(spark, sf_dir):
    return evaluation.summary(evaluation.ranking_metrics(ranked(spark, sf_dir), relevant(spark, sf_dir), KS))


def metrics_by_category(spark, sf_dir):
    kinds = questions(spark, sf_dir).select("qid", F.concat(F.lit("c"), (F.col("qid") % 4).cast("string")).alias("category"))
    return evaluation.by_category(evaluation.ranking_metrics(ranked(spark, sf_dir), relevant(spark, sf_dir), KS), kinds, TOP_K)


def failed_questions(spark, sf_dir):
    return evaluation.failed(evaluation.ranking_metrics(ranked(spark, sf_dir), relevant(spark, sf_dir), KS), 1)


def keyword_diagnostics(spark, sf_dir):
    """Keywords: all distinct blank-separated words of each question."""
    words = questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("keyword"))
    good = evaluation.relevant_terms(relevant(spark, sf_dir), corpus(spark, sf_dir), LATIN_EXACT)
    return evaluation.keyword_diagnostics(words, good, LATIN_EXACT)


def keyword_rates(spark, sf_dir):
    return evaluation.keyword_rates(keyword_diagnostics(spark, sf_dir))


def _asked(spark, sf_dir):
    good = relevant(spark, sf_dir)
    return questions(spark, sf_dir).join(good.select("qid").distinct(), "qid", "left_semi"), good


def ablation_stability(spark, sf_dir):
    own, good = _asked(spark, sf_dir)
    return audit.ablation_stability(index(spark, sf_dir), own, good, TOP_K, LATIN_EXACT)


def _audited(spark, sf_dir):
    return audit.audit(index(spark, sf_dir), corpus(spark, sf_dir), questions(spark, sf_dir), relevant(spark, sf_dir), TOP_K, LATIN_EXACT, ("of", "the"))


def hit_audit(spark, sf_dir):
    found = _audited(spark, sf_dir)
    return found.select("qid", "hit", "first_rank", F.size("shared").alias("shared"), F.size("distinctive").alias("distinctive"), "trials", "stability", F.round("chance_1", 9).alias("chance_1"), F.round("chance_k", 9).alias("chance_k"), "class")


def chance_baseline(spark, sf_dir):
    counts = relevant(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("r")).crossJoin(corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")))
    return counts.select("qid", F.round(audit.chance(F.col("n"), F.col("r"), TOP_K), 9).alias("chance"))


def audit_summary(spark, sf_dir):
    """Observed and expected hits and the chance of as many (a Poisson-binomial tail)."""
    return audit.audit_summary(_audited(spark, sf_dir)).select("questions", "hits_1", "hits_k", "expected_1", "expected_k", "mean_stability", F.round("tail_1", 9).alias("tail_1"), F.round("tail_k", 9).alias("tail_k"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a teacher's scores, with made evaluator scores and overall scores."""
    doc = F.col("doc_id")
    teacher = [F.lit(2) + 2 * F.col("quality") if k % 2 else F.lit(4) - 2 * F.col("toxic") + (doc * (7 + k) + k) % 2 for k in range(6)]
    evaluator = [F.lit(1) + (doc * (k + 3)) % 5 for k in range(6)]
    dims = F.array(*map(F.lit, calibration.DIMENSIONS))
    overall = 20 + 60 * F.col("quality") - 10 * F.col("toxic") + doc % 10
    rows = read(spark, sf_dir, "labels")
    return rows.select("doc_id", F.map_from_arrays(dims, F.array(*(t.cast("double") for t in teacher))).alias("teacher_scores"), F.map_from_arrays(dims, F.array(*(e.cast("double") for e in evaluator))).alias("evaluator_scores"), overall.cast("double").alias("teacher_overall_score"))


def calibration_offsets(spark, sf_dir):
    return calibration.offsets(feedback(spark, sf_dir))


def calibration_weights(spark, sf_dir):
    return calibration.weights(feedback(spark, sf_dir)).select("dim", "weight", "method")


def weighted_scores(spark, sf_dir):
    given = F.create_map(*(x for d, _, w, _ in calibration.RUBRIC for x in (F.lit(d), F.lit(w))))
    return feedback(spark, sf_dir).select("doc_id", calibration.weighted(F.col("teacher_scores"), given).alias("overall"))


def _graded(spark, sf_dir):
    log = feedback(spark, sf_dir)
    cited = F.when(F.col("doc_id") % 3 == 0, F.array(F.col("doc_id"), F.lit(-1).cast("long"))).otherwise(F.array("doc_id"))
    answers = log.select(F.col("doc_id").alias("id"), F.col("teacher_scores").alias("scores"), cited.alias("cited_chunk_ids"), F.array("doc_id").alias("retrieved_ids"))
    return calibration.grade(answers, calibration.profile(log))


def graded_answers(spark, sf_dir):
    return _graded(spark, sf_dir).select("id", "overall", "passed", F.size("invalid_citations").alias("invalid"))


def grading_summary(spark, sf_dir):
    return calibration.grading_summary(_graded(spark, sf_dir))


def feedback_examples(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("expected_behavior"), F.get_json_object("props", "$.k").alias("k"), "user_id", F.round("value", 2).alias("value"))
    return calibration.select_examples(log, 6, BEHAVIOURS).select("pos", "expected_behavior", "user_id")


def citation_guard(spark, sf_dir):
    doc = F.col("doc_id")
    scope = F.element_at(F.array(*map(F.lit, answering.SCOPES)), (doc % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", scope.alias("scope"), F.col("text").alias("answer"), F.lit(" note ").alias("evidence_note"),
        F.array(doc.cast("string"), (doc + 1).cast("string"), doc.cast("string"), F.lit("x")).alias("cited_chunk_ids"), F.array(doc.cast("string"), (doc + 2).cast("string")).alias("retrieved_ids"),
        F.lit(None).cast("boolean").alias("used_general_knowledge"), F.when(doc % 2 == 0, "HIGH").otherwise("sure").alias("confidence"),
    )
    found = answering.guard(rows)
    return found.select("doc_id", "scope", "answer", F.array_join("cited_chunk_ids", ",").alias("cited"), "confidence", answering.behaviour(F.col("scope")).alias("behaviour"))


def _transcript(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """Conversations written as one text each: lesson, content."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(F.col("conv_id").alias("lesson")).agg(content.alias("content"))


def markdown_turns(spark, sf_dir):
    source = _transcript(spark, sf_dir, F.concat(F.lit("# heading\n\n**"), "role", F.lit(":** "), F.regexp_replace("text", r"\n+", "\n")))
    return transcripts.markdown_turns(source).select("lesson", "turn_index", "speaker", "text")


def text_turns(spark, sf_dir):
    stamp = F.format_string("[00:%02d:00.500 - 00:%02d:30,250] [%s] %s", F.col("turn"), F.col("turn"), "role", F.regexp_replace("text", r"\s+", " "))
    return transcripts.text_turns(_transcript(spark, sf_dir, stamp)).select("lesson", "turn_index", "speaker", "text", "start_sec", "end_sec")


def json_turns(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    segment = F.struct("turn", F.struct(F.col("role").alias("speaker"), F.when(F.col("turn") % 4 == 3, F.lit(" ")).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("start_sec"), F.lit(None).cast("string").alias("end_sec"), F.concat((F.col("turn") + 1).cast("string"), F.lit(":05")).alias("start_time"), F.lit("x").alias("end_time")).alias("s"))
    payload = rows.groupBy(F.col("conv_id").alias("lesson")).agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("segments"))
    return transcripts.json_turns(payload).select("lesson", "turn_index", "speaker", "source_line", "start_sec")


def front_matter(spark, sf_dir):
    head = F.concat(F.lit("---\ntitle: \"conversation "), F.col("conv_id").cast("string"), F.lit("\"\ndate: 2024-01-02\nkey_topics:\n  - one\n  - 'two'\nempty:\n  - lost\n---\n"))
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("lesson"), head.alias("content"))
    found = transcripts.front_matter(rows)
    return found.select("lesson", F.col("metadata")["title"].alias("title"), F.col("metadata")["date"].alias("date"), F.array_join("key_topics", ",").alias("key_topics"))


# letters as Hangul and digits as wide ones, so that the default rules (particles, grams, NFKC) have something to do
LETTERS, HANGUL = "abcdefghijklmnopqrstuvwxyz", "은는이가을를의와과도만에로요서부터까지나다라마바사열"
DIGITS, WIDE = "0123456789", "０１２３４５６７８９"


def _hangul(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.translate(F.lower("text"), LETTERS + DIGITS, HANGUL + WIDE))


def bm25_default_rules(spark, sf_dir):
    home = f"{shared_dir(spark)}/bm25-default-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    found, _ = bm25.ensure_index(_hangul(corpus(spark, sf_dir)), home)
    return bm25.search(found, _hangul(questions(spark, sf_dir)), TOP_K)


def search_terms_default_rules(spark, sf_dir):
    return bm25.query_terms(_hangul(questions(spark, sf_dir)))


def topic_chunks(spark, sf_dir):
    return bm25.by_topic(tags(spark, sf_dir), LATIN_TAGS.topics[2][0]).select(F.col("chunk_index").alias("doc_id"))


def question_number_chunks(spark, sf_dir):
    """Chunks of the smallest question number that there is."""
    rows = tags(spark, sf_dir)
    least = store.question_numbers(rows).agg(F.min("question_number").alias("number"))
    return rows.crossJoin(F.broadcast(least)).where(F.array_contains("question_numbers", F.col("number"))).select(F.col("chunk_index").alias("doc_id"))  # one row


def failed_filtered_questions(spark, sf_dir):
    """Questions whose relevant documents lie outside the sources that are searched, or low."""
    found = evaluation.ranking_metrics(bm25_filtered(spark, sf_dir), relevant(spark, sf_dir), KS)
    return evaluation.failed(found, 1)


def latency(spark, sf_dir):
    return evaluation.latency(read(spark, sf_dir, "events"), "value")


def score_problems(spark, sf_dir):
    """Scores of which some lack a dimension and some are out of bounds."""
    doc, dims = F.col("doc_id"), calibration.DIMENSIONS
    full = F.map_from_arrays(F.array(*map(F.lit, dims)), F.array(*((doc * (k + 3) % 6).cast("double") for k in range(6))))
    given = F.map_filter(full, lambda k, v: (doc % 4 != 0) | (k != dims[2]))
    return read(spark, sf_dir, "labels").select("doc_id", calibration.score_problem(given).alias("problem"))


def refused_questions(spark, sf_dir):
    """Documents as questions: blank and over-long ones have no prompt, and a reason."""
    asked = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 50 == 0, " \n ").otherwise(F.col("text")).alias("text"))
    none = spark.createDataFrame([], "qid long, rank int, chunk_id long, text string")
    found = answering.answer_prompts(asked, none, answering.overview(tags(spark, sf_dir)))
    return found.select("qid", F.col("prompt").isNotNull().alias("asked"), F.size("retrieved_ids").alias("sources"), "refused")


def answer_prompts(spark, sf_dir):
    """What each question's prompt was given: its evidence in order of rank, and whether the prompt quotes all of it."""
    evidence = ranked(spark, sf_dir).join(corpus(spark, sf_dir).select("chunk_id", "text"), "chunk_id").select("qid", "rank", "chunk_id", "text")
    found = answering.answer_prompts(questions(spark, sf_dir), evidence, answering.overview(tags(spark, sf_dir)))
    quoted = found.join(evidence.select("qid", "text"), "qid").groupBy("qid").agg(F.min(F.contains("prompt", F.to_json(F.struct("text")).substr(F.lit(2), F.lit(40)))).alias("quoted"))
    return found.join(quoted, "qid").select("qid", F.array_join("retrieved_ids", ",").alias("retrieved"), "quoted", "refused")


def feedback_log_examples(spark, sf_dir):
    """Labels appended to a log in four parts, read back, and the examples that a grader is shown."""
    home = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    rows = feedback(spark, sf_dir)
    behaviour = F.element_at(F.array(*map(F.lit, datasets.BEHAVIOURS)), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.col("doc_id").cast("string")
    records = rows.select(
        F.concat(F.lit("f"), name).alias("feedback_id"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("doc_id") % 4).cast("string"), 2, "0"), F.lit("."), F.lpad(name, 12, "0")).alias("recorded_at"), name.alias("question_id"),
        F.lit(None).cast("string").alias("category"), F.concat(F.lit("q"), name).alias("question"), F.lit("a").alias("answer"), F.when(F.col("doc_id") % 5 != 0, behaviour).alias("expected_behavior"), "teacher_scores", "teacher_overall_score",
        F.lit(None).cast("boolean").alias("teacher_pass"), F.lit(None).cast("string").alias("teacher_notes"), "evaluator_scores", (F.col("doc_id") % 4).alias("part"),
    )
    for part in range(4):
        sinks.append_feedback(records.where(F.col("part") == part).drop("part"), home)
    return calibration.select_examples(datasets.read_feedback(spark, home), 6).select("question_id", "expected_behavior", "category", "teacher_pass")


def question_set_problems(spark, sf_dir):
    """Benchmark items as a question set with faults of every kind, against the documents' ids."""
    item = F.col("item_id")
    text = lambda c, no: F.when(item % 7 != no, c)
    raw = read(spark, sf_dir, "benchmark").select(
        F.when(item % 11 == 0, "Q01").when(item % 11 == 1, F.concat(F.lit("X"), item.cast("string"))).otherwise(F.concat(F.lit(" Q"), F.lpad((item % 100).cast("string"), 2, "0"), F.lit(" "))).alias("id"),
        F.when(item % 9 == 0, "other").otherwise("a").alias("category"), text(F.col("text"), 1).alias("question"),
        F.array(item.cast("string"), F.lit(" "), item.cast("string"), F.when(item % 6 == 0, "none").otherwise((item + 1).cast("string"))).alias("relevant_chunk_ids"),
        F.when(item % 7 == 2, F.array(F.lit(" "))).otherwise(F.array(F.lit("k"), F.lit("k "))).alias("target_keywords"), text(F.lit(" g "), 3).alias("gold_answer"),
    )
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return datasets.question_problems(datasets.normalised_questions(raw), ids, categories=("a",)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def normalised_answers(spark, sf_dir):
    """Conversation turns as answers, some of them faulty: what is read, and what is wrong."""
    turn = F.col("turn")
    chunk = lambda i, t: F.struct(i.cast("string").alias("chunk_id"), t.alias("text"))
    raw = read(spark, sf_dir, "conversations").select(
        F.concat(F.lit(" "), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string")).alias("id"), F.when(turn % 2 == 0, " ").otherwise("c ").alias("category"), F.col("role").alias("question"),
        F.when(turn % 5 == 4, " ").otherwise(F.col("text")).alias("answer"), F.when(turn % 3 == 2, "odd").when(turn % 3 == 1, "direct").alias("expected_behavior"), F.lit(None).cast("string").alias("gold_answer"),
        F.array(F.lit(" p "), F.lit(""), F.lit("p")).alias("required_points"), F.lit(None).cast("array<string>").alias("forbidden_claims"), F.array().cast("array<string>").alias("grading_focus"),
        F.array(chunk(turn, F.lit("x")), chunk(turn + 1, F.when(turn % 4 == 3, " ").otherwise("y")), chunk(turn, F.lit("z"))).alias("retrieved_chunks"),
    )
    read_ = datasets.normalised_answers(raw)
    found = read_.join(datasets.answer_problems(read_), "id", "left")
    held = F.array_join(F.transform("retrieved_chunks", lambda c: F.concat(c["chunk_id"], c["text"])), ",")
    return found.select("id", "category", F.array_join("required_points", ",").alias("points"), F.size("forbidden_claims").alias("claims"), held.alias("chunks"), "problem")


def artifact_problems(spark, sf_dir):
    """Conversations as chunk artifacts, of which some have another stage, a gap in the indexes, or a blank text."""
    conv, turn = F.col("conv_id"), F.col("turn")
    chunk = F.struct(F.when((conv % 5 == 1) & (turn > 0), turn + 1).otherwise(turn).cast("int").alias("chunk_index"), F.when((conv % 5 == 2) & (turn == 1), " \n").otherwise(F.col("text")).alias("text"))
    rows = read(spark, sf_dir, "conversations").groupBy(conv.cast("string").alias("artifact")).agg(F.when(F.first(conv) % 5 == 3, 1).otherwise(2).alias("stage"), F.collect_list(chunk).alias("chunks"))
    return datasets.artifact_problems(rows)


def glossary_terms(spark, sf_dir):
    """Distinct words of the benchmark but for case, in the spelling that comes first."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[ \t\n\f\r]+")).alias("k", "term"))
    return transcripts.unique_terms(words.select((F.col("item_id") * 100_000 + F.col("k")).alias("pos"), "term"), lower_each)


def markdown_parse_metrics(spark, sf_dir):
    """Conversations as files in which some first turns have lost their speaker."""
    line = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), F.lit("lost line")).otherwise(F.concat(F.lit("**"), "role", F.lit(":** "), F.regexp_replace("text", r"\s+", " ")))
    found = transcripts.markdown_metrics(_transcript(spark, sf_dir, line))
    return found.select("lesson", "candidate_lines", "parsed_lines", "parse_rate", F.array_join(F.filter("warnings", lambda w: F.startswith(w, F.lit("lines"))), ";").alias("lost"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_filtered, bm25_candidates, search_terms, term_df_stats, corpus_stats, corpus_fingerprint, chunk_windows, chunk_metrics, chunk_gate,
        topic_tags, term_tags, question_number_tags, content_type_tags, topic_distribution, content_type_distribution, distinct_question_numbers, corpus_overview, load_validation,
        ranking_metrics, ranking_summary, metrics_by_category, failed_questions, keyword_diagnostics, keyword_rates, ablation_stability, hit_audit, chance_baseline, audit_summary,
        calibration_offsets, calibration_weights, weighted_scores, graded_answers, grading_summary, feedback_examples, citation_guard, markdown_turns, text_turns, json_turns, front_matter,
        bm25_default_rules, search_terms_default_rules, topic_chunks, question_number_chunks, failed_filtered_questions, latency, score_problems, refused_questions, answer_prompts,
        feedback_log_examples, question_set_problems, normalised_answers, artifact_problems, glossary_terms, markdown_parse_metrics,
    )
}
