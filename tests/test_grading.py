"""Loads, evaluation, calibration, answers, feedback and the commands."""

import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from turnstone import cli
from turnstone.functions import tagging
from turnstone.operators import answering, audit, calibration, evaluation, store
from turnstone.sources import datasets, sinks
from turnstone.streaming import feedback as stream

SIX = calibration.DIMENSIONS
LOG = datasets.FEEDBACK


def scores(value, **other):
    return {d: float(other.get(d, value)) for d in SIX}


def log(spark, rows):
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOG)


CHUNK_ROWS = [(0, ["T", "S"], "113번 문제는 기체 상태 변화입니다."), (1, ["T"], "숙제는 없어요.")]


def chunks_of(spark, lesson="L", rows=CHUNK_ROWS):
    return store.enrich(spark.createDataFrame([(lesson, *r) for r in rows], "lesson_id string, chunk_index int, speakers array<string>, text string"))


def test_tags(spark):
    a, b = chunks_of(spark).orderBy("chunk_index").collect()
    assert a.chunk_id == "L:chunk:0000" and list(a.question_numbers) == [113] and list(a.terms) == ["상태 변화", "기체"]
    assert list(a.topics) == ["상태 변화·열에너지", "문제 풀이"] and list(a.content_types) == ["문제 풀이", "교사-학생 대화"]
    assert list(b.topics) == ["숙제·퀴즈 피드백"] and list(b.content_types) == ["수업 운영·피드백"]
    row = spark.createDataFrame([("12번34번 5번 12345번 12 번 안녕",)], "t string").select(tagging.question_numbers(F.col("t")), tagging.topics(F.lit("안녕"))).first()
    assert list(row[0]) == [12, 34] and list(row[1]) == ["일반 수업 대화"]


def test_replace_and_validate(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_chunks(chunks_of(spark, "L1").unionByName(chunks_of(spark, "L2")), path)
    store.write_chunks(chunks_of(spark, "L1", [(0, ["T"], "새 수업")]), path)
    stored = store.read_chunks(spark, path)
    assert {(r.lesson_id, r["count"]) for r in stored.groupBy("lesson_id").count().collect()} == {("L1", 1), ("L2", 2)}
    good = store.validate_load(stored, chunks_of(spark, "L1", [(0, ["T"], "새 수업")]).unionByName(chunks_of(spark, "L2"))).collect()
    assert {r.status for r in good} == {"PASS"}
    bad = {r.lesson_id: r for r in store.validate_load(stored, chunks_of(spark, "L1").unionByName(chunks_of(spark, "L2"))).collect()}
    assert bad["L1"].status == "FAIL" and bad["L1"].stored == 1 and bad["L1"].fidelity == 0 and bad["L2"].status == "PASS"
    doubled = {r.lesson_id: r.duplicates for r in store.validate_load(stored.unionByName(stored), chunks_of(spark, "L2")).collect()}
    assert doubled["L2"] == 2
    lessons = spark.createDataFrame([("L1", "t")], "lesson_id string, title string")
    first = store.merge_lessons(None, lessons, F.lit("mon"))
    second = {r.lesson_id: r for r in store.merge_lessons(first, spark.createDataFrame([("L1", "new"), ("L3", "x")], "lesson_id string, title string"), F.lit("tue")).collect()}
    assert (second["L1"].created_at, second["L1"].updated_at, second["L1"].title) == ("mon", "tue", "new") and second["L3"].created_at == "tue"
    assert store.orphans(stored, lessons).count() == 2


def test_ranking_measures(spark):
    ranked = spark.createDataFrame([(1, c, k + 1) for k, c in enumerate("abcde")] + [(2, "x", 1)], "qid int, chunk_id string, rank int")
    good = spark.createDataFrame([(1, "b"), (1, "e"), (1, "z"), (2, "y"), (3, "x")], "qid int, chunk_id string")
    found = {(r.qid, r.k): r for r in evaluation.ranking_metrics(ranked, good).collect()}
    r = found[1, 5]
    gain = 1 / math.log2(3) + 1 / math.log2(6)
    ideal = sum(1 / math.log2(k + 1) for k in (1, 2, 3))
    assert (r.hit, r.precision, r.recall, r.mrr, r.first_rank) == (1.0, 0.4, pytest.approx(2 / 3), 0.5, 2) and r.ndcg == pytest.approx(gain / ideal)
    assert (found[1, 1].hit, found[1, 1].ndcg) == (0.0, 0.0) and found[3, 5].hit == 0 and found[2, 3].mrr == 0
    assert {r.qid for r in evaluation.failed(evaluation.ranking_metrics(ranked, good), 5).collect()} == {2, 3}
    for bad in ((), (0,), (51,)):
        with pytest.raises(ValueError):
            evaluation.check_ks(bad)


def test_chance_and_tail(spark):
    rows = spark.createDataFrame([(10, 0), (10, 3), (10, 6), (10, 7), (0, 0)], "n int, r int").select("n", "r", audit.chance(F.col("n"), F.col("r"), 5).alias("p")).collect()
    for r in rows:
        wanted = 0 if not r.r or not r.n else 1 if r.n - r.r < 5 else 1 - math.comb(r.n - r.r, 5) / math.comb(r.n, 5)
        assert r.p == pytest.approx(wanted)
    t = spark.range(1).select(*(audit.tail(F.array(F.lit(0.5), F.lit(0.25)), F.lit(k)) for k in range(4))).first()
    assert list(t) == pytest.approx([1, 0.625, 0.125, 0])


def test_latency_places(spark):
    for n in (1, 11, 19, 20, 60):
        r = evaluation.latency(spark.createDataFrame([(float(k),) for k in range(1, n + 1)], "ms double")).first()
        assert r.p95_ms == math.ceil(0.95 * n)


def test_offsets_and_weights(spark):
    assert {r.offset for r in calibration.offsets(log(spark, [{"teacher_scores": scores(4), "evaluator_scores": scores(3)}])).collect()} == {1.0}
    far = calibration.offsets(log(spark, [{"teacher_scores": scores(1), "evaluator_scores": scores(5)}, {"teacher_scores": scores(2)}])).collect()
    assert {r.offset for r in far} == {-1.0}
    five = [{"teacher_scores": scores(3, class_grounding=1 + k % 5), "teacher_overall_score": 20.0 * (1 + k % 5)} for k in range(5)]
    given = {d: w for d, _, w, _ in calibration.RUBRIC}
    assert {r.dim: r.weight for r in calibration.weights(log(spark, five)).collect()} == given
    six = {r.dim: r for r in calibration.weights(log(spark, five + five[:1])).collect()}
    assert six["class_grounding"].weight > given["class_grounding"] and six["class_grounding"].method == "learned"
    shares = {d: (1.0 if d == "class_grounding" else 0.05) / 1.25 for d in SIX}
    blend = {d: round(0.5 * given[d] + 0.5 * shares[d], 4) for d in SIX}
    assert all(six[d].weight == pytest.approx(blend[d] / sum(blend.values()), abs=1e-4) for d in SIX)
    empty = calibration.profile(log(spark, [])).first()
    assert empty.feedback_count == 0 and set(empty.offsets.values()) == {0.0} and empty.weights == given


def test_pearson_is_safe(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 5.0), (3, 1.0, 1.0), (3, 2.0, 4.0), (3, 4.0, 2.0)], "g int, x double, y double")
    found = {r.g: r.r for r in rows.groupBy("g").agg(calibration.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert found[1] == found[2] == 0 and found[3] == pytest.approx(statistics.correlation([1, 2, 4], [1, 4, 2]))


def test_grades(spark):
    row = calibration.profile(log(spark, [{"teacher_scores": scores(4), "evaluator_scores": scores(3)}]))
    answers = spark.createDataFrame([("a", scores(3), ["c1"], ["c1"]), ("b", scores(3), ["bad", "c1"], ["c1"]), ("c", scores(5, class_grounding=1), [], ["c1"])], "id string, scores map<string,double>, cited_chunk_ids array<string>, retrieved_ids array<string>")
    g = {r.id: r for r in calibration.grade(answers, row).collect()}
    assert g["a"].calibrated["class_grounding"] == 4.0 and g["a"].overall == 80.0 and g["a"].passed
    assert g["b"].calibrated["citation_traceability"] == 1.0 and list(g["b"].invalid_citations) == ["bad"] and g["b"].overall == 74.0
    assert not g["c"].passed and g["c"].overall > 70
    s = calibration.grading_summary(calibration.grade(answers, row)).first()
    assert s.questions == 3 and s.pass_rate == 0.6667
    bad = spark.createDataFrame([(scores(3),), ({"class_grounding": 1.0},), (scores(6),)], "s map<string,double>").select(calibration.score_problem(F.col("s"))).collect()
    assert bad[0][0] is None and bad[1][0] and bad[2][0]


def test_examples(spark):
    rows = [(k, b, k % 3) for k, b in enumerate(["direct", "direct", "inferred", None, None, "odd", "direct"])]
    found = calibration.select_examples(spark.createDataFrame(rows + [(7, "direct", 0)], "pos int, expected_behavior string, x int"), 4)
    assert [r.pos for r in found.collect()] == [7, 2, 5, 4]  # 0, 6 and 7 are equal records
    with pytest.raises(ValueError):
        calibration.select_examples(found, -1)


def test_guard(spark):
    def reply(scope, answer="답", cited=("c1", "x", "c1"), confidence="SURE"):
        return (scope, answer, " n ", list(cited), None, confidence, ["c1", "c2"])

    rows = [reply("DIRECT_CLASS"), reply("INFERRED_CLASS"), reply("RELATED_GENERAL", "직접 말한 것은 아니지만"), reply("OUT_OF_SCOPE"), reply("COURSE_INFO_MISSING", confidence="HIGH"), reply("NONE"), reply("DIRECT_CLASS", " ")]
    found = answering.guard(spark.createDataFrame(rows, answering.REPLY + ", retrieved_ids array<string>")).collect()
    assert [list(r.cited_chunk_ids) for r in found[:5]] == [["c1"], ["c1"], ["c1"], [], []]
    assert found[1].answer.endswith("답") and found[1].answer.startswith(answering.PREFIXES["INFERRED_CLASS"]) and found[2].answer == "직접 말한 것은 아니지만"
    assert found[3].answer == answering.SAFE_TEXTS["OUT_OF_SCOPE"] and found[0].confidence == "LOW" and found[4].confidence == "HIGH"
    assert [r.problem for r in found] == [None] * 5 + ["unknown scope", "empty answer"]


def test_answer_and_grade_flow(spark):
    chunks = chunks_of(spark)
    asked = spark.createDataFrame([(1, "기체?"), (2, "x" * 1001)], "qid int, text string")
    evidence = spark.createDataFrame([(1, 1, "L:chunk:0000", "기체")], "qid int, rank int, chunk_id string, text string")

    def model(prompt):
        assert "기체?" in prompt and "gold" not in prompt
        return "```json\n" + json.dumps({"scope": "DIRECT_CLASS", "answer": "기체입니다", "cited_chunk_ids": ["L:chunk:0000", "made up"], "confidence": "HIGH"}) + "\n```"

    r, refused = answering.answer(asked, evidence, answering.overview(chunks), model).orderBy("qid").collect()
    assert refused.qid == 2 and refused.problem and r.problem is None
    assert r.qid == 1 and list(r.cited_chunk_ids) == ["L:chunk:0000"] and r.problem is None
    items = datasets.normalised_answers(spark.createDataFrame([("i", None, " q ", "a", "direct", "the gold", None, None, None, [("c", "t"), ("c", "u")])], datasets.ANSWER))
    assert datasets.answer_problems(items).count() == 0 and items.first().category == datasets.UNCATEGORISED and len(items.first().retrieved_chunks) == 1
    row = calibration.profile(log(spark, []))
    graded = answering.grade_answers(items, row, log(spark, []), lambda p: {"scores": scores(4), "cited_chunk_ids": ["c"]} if "the gold" in p else {})
    assert calibration.grade(graded.select("id", "scores", "cited_chunk_ids", "retrieved_ids"), row).first().overall == 80.0


def test_retries():
    calls, waits = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise ConnectionError
        return '{"a": 1}'

    assert answering.with_retries(flaky, wait=waits.append)("p") == {"a": 1} and len(waits) == 2 and 1 <= waits[0] < 1.3 and 2 <= waits[1] < 2.3

    def refused(prompt):
        error = RuntimeError()
        error.status = 400
        raise error

    with pytest.raises(RuntimeError):
        answering.with_retries(refused, wait=waits.append)("p")


def test_question_problems(spark):
    chunks = chunks_of(spark)
    rows = [("Q01", "개념 설명", "q", ["L:chunk:0000"], ["k"], "g"), ("Q01", "개념 설명", "q", ["L:chunk:0009"], ["k"], "g"), ("Q2", "개념 설명", "q", ["L:chunk:0001"], ["k"], "g"), ("Q03", "?", "q", ["L:chunk:0001"], ["k", " "], "g"), ("Q04", "개념 설명", "q", [], ["k"], "g")]
    items = datasets.normalised_questions(spark.createDataFrame(rows, datasets.QUESTION))
    found = sorted(r.problem for r in datasets.question_problems(items, chunks).collect())
    assert found == ["Q01: no chunk L:chunk:0009", "Q01: not unique", "Q03: category is missing or wrong", "Q04: relevant_chunk_ids is missing or wrong", "Q2: id is missing or wrong"]
    with pytest.raises(ValueError):
        datasets.require(datasets.question_problems(items, chunks))


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "log")
    good = log(spark, [{"question_id": "Q01", "question": "q", "answer": "a", "teacher_scores": scores(4)}])
    sinks.append_feedback(good, path)
    sinks.append_feedback(good.withColumn("teacher_scores", F.lit(None).cast("map<string,double>")).withColumn("teacher_scores", F.map_from_arrays(F.array(*map(F.lit, SIX)), F.array(*[F.lit(2.0)] * 6))), path)
    rows = spark.read.schema(LOG).json(path).collect()
    assert sorted(r.teacher_pass for r in rows) == [False, True] and all(r.feedback_id and r.recorded_at for r in rows)
    for bad in ({"question": ""}, {"teacher_scores": {}}, {"teacher_overall_score": 101.0}, {"expected_behavior": "x"}):
        with pytest.raises(ValueError):
            sinks.append_feedback(log(spark, [{"question_id": "Q01", "question": "q", "answer": "a", "teacher_scores": scores(4), **bad}]), path)
    (tmp_path / "f.jsonl").write_text('{"question_id": "a"}\n\nnot json\n')
    with pytest.raises(ValueError, match="line 3"):
        datasets.read_feedback(spark, str(tmp_path / "f.jsonl"))
    query = stream.offsets_stream(stream.feedback_stream(spark, path)).writeStream.format("memory").queryName("offs").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("offs").count() == 6


def test_feedback_log_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "log")
    assert datasets.read_feedback(spark, path).count() == 0
    for n in range(4):
        row = {"question_id": f"q{n}", "question": f"q{n}", "answer": "a", "teacher_scores": scores(2 + n % 2), "expected_behavior": "direct" if n < 3 else "inferred"}
        sinks.append_feedback(log(spark, [row]).withColumn("recorded_at", F.lit(f"2024-01-0{n + 1}T00:00:00Z")).coalesce(1), path)
    rows = datasets.read_feedback(spark, path)
    assert [r.question_id for r in rows.orderBy("pos").collect()] == ["q0", "q1", "q2", "q3"]
    assert rows.select("pos").distinct().count() == 4
    chosen = calibration.select_examples(rows, 6).collect()
    assert [r.question_id for r in chosen] == ["q2", "q3", "q1", "q0"]
    lines = [json.dumps({"question_id": f"L{k}", "recorded_at": f"2024-01-{20 - k:02d}"}) for k in range(9)]
    (tmp_path / "one.jsonl").write_text("\n\n".join(lines) + "\n")  # one file is read in its own order
    assert [r.question_id for r in datasets.read_feedback(spark, str(tmp_path / "one.jsonl")).orderBy("pos").collect()] == [f"L{k}" for k in range(9)]


def test_questions_that_cannot_be_asked(spark):
    chunks = store.enrich(chunks_of(spark))
    asked = spark.createDataFrame([(1, "x" * 1001), (2, " "), (3, None), (4, "열용량이란? " + "y" * 900)], "qid int, text string")
    evidence = spark.createDataFrame([(4, 1, "c1", "t")], "qid int, rank int, chunk_id string, text string")
    seen = spark.sparkContext.accumulator(0)

    def model(prompt):
        seen.add(1)
        return {"scope": "DIRECT_CLASS", "answer": "답", "cited_chunk_ids": ["c1"], "confidence": "HIGH"}

    rows = {r.qid: r for r in answering.answer(asked, evidence, answering.overview(chunks), model).collect()}
    assert seen.value == 1 and len(rows) == 4
    assert "1000" in rows[1].problem and "empty" in rows[2].problem and "empty" in rows[3].problem
    assert rows[4].problem is None and rows[4].answer == "답" and rows[4].cited_chunk_ids == ["c1"]


def test_a_failed_load_changes_nothing(spark, tmp_path):
    home = str(tmp_path / "home")
    lessons = spark.createDataFrame([("L", "t", "2024-01-02", "s", "ko", "f")], "lesson_id string, title string, lesson_date string, subject string, language string, source_file string")
    good = store.enrich(chunks_of(spark))
    assert [r.status for r in store.load_lessons(spark, home, good, lessons).collect()] == ["PASS"]
    before = sorted(map(repr, store.read_chunks(spark, f"{home}/chunks").collect()))
    created = store.read_lessons(spark, home).first().created_at
    again = good.unionByName(good)  # each chunk twice
    assert [r.status for r in store.load_lessons(spark, home, again, lessons).collect()] == ["FAIL"]
    lost = store.load_lessons(spark, home, good.withColumn("lesson_id", F.lit("M")), lessons).collect()
    assert [(r.status, r.orphans > 0) for r in lost] == [("FAIL", True)]
    with pytest.raises(Exception):
        store.load_lessons(spark, home, good.withColumn("text", F.raise_error(F.lit("broken"))), lessons)
    assert sorted(map(repr, store.read_chunks(spark, f"{home}/chunks").collect())) == before
    assert sorted(p.name for p in (tmp_path / "home").iterdir()) == ["chunks", "lessons"]
    assert [r.status for r in store.load_lessons(spark, home, good.limit(1), lessons).collect()] == ["PASS"]
    row = store.read_lessons(spark, home).first()
    assert store.read_chunks(spark, f"{home}/chunks").count() == 1 and row.created_at == created < row.updated_at


def canned_model(prompt):
    """Stands for a model in the commands' tests: answers, or grades if it is asked to."""
    if prompt.startswith("Grade"):
        return {"scores": scores(4), "cited_chunk_ids": ["L:chunk:0000"]}
    assert "gold" not in prompt
    return json.dumps({"scope": "DIRECT_CLASS", "answer": "열량입니다", "cited_chunk_ids": ["L:chunk:0000", "x"], "confidence": "HIGH"})


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("**T:** 열용량은 온도를 올리는 열량입니다.\n**S:** 끓는점은 무엇인가요?\n", encoding="utf-8")
    out, kept = str(tmp_path / "chunks"), str(tmp_path / "kept")

    def run(arguments):
        assert cli.main(arguments, spark) == 0
        return capsys.readouterr().out.splitlines()

    assert cli.main(["chunk", str(tmp_path / "a.md"), "--output", out], spark) == 0
    assert '"parse_ok": true' in capsys.readouterr().out
    (tmp_path / "bad.md").write_text("lost\nlost too\n**T:** 열용량입니다.\n", encoding="utf-8")
    assert cli.main(["chunk", str(tmp_path / "bad.md"), "--output", str(tmp_path / "bad")], spark) == 1
    assert cli.main(["chunk", str(tmp_path / "none.md")], spark) == 2 == cli.main(["search", "x", "--store", str(tmp_path / "nothing")], spark)
    assert cli.main(["load", out, "--store", kept, "--lesson-id", "L"], spark) == 0
    capsys.readouterr()
    assert cli.main(["search", "열용량이", "--store", kept, "--topic", "열용량·비열"], spark) == 0
    assert '"rank": 1' in capsys.readouterr().out
    assert cli.main(["search", "!!", "--store", kept], spark) == 2
    questions = [{"id": "Q01", "category": "개념 설명", "question": "열용량", "relevant_chunk_ids": ["L:chunk:0000"], "target_keywords": ["열용량"], "gold_answer": "g"}]
    (tmp_path / "q.json").write_text(json.dumps(questions), encoding="utf-8")
    assert cli.main(["evaluate", str(tmp_path / "q.json"), "--store", kept, "--k", "1"], spark) == 0
    assert '"hit": 1.0' in capsys.readouterr().out
    assert cli.main(["audit", str(tmp_path / "q.json"), "--store", kept, "--output", str(tmp_path / "audit")], spark) == 0
    capsys.readouterr()
    (found,) = [json.loads(x) for x in run(["search", "열용량", "--store", kept, "--json"])]
    assert found["index"]["rebuilt"] is False and found["results"][0]["title"] == "a" and found["candidate_count"] == 1
    (row,) = [json.loads(x) for x in run(["search", "열용량", "--store", kept, "--show-chars", "6", "--metrics-dir", str(tmp_path / "m")])]
    assert len(row["preview"]) <= 7 and len(list((tmp_path / "m").iterdir())) == 1
    model = ["--model", "tests.test_grading:canned_model"]
    assert json.loads(run(["answer", "열용량이란?", "--store", kept, *model])[0])["cited_chunk_ids"] == ["L:chunk:0000"]
    assert cli.main(["answer", "x" * 1001, "--store", kept, *model], spark) == 2 == cli.main(["answer", "열용량", "--store", kept], spark)
    items = [{"id": f"E{k}", "question": "열용량은?", "answer_mode": "DIRECT_LESSON", "gold_answer": "gold", "required_points": ["p"]} for k in range(3)]
    (tmp_path / "set.json").write_text(json.dumps({"items": items}), encoding="utf-8")
    made, graded = str(tmp_path / "made"), str(tmp_path / "graded")
    assert cli.main(["generate", str(tmp_path / "set.json"), "--store", kept, "--limit", "2", "--output", made, *model], spark) == 0
    assert cli.main(["generate", str(tmp_path / "set.json"), "--store", kept, "--limit", "0", *model], spark) == 2
    answers = spark.read.json(made).orderBy("id").collect()
    assert [(r.id, r.expected_behavior, r.gold_answer, r.retrieved_chunks[0].chunk_id) for r in answers] == [(f"E{k}", "direct", "gold", "L:chunk:0000") for k in range(2)]
    log_path = str(tmp_path / "teacher")
    capsys.readouterr()
    dry = json.loads(run(["grade", made, "--feedback", log_path, "--dry-run"])[0])
    assert dry["question_count"] == 2 and dry["first_prompt"].startswith("Grade")
    assert json.loads(run(["grade", made, "--feedback", log_path, "--output", graded, *model])[0]) == {"questions": 2, "mean_overall": 80.0, "pass_rate": 1.0}
    six = [x for d in SIX for x in ("--score", f"{d}=3")]
    counts = json.loads(run(["feedback", log_path, "E1", "--evaluation", graded, *six])[0])
    assert counts["feedback_count"] == counts["paired_count"] == 1 and set(counts["offsets"].values()) == {-1.0}
    assert cli.main(["feedback", log_path, "E9", "--evaluation", graded, *six], spark) == 2
    served(spark, kept)
    command = ["feedback", str(tmp_path / "fb"), "Q01", "--question", "q", "--answer", "a", "--pass"]
    assert cli.main(command, spark) == 2
    assert cli.main([*command, *(x for d in SIX for x in ("--score", f"{d}=4"))], spark) == 0


def served(spark, kept):
    import threading
    import urllib.error
    import urllib.request
    from urllib.parse import quote

    web = cli.server(spark, kept, "127.0.0.1", 0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}{path}", timeout=60) as reply:
                return reply.status, json.loads(reply.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    try:
        assert get("/health") == (200, {"status": "ok"})
        status, found = get(f"/search?q={quote('열용량')}&top_k=1")
        assert status == 200 and found["results"][0]["chunk_id"] == "L:chunk:0000"
        assert get("/search?q=")[0] == 400 and get(f"/search?q={'x' * 1001}")[0] == 400 and get("/other")[0] == 404
        assert get("/lessons")[1]["lessons"][0]["lesson_id"] == "L"
    finally:
        web.shutdown()


def test_http_model(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Endpoint(BaseHTTPRequestHandler):
        calls = 0

        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["content-length"])))["prompt"]
            Endpoint.calls += 1
            self.send_response(503 if Endpoint.calls == 1 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"answer": prompt}).encode())

        def log_message(self, *_):
            pass

    web = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    waits = []
    call = answering.with_retries(answering.http_model(f"http://127.0.0.1:{web.server_port}", timeout=10), wait=waits.append)
    assert call("hello") == {"answer": "hello"} and len(waits) == 1
    web.shutdown()
