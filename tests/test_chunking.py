"""Splitting and packing against plain loops, and the readers' formats."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from turnstone.functions.text import canonical_json, clock, one_line, seconds, slug, strict_seconds, unquote
from turnstone.operators import chunking
from turnstone.sources import sinks, transcripts

TURN = "lesson string, turn_index int, speaker string, text string, source_line int, start_sec double, end_sec double"


def loop_split(text, budget):
    pieces, now = [], ""
    for sentence in re.split(r"(?<=[.!?。！？])\s+", text.strip()):
        for atom in sentence.split() if len(sentence) > budget else [sentence.strip()]:
            if now and len(now) + 1 + len(atom) > budget:
                pieces.append(now)
                now = atom
            elif atom:
                now = f"{now} {atom}".strip()
    return pieces + [now] if now else pieces or [text]


def loop_windows(sizes, target, overlap):
    out, start = [], 0
    while start < len(sizes):
        end, size = start, 0
        while end < len(sizes) and (end == start or size + 1 + sizes[end] <= target):
            size += sizes[end] + (end > start)
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        start = max(start + 1, end - overlap)
    return out


def test_split_equals_the_loop(spark):
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice("abc가") for _ in range(rnd.randrange(1, 30))) + rnd.choice(["", "", ".", "?", "。"]) for _ in range(rnd.randrange(1, 40))) for _ in range(150)] + ["", "  ", "x" * 500]
    rows = spark.createDataFrame([(k, t, b) for k, t in enumerate(texts) for b in (30, 100)], "k int, t string, b int").select("k", "b", chunking.split_long(F.col("t"), F.col("b")).alias("p")).collect()
    for r in rows:
        assert list(r.p) == loop_split(texts[r.k], r.b), texts[r.k]


@pytest.mark.parametrize("target, overlap", [(700, 1), (200, 0), (300, 3)])
def test_windows_equal_the_loop(spark, target, overlap):
    rnd = random.Random(overlap)
    cases = [[rnd.randrange(5, 400) for _ in range(rnd.randrange(0, 30))] for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, s array<int>").select("k", chunking.windows(F.col("s"), target, overlap).alias("w")).collect()
    for r in rows:
        assert [(w["first"], w["end"]) for w in r.w] == loop_windows(cases[r.k], target, overlap)


def test_long_turn(spark):
    turns = spark.createDataFrame([("a", 0, "T", "이것은 아주 긴 설명의 한 문장입니다. " * 20, 1, 0.0, 9.0)], TURN)
    chunks = chunking.build_chunks(turns, 200, 0)
    metrics = chunking.chunk_metrics(turns, chunks, 200).first()
    assert metrics.chunk_count > 1 and metrics.oversize_chunk_rate == 0 and metrics.source_turn_coverage_rate == 1
    assert chunks.agg(F.max("char_count")).first()[0] <= 200
    for bad in ((199, 1), (200, -1)):
        with pytest.raises(ValueError):
            chunking.build_chunks(turns, *bad)


MARKDOWN = '---\ntitle: "One lesson"\ndate: 2024-05-06\nkey_topics:\n  - heat\n  - \'steam\'\nother:\n  - lost\n---\n# heading\n\nstray line\n**T:** First words.\ngo on here\n\n**S:** A question?\n**T:** The end without stop'


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.md").write_text(MARKDOWN, encoding="utf-8-sig")
    (tmp_path / "b.txt").write_text("[00:00:00.500 - 00:00:05,250] [T] Hello there.\n\nno time here\n[1:02 - 1:03] [S] Bye", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"source": {"filename": "x.mp3"}, "transcription": {"detected_language": "ko", "created_at": "2024-01-02T03:04:05"}, "segments": [{"speaker": "T", "start_sec": 1.5, "end_sec": 2, "text": " Hi "}, {"text": " "}, {"text": "who", "start_time": "00:01:02.5", "end_time": "bad"}]}', encoding="utf-8")
    return tmp_path


def test_markdown(spark, folder):
    source = transcripts.files(spark, str(folder / "a.md"))
    turns = transcripts.load_turns(spark, str(folder / "a.md")).orderBy("turn_index").collect()
    assert [(t.turn_index, t.speaker, t.text, t.source_line) for t in turns] == [(0, "T", "First words. go on here", 13), (1, "S", "A question?", 16), (2, "T", "The end without stop", 17)]
    m = transcripts.markdown_metrics(source).first()
    assert (m.candidate_lines, m.parsed_lines, m.parse_rate, len(m.warnings)) == (5, 4, 0.8, 2) and m.warnings[0].endswith(": 12")
    f = transcripts.front_matter(source).first()
    assert f.metadata == {"title": "One lesson", "date": "2024-05-06"} and list(f.key_topics) == ["heat", "steam"]


def test_front_matter_must_close(spark):
    source = spark.createDataFrame([("x", "---\ntitle: a\n**T:** hi")], "lesson string, content string")
    assert transcripts.front_matter(source).first().metadata is None
    assert [t.text for t in transcripts.markdown_turns(source).collect()] == ["hi"]


def test_timed_text(spark, folder):
    turns = transcripts.load_turns(spark, str(folder / "b.txt")).orderBy("turn_index").collect()
    assert [(t.speaker, t.text, t.source_line, t.start_sec, t.end_sec) for t in turns] == [("T", "Hello there.", 1, 0.5, 5.25), (transcripts.UNKNOWN_SPEAKER, "no time here", 3, None, None), ("S", "Bye", 4, 62.0, 63.0)]
    assert transcripts.text_metrics(transcripts.files(spark, str(folder / "b.txt"))).first().timed_rate == 0.6667


def test_json(spark, folder):
    payload = transcripts.transcriptions(spark, str(folder / "c.json"))
    turns = transcripts.json_turns(payload).orderBy("turn_index").collect()
    assert [(t.turn_index, t.speaker, t.text, t.source_line, t.start_sec, t.end_sec) for t in turns] == [(0, "T", "Hi", 1, 1.5, 2.0), (1, transcripts.UNKNOWN_SPEAKER, "who", 3, 62.5, None)]
    m = transcripts.json_metadata(payload).first()
    assert (m.title, m.date, m.language) == ("x.mp3", "2024-01-02", "ko")
    assert transcripts.json_metrics(payload).first().parse_rate == 0.6667
    lines = [r.line for r in sinks.timed_lines(transcripts.normalised_segments(payload).where("end_sec is not null")).collect()]
    assert lines == ["[00:00:01.500 - 00:00:02.000] [T] Hi"]


def test_reader_registry_and_glossary(spark, tmp_path):
    with pytest.raises(ValueError):
        transcripts.load_turns(spark, "x.pdf")
    (tmp_path / "g.txt").write_text("# comment\nHeat\nheat\n\nＨＥＡＴ\nSteam\nStra\u00dfe\nSTRASSE\n", encoding="utf-8")
    (tmp_path / "g.json").write_text('["a", " A ", "b"]')
    assert [r.term for r in transcripts.glossary(spark, str(tmp_path / "g.txt")).orderBy("pos").collect()] == ["Heat", "ＨＥＡＴ", "Steam", "Stra\u00dfe"]
    assert [r.term for r in transcripts.glossary(spark, str(tmp_path / "g.json")).orderBy("pos").collect()] == ["a", "b"]


def test_text_functions(spark):
    rows = spark.createDataFrame([(v,) for v in ["", "75", "01:02", "1:00:00,5", "[02:03]", "x:1", "1:2:3:4"]], "t string")
    assert [r[0] for r in rows.select(seconds(F.col("t"))).collect()] == [None, 75.0, 62.0, 3600.5, 123.0, None, None]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(slug(F.lit("  2024 화학 Lesson!! "))) == "2024-화학-lesson" and one(slug(F.lit("!!"))) == "lesson"
    assert one(unquote(F.lit(" 'a\"b' "))) == 'a"b' and one(unquote(F.lit("\"a'"))) == "\"a'"
    assert one(clock(F.lit(3723.0456))) == "01:02:03.046" and one(one_line(F.lit("a \n b" + "c" * 20), 10)) == "a bcccccc…"


def test_strict_times(spark):
    good = spark.createDataFrame([("01:02",), (" ",), (None,)], "t string")
    assert [r[0] for r in good.select(strict_seconds(F.col("t"))).collect()] == [62.0, None, None]
    with pytest.raises(Exception, match="not a time: x:1"):
        spark.createDataFrame([("x:1",)], "t string").select(strict_seconds(F.col("t"))).collect()


def test_canonical_json(spark):
    rows = spark.createDataFrame([(({"b": 1, "a": None}, [("z", "é"), ("y", None)], None),)], "v struct<m:map<string,int>,l:array<struct<q:string,p:string>>,a:string>")
    (found,) = rows.select(canonical_json(F.col("v"), rows.schema["v"].dataType)).first()
    value = {"m": {"b": 1, "a": None}, "l": [{"q": "z", "p": "é"}, {"q": "y", "p": None}], "a": None}
    assert found == json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def test_file_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(256)) * 9)
    (row,) = transcripts.file_digests(spark, str(tmp_path / "a.bin")).collect()
    assert row.source_sha256 == hashlib.sha256(bytes(range(256)) * 9).hexdigest()
