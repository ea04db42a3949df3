"""Terms and BM25: Korean rules, and scores against SQLite's full-text search."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from turnstone.functions import terms
from turnstone.functions.rules import LATIN_EXACT, TermRules
from turnstone.operators import bm25
from turnstone.sources import datasets

RULES = TermRules()


def terms_of(spark, text, rules=RULES):
    r = spark.createDataFrame([(text,)], "t string").select(terms.search_terms(F.col("t"), rules).alias("s")).first().s
    return list(r.exact), list(r.ngram)


def test_particles_and_grams(spark):
    exact, ngram = terms_of(spark, "열용량이 비열은 ＡＢＣ 3.14")
    assert exact == sorted(["w열용량이", "w열용량", "w비열은", "w비열", "wabc", "w3.14"])
    assert "b열용" in ngram and "t열용량" in ngram and not any("abc" in g for g in ngram)


def test_first_listed_suffix_counts(spark):
    # '에서는' is listed before '는'; a root of one letter is not a term
    assert terms_of(spark, "학교에서는")[0] == ["w학교", "w학교에서는"]
    assert terms_of(spark, "나는")[0] == ["w나는"]
    assert terms_of(spark, "그 열 용량 응")[0] == ["w열용량"]


def test_ablations(spark):
    r = spark.createDataFrame([("alpha beta 그",), ("alpha",), ("",)], "t string").select(terms.ablations(F.col("t")).alias("a")).collect()
    assert [list(x.a) for x in r] == [["beta 그", "alpha 그", "alpha beta"], [], []]


CHUNKS = [
    ("c0", 0, "선생님: 열용량은 물질의 온도를 1도 올리는 데 필요한 열량입니다."), ("c1", 1, "학생: 끓는점에서는 온도가 왜 일정한가요?"), ("c2", 2, "선생님: 113번 문제는 상태 변화 그래프를 보면 됩니다."),
]


def test_small_corpus(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, chunk_index int, text string")
    index = bm25.build_index(chunks)
    found = bm25.search(index, spark.createDataFrame([(1, "열용량이 뭐야"), (2, "선생님")], "qid int, text string"), 2, order=chunks).collect()
    one = [r for r in found if r.qid == 1]
    assert one[0].chunk_id == "c0" and one[0].score > 0
    two = sorted((r.rank, r.chunk_id, r.candidate_count) for r in found if r.qid == 2)
    assert [r[0] for r in two] == [1, 2] and two[0][2] == 2
    with pytest.raises(ValueError):
        bm25.search(index, chunks, 0)
    with pytest.raises(ValueError):
        datasets.require(bm25.termless(spark.createDataFrame([(1, "그 저 !!")], "qid int, text string")))


def test_filters_leave_statistics(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, chunk_index int, text string")
    index, asked = bm25.build_index(chunks), spark.createDataFrame([(1, "열용량 끓는점")], "qid int, text string")
    whole = {r.chunk_id: r.score for r in bm25.search(index, asked, 5).collect()}
    part = bm25.search(index, asked, 5, among=chunks.where("chunk_id = 'c1'")).collect()
    assert [(r.chunk_id, r.score, r.candidate_count) for r in part] == [("c1", whole["c1"], 1)]


def fts_terms(text):
    """Terms by plain Python, for texts of Hangul syllables and numbers."""
    exact, ngram = set(), set()
    for token in re.findall(RULES.token_pattern.replace(r"\p{Nd}", r"\d"), text):
        if token in RULES.stopwords:
            continue
        forms = {token}
        if re.fullmatch("[가-힣]+", token):
            suffix = next((s for s in RULES.suffixes if token.endswith(s)), None)
            if suffix and len(token) - len(suffix) >= 2:
                forms.add(token[: -len(suffix)])
        for f in forms:
            exact.add("w" + f)
            if re.fullmatch("[가-힣]+", f):
                ngram |= {"b" + f[k : k + 2] for k in range(len(f) - 1)} | {"t" + f[k : k + 3] for k in range(len(f) - 2)}
    return sorted(exact), sorted(ngram)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_sqlite(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["열용량", "비열은", "끓는점에서", "온도", "기체가", "3", "3.14", "14", "3.5", "액체", "고체는", "문제", "x1", "abc"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 12))) for _ in range(50)]
    queries = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 4))) for _ in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, exact, ngram, tokenize='unicode61 remove_diacritics 2')")
    for k, t in enumerate(texts):
        e, n = fts_terms(t)
        con.execute("INSERT INTO f VALUES (?, ?, ?)", (k, " ".join(e), " ".join(n)))
    wanted = {}
    for q, text in enumerate(queries):
        e, n = fts_terms(text)
        parts = [f"{c}:(" + " OR ".join(f'"{t}"' for t in ts) + ")" for c, ts in (("exact", e), ("ngram", n)) if ts]
        for i, s in con.execute("SELECT id, -bm25(f, 0, 5.0, 1.0) FROM f WHERE f MATCH ?", (" OR ".join(parts),)):
            wanted[q, i] = s
    rules = TermRules(nfkc=False)
    index = bm25.build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string"), rules)
    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, text string")
    got = {(r.qid, r.chunk_id): r.score for r in bm25.scores(index, bm25.query_terms(asked, rules)).collect()}
    assert set(got) == set(wanted)
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in got)


def test_rank_ignores_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    runs = []
    for n in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(sorted(map(tuple, bm25.search(bm25.build_index(docs.repartition(n), LATIN_EXACT), asked, 5, LATIN_EXACT).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert runs[0] == runs[1]


def test_fingerprint_follows_content(spark):
    rows = [(k, f"text {k}") for k in range(30)]
    digest = lambda r: bm25.fingerprint(spark.createDataFrame(r, "chunk_id int, text string")).first().fingerprint
    assert digest(rows) == digest(rows[::-1]) != digest([*rows[:-1], (29, "other")])
    assert digest(rows) != digest(rows[:-1])


def test_a_stored_index_follows_its_table(spark, tmp_path):
    """It is written once, used again, and written anew when the corpus or the rules change; unfinished ones don't count."""
    import shutil

    rows = [(k, f"heat water steam {'ice' if k % 3 else 'salt'} {k}.5") for k in range(40)]
    docs = spark.createDataFrame(rows, "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "salt"), (2, "ice 7.5")], "qid int, text string")
    home = str(tmp_path / "index")
    stored, rebuilt = bm25.ensure_index(docs, home, LATIN_EXACT)
    assert rebuilt and not bm25.ensure_index(docs.repartition(3), home, LATIN_EXACT)[1]
    result = lambda index: sorted(map(tuple, bm25.search(index, asked, 5, LATIN_EXACT).collect()))
    assert result(stored) == result(bm25.build_index(docs, LATIN_EXACT)) == result(bm25.ensure_index(docs, home, LATIN_EXACT)[0])
    stats = lambda index: sorted(map(tuple, bm25.term_stats(index).collect()))
    assert stats(stored) == stats(bm25.build_index(docs, LATIN_EXACT))
    changed = docs.where("chunk_id <> 0").unionByName(spark.createDataFrame([(0, "salt salt only")], docs.schema))
    again, rebuilt = bm25.ensure_index(changed, home, LATIN_EXACT)
    assert rebuilt and result(again) == result(bm25.build_index(changed, LATIN_EXACT)) and len(list((tmp_path / "index").iterdir())) == 1
    (version,) = (tmp_path / "index").iterdir()
    shutil.rmtree(version / "frequencies")
    assert bm25.ensure_index(changed, home, LATIN_EXACT)[1]
    empty, _ = bm25.ensure_index(docs.limit(0), home, LATIN_EXACT)
    assert result(empty) == []


def test_queries_see_a_changed_table(spark, tmp_path):
    from turnstone.plans import queries

    def write(texts):
        spark.createDataFrame([(k, t, "src0") for k, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))

    spark.createDataFrame([(0, "blue whale")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    write(["a blue whale sings", "red fish", "green fish"])
    assert [r.chunk_id for r in queries.bm25_topk(spark, str(tmp_path)).collect()] == [0]
    write(["red fish", "green fish", "the blue whale", "blue sky"])
    spark.catalog.clearCache()
    assert [r.chunk_id for r in queries.bm25_topk(spark, str(tmp_path)).orderBy("rank").collect()] == [2, 3]


def test_search_scores_without_a_row_for_each_chunk_and_query(spark):
    """The plan makes rows for the best chunks alone, ties included; counts are of all chunks met."""
    docs = spark.createDataFrame([(k, f"common word{k % 7}") for k in range(900)], "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, f"common word{q}") for q in range(40)], "qid long, text string")
    index = bm25.build_index(docs)
    found = {}
    for r in bm25.search(index, asked, 3).collect():
        found.setdefault(r.qid, []).append((r["rank"], r.chunk_id, r.candidate_count))
    assert len(found) == 40 and all(sorted(v) == [(1, q % 7 if q < 7 else 0, 900), (2, q + 7 if q < 7 else 1, 900), (3, q + 14 if q < 7 else 2, 900)] for q, v in found.items())
    best = bm25._best(index, bm25.query_terms(asked), 3, None)
    assert best.where("n = 0 and qid < 7").count() < 7 * 3 * 160 and best.where("n > 0").groupBy("qid").sum("n").where("`sum(n)` = 900").count() == 40
