"""Mixing: targets, rounding, reruns."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnstone.llm import mixing

SF = "/root/testdata/sf0.01"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Full sources are set aside until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        full |= set(over)


def check(rows, found):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    target = brute_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source_size) for r in found) == Counter((i, words(t), sizes[s]) for i, t, s in rows)
    taken, most = Counter(), Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or int(ratio - 1e-9) * r.size <= r.taken <= (int(ratio + 1e-9) + 1) * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s] + 1e-6


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    found = mixing.mix(docs).collect()
    check(rows, found)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


@pytest.mark.parametrize("seed", range(3))
def test_skewed_and_odd_sources(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 3, 50])), rnd.choice(["a", "a", "a", "a", "b", "c", "Z", "é", None])) for k in range(900)]
    rows += [(2000, None, "empty"), (2001, "", "empty"), (None, "null id", "a"), (5, "twice twice", "a"), (5, "twice twice", "a"), (2002, "  a b\x0bc", "one"), (2003, "y" * 100_000, "long")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, key int, target double")
    check(rows, mixing.mix(docs, seed=seed).collect())


def test_repeated_rows_are_rounded_among_themselves(spark):
    """A thousand equal rows, over half of their source, take about their share, not all or none of it."""
    rows = [(7, " ".join(["w"] * 20), "a")] * 1000 + [(8, "x y z", "a")] * 40 + [(9, "x y z v", "a"), (None, "q r", "a"), (None, "q r", "a")]
    rows += [(k, " ".join(["v"] * (1 + k % 30)), "b") for k in range(100, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    check(rows, found)
    assert len({r.copies for r in found if r.doc_id == 7}) == 2
    again = mixing.mix(docs.repartition(9)).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert Counter(r.doc_id for r in mixing.repeat(docs).collect())[7] == sum(r.copies for r in found if r.doc_id == 7)


def test_repeat_of_clashing_names_and_empty_tables(spark):
    schema = "doc_id long, text string, source string, __copy int, __size int, copies int, at long, size long, `key` string, `a.b` int"
    rows = [(k, f"w{k} x", "ab"[k % 2], 1, 2, 3, 4, 5, "k", k) for k in range(30)] + [(None, "n n n", None, None, None, None, None, None, None, None), (50, None, "a", 1, 1, 1, 1, 1, "z", 1), (51, "", "a", 1, 1, 1, 1, 1, "z", 1)]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    copies = Counter((r.doc_id, r.copies) for r in mixing.mix(docs).collect())
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in copies if c}) and {50, 51}.isdisjoint(r.doc_id for r in out.collect())
    assert set(map(tuple, out.collect())) <= set(rows)
    assert mixing.repeat(docs.limit(0)).count() == 0 and mixing.repeat(docs.limit(0)).columns == docs.columns


def test_expectations(spark):
    """Over many seeds a document is taken as often as its source's ratio says."""
    rows = [(k, " ".join(["w"] * (1 + k % 9)), "ab"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, n = Counter(), 12
    for seed in range(n):
        found = mixing.mix(docs, seed=seed).collect()
        ratio = {r.source: r.target / r.source_size for r in found}
        for r in found:
            total[r.source] += r.taken / r.size
    for s in "ab":
        assert total[s] / (30 * n) == pytest.approx(ratio[s], abs=0.08)


def test_levels_of_the_tree(spark):
    rows = [(k, " ".join(["w"] * (1 + k % 7)), "ab"[k % 2]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, mixing.BLOCK = mixing.BLOCK, 4
    old = mixing.pivotal_round.__defaults__
    try:
        mixing.pivotal_round.__defaults__ = (4,)
        check(rows, mixing.mix(docs).collect())
    finally:
        mixing.BLOCK, mixing.pivotal_round.__defaults__ = block, old


def test_empty_and_blank(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    found = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], schema)).collect()
    assert [(r.target, r.taken) for r in found] == [(0.0, 0), (0.0, 0)]


def test_repeat_has_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in copies.items() if c})


def test_no_python_on_the_executors(spark):
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("at_once", [mixing.AT_ONCE, 0])
def test_repeat_of_many_rows(spark, monkeypatch, at_once):
    """Each row as often as `mix` says, in several blocks of rows; texts are not shuffled while their copies can be broadcast."""
    monkeypatch.setattr(mixing, "AT_ONCE", at_once)
    text = F.when(F.col("id") % 9 == 0, None).otherwise(F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7).cast("int"))))
    docs = spark.range(0, 20_000, 1, 3).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), F.col("id") % 5 % 3).alias("source"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixing.repeat(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    assert found == Counter({tuple(r): copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]})
    assert ("SortMergeJoin" in plan) == (not at_once)
