"""The corpus pipeline's stages, each against what its operator decides."""

from collections import Counter

import public_tokenizers

import corpus_pipeline
from turnstone.llm import decontaminate, mixing, neardup, toxicity

SF = "/root/testdata/sf0.01"


def brute_force_kept(rows, size=neardup.NEAR_SHINGLE, similarity=neardup.SIMILARITY):
    """The least id of each group of texts linked by the similarity of their sets of shingles."""
    groups, holders, root = {}, {}, []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        groups.setdefault(frozenset(tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, min(1, len(words))))), []).append(i)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, grams in enumerate(groups):
        root.append(k)
        shared = Counter(j for g in grams for j in holders.get(g, ()))
        for g in grams:
            holders.setdefault(g, []).append(k)
        for j, n in shared.items():
            if n >= similarity * (len(grams) + len(list(groups)[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, ids in enumerate(groups.values()):
        least[find(k)] = min([*ids, least.get(find(k), ids[0])])
    return least.values()


def test_stages_and_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append(now)
        if name != "token_files":
            assert now.columns == docs.columns
        ids = lambda d: Counter(r.doc_id for r in d.collect())
        if name == "toxicity":
            scores = toxicity.toxicity_scores(before, labels)
            assert ids(now) == ids(scores.where("predicted = 0"))
        elif name == "near_duplicates":
            assert ids(now) == Counter(brute_force_kept([(r.doc_id, r.text) for r in before.collect()]))
        elif name == "decontamination":
            assert ids(now) == ids(before) - ids(decontaminate.find_leaks(before, items).select("doc_id").distinct())
        elif name == "mixing":
            assert ids(now) == Counter({r.doc_id: r.copies for r in mixing.mix(before).where("copies > 0").collect()})
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            wanted = Counter((r.doc_id, 1 + len(t.encode(r.text, add_special_tokens=False).ids)) for r in before.collect())
            assert Counter((r.doc_id, r.n_tokens) for r in now.collect()) == wanted
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, now.collect()))


def test_stages_of_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int, at long, key string, copies int, `__kept` int"
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"{words} number {k * k} of {k}", "en", "s", 1, k, "k", 1, 1) for k in range(3)]
    rows += [(None, None, None, None, None, None, None, None, None), (None, f"other {words[::-1]}", "en", None, 1, 1, "k", 1, 1), (7, "", "en", "s", 0, 1, "k", 1, 1), (7, "", "en", "s", 0, 1, "k", 1, 1), (8, "z" * 200_000, "en", "t", 1, 1, "k", 1, 1)]
    for name, docs in (("empty", spark.createDataFrame([], schema)), ("odd", spark.createDataFrame(rows, schema))):
        for stage, run in corpus_pipeline.STAGES:
            run(spark, docs, SF).write.parquet(str(tmp_path / name / stage))
            now = spark.read.parquet(str(tmp_path / name / stage))
            assert stage == "token_files" or now.schema.simpleString() == docs.schema.simpleString()
            if name == "empty":
                assert now.count() == 0
            elif stage in ("toxicity", "decontamination"):
                assert now.count() == docs.count()
            elif stage == "near_duplicates":
                # the three numbered texts are near copies; blank and null texts are one group
                assert sorted((repr(r.doc_id), len(r.text or "")) for r in now.collect()) == sorted([("0", len(rows[0][1])), ("7", 0), ("8", 200_000), ("None", len(rows[4][1]))])
            docs = now
        if name == "odd":
            assert {r.doc_id for r in docs.collect()} <= {0, 8, None} and docs.count() > 0
