"""Fitted models: held-out accuracy, and defined results for odd rows."""

import zlib

import numpy as np
import pytest

from turnstone.llm import common, langid, quality, toxicity

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(1, None, "en", 5), (2, "", "en", 5), (3, "12 34 !!", None, 5), (None, "the and of them", "en", 5), (4, "x" * 300_000, None, 5), (4, "x" * 300_000, None, 5), (5, "日本語", None, 5)]


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.train(*tables(spark, LARGER))


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, score int")


@pytest.mark.parametrize("module, score, label, least", [(quality, quality.quality_scores, "quality", 0.97), (toxicity, toxicity.toxicity_scores, "toxic", 0.98)])
def test_held_out_accuracy(spark, module, score, label, least):
    docs, labels = tables(spark, LARGER)
    found = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(found) == docs.count()
    rows = [(found[r.doc_id], r[label]) for r in labels.collect()]
    held = [(r, y) for r, y in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in found.values())
    assert np.mean([r.predicted == y for r, y in held]) >= least


def test_misspellings_share_vectors(toxic_model):
    model = toxic_model
    clean = "Ered the of heder thing and onre"
    for word in ("idiot", "worthless", "pathetic", "disgusting"):
        misspelt = model.score(f"{clean} {word}{word[-1]}s of the")
        assert model.score(f"{clean} {word} of the") > misspelt > 100 * model.score(f"{clean} thing of the")


def test_toxic_filter_keeps_columns(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels)
    kept = toxicity.without_toxic(docs, model)
    wanted = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 0").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == wanted


def test_a_repeated_text_keeps_its_class(spark, toxic_model):
    docs, labels = tables(spark, LARGER)
    model = toxic_model
    known = {r.doc_id: r.toxic for r in labels.collect()}
    long = [(r.text, known.get(r.doc_id)) for r in docs.where("n_chars between 1500 and 4000").orderBy("doc_id").limit(300).collect() if r.doc_id in known]
    assert {y for _, y in long} == {0, 1}
    for text, _ in long:
        scores = [model.score(" ".join([text] * n)) for n in (1, 10, 100, 1000)[: 4 if text is long[0][0] else 2]]
        assert len({s >= toxicity.THRESHOLD for s in scores}) == 1
    clean = next(t for t, y in long if y == 0 and model.score(t) < 0.01)
    assert max(model.score(" ".join([clean] * n)) for n in (10, 100, 1000)) < 0.02


def test_toxicity_is_the_averaged_bags_in_a_softmax():
    """Forward by the definition: vectors averaged, two logits, softmax; and the gradient by differences."""
    model, rng = toxicity.SubwordBag(), np.random.default_rng(8)
    model.vectors = rng.standard_normal(model.vectors.shape).astype(np.float32)
    model.biases = np.array([0.3, -0.4], np.float32)
    model.ready()
    for text in ("one", "one two", "alpha beta gamma delta epsilon beta"):
        bags = [np.mean([model.vectors[b] for b in toxicity.subwords(w)], axis=0) for w in toxicity.split_words(text)]
        width = min(toxicity.PASSAGE, len(bags))
        logits = [np.mean(bags[k : k + width], axis=0) @ model.weights + model.biases for k in range(len(bags) - width + 1)]
        shares = [np.exp(z) / np.exp(z).sum() for z in logits]
        mean_odds = np.mean([p[1] / p[0] for p in shares])
        assert model.score(text) == pytest.approx(mean_odds / (1 + mean_odds), rel=1e-4)

    def loss(values, shift, y):
        z = toxicity.odds(toxicity.passages(values) + shift)[0]
        return np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))

    for n in (1, 2, 5, 9):
        for y in (0, 1):
            values, shift, step = rng.standard_normal(n), 0.2, 1e-6
            own, d = toxicity.text_gradient(values, shift, y)
            moved = [(loss(values + step * e, shift, y) - loss(values - step * e, shift, y)) / (2 * step) for e in np.eye(n)]
            assert np.allclose(own, moved, atol=1e-6) and d == pytest.approx((loss(values, shift + step, y) - loss(values, shift - step, y)) / (2 * step), abs=1e-6)


def test_quality_is_the_convolution_and_its_gradient():
    net, raw = quality.ByteNet(), bytes(np.random.default_rng(3).integers(32, 127, 700, np.uint8))

    def forward():
        data = [*raw, *[quality.PAD] * quality.WIDTH]
        response = np.array([sum(net.tables[k][data[at + k]].astype(float) for k in range(quality.WIDTH)) for at in range(len(raw))])
        halves = [response[at : at + quality.HALF].max(axis=0) for at in range(0, len(raw), quality.HALF)]
        chunks = [np.maximum(np.maximum(a, b) + net.bias, 0) for a, b in zip(halves, halves[1:])] or [np.maximum(halves[0] + net.bias, 0)]
        features = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0), [quality.empty_share(len(raw))]])
        return features @ net.weights.astype(float) + float(net.offset[0])

    z = forward()
    assert net.score(raw.decode()) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    places = -(-len(raw) // quality.HALF) * quality.HALF
    symbols = np.full(places + quality.WIDTH - 1, quality.PAD, np.int64)
    symbols[: len(raw)] = np.frombuffer(raw, np.uint8)
    grads = [np.zeros_like(g, dtype=np.float64) for g in (net.tables, net.bias, net.weights, net.offset)]
    net._backward(symbols, len(raw), 1.0, grads)
    rng = np.random.default_rng(4)
    touched = np.argwhere(np.abs(grads[0]) > 1e-4)
    for part, places in ((net.tables, [tuple(t) for t in touched[rng.permutation(len(touched))[:12]]]), (net.bias, [(2,), (7,)]), (net.weights, [(0,), (20,), (40,), (48,)]), (net.offset, [(0,)])):
        grad = grads[[net.tables is part, net.bias is part, net.weights is part, net.offset is part].index(True)]
        for at in places:
            step, kept = 1e-3, part[at]
            part[at] = kept + step
            up = np.log1p(np.exp(-forward()))
            part[at] = kept - step
            down = np.log1p(np.exp(-forward()))
            part[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_spans_decide_whatever_stands_at_the_ends(spark):
    docs, _ = tables(spark)
    model = langid.train(docs)
    by = {r.lang: r.text for r in docs.where("n_chars between 2000 and 6000").orderBy("doc_id").collect()}
    for outer, inner in (("fr", "en"), ("en", "de"), ("de", "fr")):
        greeting = " ".join(by[outer].split()[:8])
        ((lang, score, spans),) = model.label([f"{greeting} {by[inner]} {greeting}"])
        assert lang == inner and score > 0.5 and spans[0][2] == spans[-1][2] == outer


def test_each_language_is_learned_however_rare(spark):
    rows = [(k, "hello this is the word and world", "en") for k in range(400)] + [(1000 + k, "слово это мир и привет", "ru") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = common.labelled_sample(docs, docs, "doc_id", "text", "lang", 20, 1000, 5)
    assert {y for _, y in sample} == {"en", "ru"} and sum(y == "en" for _, y in sample) == 10


def test_long_texts_are_sampled_by_windows(spark):
    docs = spark.createDataFrame([(k, "é" * 5000 + "b" * 5000, 1) for k in range(30)], "doc_id long, text string, y int")
    sample = common.labelled_sample(docs, docs, "doc_id", "text", "y", 30, 600)
    assert len(sample) == 30 and all(300 <= len(t) <= 600 for t, _ in sample) and len({t for t, _ in sample}) > 1


def test_language_accuracy(spark):
    docs, _ = tables(spark)
    found = {r.doc_id: r for r in langid.languages(docs).collect()}
    held = [(found[r.doc_id].lang_pred, r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_spans_of_mixed_text(spark):
    docs, _ = tables(spark)
    model = langid.train(docs)
    by = {r.lang: r.text for r in docs.where("n_chars between 400 and 900").orderBy("doc_id").collect()}
    parts = [by["fr"][:300], by["de"][:300], by["en"][:300]]
    ((lang, score, spans),) = model.label([" ".join(parts)])
    assert [s[2] for s in spans] == ["fr", "de", "en"] and all(abs(s[0] - k * 301) < 30 for k, s in enumerate(spans))


def brute_viterbi(scores, penalty):
    import itertools

    n, k = len(scores), len(scores[0])
    return max(sum(scores[t][s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(k), repeat=n))


def test_viterbi_and_its_short_cut():
    rng, stayed = np.random.default_rng(4), 0
    for _ in range(400):
        scores = -rng.random((rng.integers(1, 8), 3)) * 6
        path = langid.viterbi(scores.tolist(), 3.0)
        value = sum(scores[t][s] for t, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))
        assert value == pytest.approx(brute_viterbi(scores.tolist(), 3.0))
        best = scores.sum(axis=0).argmax()
        if langid.stays_best(scores, best, 3.0):
            stayed += 1
            assert scores[:, best].sum() == pytest.approx(value)
    assert stayed > 20


def test_scripts_narrow_languages():
    model = langid.LanguageModel([("привет мир это слово", "ru"), ("hello world this word", "en"), ("hallo welt dieses wort", "de")] * 5)
    assert model.label(["слово и мир"])[0][0] == "ru"
    assert model.word_scores(["мир"])[0].argmax() == model.langs.index("ru") and model.word_scores(["мир"])[0].min() == langid.WORST


def test_odd_rows(spark):
    docs, labels = tables(spark)
    mixed = docs.select("doc_id", "text", "lang").unionByName(odd(spark).drop("score"))
    for run in (lambda d: quality.quality_scores(d, labels), lambda d: toxicity.toxicity_scores(d, labels), langid.languages):
        found = run(mixed).collect()
        assert len(found) == docs.count() + len(ODD) and all(0 <= r.score <= 1 for r in found)
        assert run(odd(spark).limit(0)).count() == 0
    by = [(r.doc_id, r.lang_pred, r.score) for r in langid.languages(odd(spark)).collect()]
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= set(by)


def test_nothing_to_learn(spark):
    docs, labels = tables(spark)
    nothing = labels.limit(0)
    assert quality.quality_scores(docs, nothing).count() == toxicity.toxicity_scores(docs, nothing).count() == docs.count()


def test_toxicity_filter_with_nothing_to_learn(spark):
    """Without labels, or with labels of one class alone, no document is toxic and all rows stay."""
    docs, labels = tables(spark)
    docs = docs.limit(20).select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 20_000)], "doc_id long, text string"))
    for known in (labels.limit(0), spark.createDataFrame([(-3, 1)], "doc_id long, toxic int")):
        assert toxicity.without_toxic(docs, toxicity.train(docs, known)).count() == docs.count()
        assert toxicity.toxicity_scores(docs, known).where("predicted = 1 or score >= 0.01").count() == 0


def test_slabs_score_like_one_piece():
    net = quality.ByteNet()
    raw = bytes(np.random.default_rng(1).integers(32, 127, 3 * quality.SLAB // 2, np.uint8))
    whole = quality.ByteNet()
    found = net.pooled(raw)
    padded = np.full(-(-len(raw) // quality.HALF) * quality.HALF + quality.WIDTH - 1, quality.PAD, np.int64)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    response = whole.responses(padded)
    response[len(raw) :] = -np.inf
    halves = response.reshape(-1, quality.HALF, quality.FILTERS).max(axis=1)
    chunks = np.maximum(np.maximum(halves[:-1], halves[1:]) + net.bias, 0)
    assert np.allclose(found[:-1], np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0)]), atol=1e-4)
