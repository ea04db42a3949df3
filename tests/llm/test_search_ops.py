"""Decontamination and near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from turnstone.llm import decontaminate, neardup

SF = "/root/testdata/sf0.01"
VOCABULARY = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed") for b in ("", "e", "ing", "ly", "tion", "s")]


def edit_window(item, words):
    """The least edits between item and any run of words, by the plain table."""
    row = [0] * (len(words) + 1)
    for w in item:
        new = [row[0] + 1]
        for j, x in enumerate(words):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute_leaks(docs, items):
    out = {}
    for i, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for k, item in items:
            own = re.findall(r"\w+", (item or "").lower())
            edits = edit_window(own, words) if own else 1
            if own and edits <= len(own) // 5 and edits < len(own):
                out[i, k] = edits
    return out


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        at, what = rnd.randrange(len(words)), rnd.random()
        if what < 0.4:
            words[at] = rnd.choice(VOCABULARY)
        elif what < 0.7:
            words.insert(at, rnd.choice(VOCABULARY))
        elif len(words) > 1:
            del words[at]
    return words


@pytest.fixture(scope="module")
def fixture():
    rnd = random.Random(3)
    items = [(k, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.choice([1, 3, 4, 5, 7, 9, 15, 30, 55])))) for k in range(24)]
    items += [(100, None), (101, " .,! "), (102, items[9][1])]
    docs = []
    for k in range(240):
        words = [rnd.choice(VOCABULARY) for _ in range(rnd.randrange(0, 120))]
        if k % 2:
            own = items[rnd.randrange(24)][1].split()
            at = rnd.choice([0, len(words), rnd.randrange(len(words) + 1)])
            words[at:at] = edited(rnd, own, rnd.choice([0, len(own) // 10, len(own) // 5, len(own) // 5 + 2]))
        docs.append((k, " ".join(w.upper() if rnd.random() < 0.1 else w + rnd.choice(["", "", ",", "."]) for w in words)))
    return docs + [(1000, None), (1001, "")], items


def test_leaks_equal_brute_force(spark, fixture):
    docs, items = fixture
    wanted = brute_leaks(docs, items)
    found = decontaminate.find_leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    assert set(got) <= set(wanted) and all(got[k] == wanted[k] for k in got)
    assert len(got) >= decontaminate.TARGET_RECALL * len(wanted) and len(wanted) > 80
    for r in found:
        words = re.findall(r"\w+", dict(docs)[r.doc_id].lower())[r.start_word : r.start_word + r.n_words]
        assert edit_window(re.findall(r"\w+", dict(items)[r.item_id].lower()), words) == r.edits


def test_recall_at_the_most_edits():
    rnd = random.Random(8)
    hit = total = 0
    for _ in range(400):
        item = [rnd.choice(VOCABULARY) for _ in range(rnd.randrange(15, 56))]
        text = [rnd.choice(VOCABULARY) for _ in range(30)] + edited(rnd, item, len(item) // 5) + [rnd.choice(VOCABULARY) for _ in range(30)]
        hit += bool(decontaminate.Items([(1, " ".join(item))]).search([" ".join(text)])[0])
        total += 1
    assert hit / total >= decontaminate.TARGET_RECALL


def test_unrelated_windows_are_discarded():
    """Texts of the items' own words in another order: no word is unknown, so the buckets alone reject."""
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(15, 60)))) for k in range(100)]
    search = decontaminate.Items(items)
    assert not any(search.search([" ".join(rnd.choice(words) for _ in range(2000)) for _ in range(20)]))
    assert search.counts["windows"] > 15_000 and search.counts["met"] < 0.01 * search.counts["windows"]


def test_most_windows_of_the_tables_are_discarded(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    search = decontaminate.Items([tuple(r) for r in items.select("item_id", "text").collect()])
    held = search.search([r.text for r in docs.collect()])
    assert any(held) and search.counts["met"] < 0.05 * search.counts["windows"]


def test_padding_is_no_agreement():
    """Texts and items that end early stand still on different marks."""
    search = decontaminate.Items([(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, n in enumerate((1, 2, 3, 10, 30))])
    assert not any(search.search(["", None, "i9", "i0", "i1x0", "i2x0 i2x2", "i3x0 " * 3])) and search.counts["met"] <= 2


def test_matches_at_borders_and_in_other_segments(monkeypatch):
    """Each text alone, all at once, and in small segments give the same matches."""
    rnd = random.Random(7)
    items = [(k, " ".join(rnd.choice(VOCABULARY) for _ in range(n))) for k, n in enumerate((1, 2, 6, 12, 20, 33, 59))]
    texts = [None, "", *(" ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randrange(40))) for _ in range(10))]
    texts += [t for _, t in items] + [" ".join(edited(rnd, t.split(), 1)) for _, t in items if len(t.split()) >= 6] + [" ".join(t for _, t in items)]
    alone = [decontaminate.Items(items).search([t])[0] for t in texts]
    assert [{m[0] for m in a} >= {k} for k, a in enumerate(alone[12:19])] == [True] * 7 and len(alone[-1]) == 7
    at_once = decontaminate.Items(items).search(texts)
    assert [{m[0]: m[3] for m in a if m[3] == 0} for a in at_once] == [{m[0]: m[3] for m in a if m[3] == 0} for a in alone]
    monkeypatch.setattr(decontaminate, "SEGMENT", 64)
    assert decontaminate.Items(items).search(texts) == at_once
    assert [bool(m) for m in decontaminate.Items(items).search(texts, any_match=True)] == [bool(m) for m in at_once]


def test_one_very_long_item():
    """An item of 20,000 words beside short ones, in a process of its own to see its memory."""
    import subprocess
    import sys

    program = """
import random, resource
from turnstone.llm import decontaminate
rnd = random.Random(9)
long = [f"w{rnd.randrange(9000)}" for _ in range(20_000)]
items = [(0, " ".join(long))] + [(k, " ".join(f"w{rnd.randrange(9000)}" for _ in range(30))) for k in range(1, 200)]
search = decontaminate.Items(items)
text = ["a", "b", *long, "c"]
for _ in range(200):
    text[rnd.randrange(3, 20_000)] = "x"
found = search.search([" ".join(text), items[3][1]])
print([m[0] for m in found[0]], [m[0] for m in found[1]], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    said = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=600, check=True).stdout.split()
    assert said[:2] == ["[0]", "[3]"] and int(said[2]) < 500


def test_item_blocks_and_whole_tables(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    blocks = list(decontaminate.item_blocks(items, "item_id", "text", 300))
    assert len(blocks) > 3 and sum(map(len, blocks)) == items.count()
    one = decontaminate.find_leaks(docs, items).collect()
    monkeypatch.setattr(decontaminate, "item_blocks", lambda *a: iter(blocks))
    several = decontaminate.find_leaks(docs, items).collect()
    exact = lambda rows: sorted(tuple(r) for r in rows if r.edits == 0)
    assert exact(several) == exact(one)
    assert len(decontaminate.without_leaks(docs, items).columns) == len(docs.columns)
    monkeypatch.undo()
    contained = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if b.text in d.text}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert contained <= found
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d.doc_id for d in docs.collect()} - {i for i, _ in found}


def test_leaks_of_empty_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find_leaks(docs.limit(0), items).count() == decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == docs.count()


def brute_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    """Least id reachable over links of at most two bits; null ids take part."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return [least.get(find(p)) for p in prints]


def test_fingerprints_and_components(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(5000, None), (5001, " \t"), (5002, "One"), (5003, "one two"), (5004, "ÀB ab c d"), (None, rows[7][1]), (7, rows[7][1]), (None, "all alone here")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    found = neardup.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    wanted = sorted(map(repr, zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints))))
    assert sorted(repr(tuple(r)) for r in found) == wanted


@pytest.mark.parametrize("few", [neardup.FEW, 3])
def test_components_of_clouds(spark, few):
    """Crowds of near fingerprints, chains, and lone ones: the pivot route and the route of full keys."""
    rnd = random.Random(few)
    prints = [rnd.getrandbits(64) for _ in range(150)]
    centre = rnd.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for _ in range(500)]
    chain = rnd.getrandbits(64)
    for _ in range(40):
        chain ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
        prints.append(chain)
    prints = sorted(set(prints))
    rnd.shuffle(prints)
    old, neardup.FEW = neardup.FEW, few
    try:
        classes = spark.createDataFrame([(neardup._SIGNED(p),) for p in prints], "fp long")
        roots = {r.v % (1 << 64): r.root for r in neardup.components(neardup.links(classes, len(prints))).collect()}
    finally:
        neardup.FEW = old
    groups = {}
    for p in prints:
        groups.setdefault(roots.get(p, p), set()).add(p)
    wanted = {}
    for p, c in zip(prints, brute_components(prints, prints)):
        wanted.setdefault(c, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_pivots_miss_no_near_pair():
    """The distances of near pairs agree on three blocks, and differ by at most two for every free pivot."""
    rnd = random.Random(1)
    rel = lambda x, k: [(x ^ p).bit_count() - (x ^ neardup.BASE).bit_count() for p in neardup.IN_BLOCK[k]]
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x ^ sum(1 << b for b in rnd.sample(range(64), 2))
        assert sum(rel(x, k) == rel(y, k) for k in range(5)) >= 3
        assert max(abs((x ^ p).bit_count() - (y ^ p).bit_count()) for p in neardup.FREE) <= 2


def test_keep_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    found = neardup.near_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
    assert neardup.keep_one(docs.limit(0)).count() == neardup.near_duplicates(docs.limit(0)).count() == 0
    for similarity in (None, 0.8):
        keep = lambda rows, schema: sorted((repr(tuple(r)) for r in neardup.keep_one(spark.createDataFrame(rows, schema), similarity=similarity).collect()))
        schema = "doc_id long, text string, lang string"
        # equal rows become one; a text under a null id goes where a named one has it, and stays where none has
        assert keep([(1, "a b c d", "en"), (1, "a b c d", "en"), (None, "x y z", "en"), (None, "a b c d", "en"), (2, None, None), (3, " ", None)], schema) == sorted(map(repr, [(1, "a b c d", "en"), (None, "x y z", "en"), (2, None, None)]))
        clash = [(1, "a b c", 1, 2, {"k": 1}), (2, "a b c", 3, 4, None), (5, "d e f", 5, 6, {})]
        assert len(keep(clash, "doc_id long, text string, __kept int, fp int, `at` map<string,int>")) == 2
    # different texts under one id are different documents
    different = [(1, "one two three four five six", "en"), (1, "quite another text of seven words here", "en"), (2, "one two three four five six", "de")]
    assert keep(different, schema) == sorted(map(repr, different[:2])) == keep(different[::-1], schema)
    # of equal ids and texts the same row stays, whatever the order
    rows = [(1, "a b c d", x) for x in ("p", "q", None, "r")]
    assert keep(rows, schema) == keep(rows[::-1], schema) and len(keep(rows, schema)) == 1


def test_pivots_discard_pairs(spark):
    """In the buckets of the ten keys the free pivots alone discard nearly all pairs that lie too far apart."""
    rnd = random.Random(12)
    near = lambda x, most: x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(most + 1)))
    prints = {near(c, 8) for c in (rnd.getrandbits(64) for _ in range(150)) for _ in range(8)} | {rnd.getrandbits(64) for _ in range(500)}
    table = neardup.pivot_table(spark.createDataFrame([(neardup._SIGNED(p),) for p in prints], "fp long"))
    rows = [(r.fp, r.keys, (r.t0, r.t1)) for r in table.collect()]
    distances = lambda t: [t[k // 8] >> 7 * (k % 8) & 127 for k in range(16)]
    buckets = {}
    for fp, keys, t in rows:
        for key in keys:
            buckets.setdefault(key, set()).add((fp, t))
    pairs = {(a, b) for m in buckets.values() for a in m for b in m if a < b}
    apart = lambda a, b: ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count()
    discarded = {(a, b) for a, b in pairs if max(abs(x - y) for x, y in zip(distances(a[1]), distances(b[1]))) > neardup.RADIUS}
    far = {(a, b) for a, b in pairs if apart(a, b) > neardup.RADIUS}
    assert len(pairs) < 0.01 * len(prints) ** 2  # the keys' pivots have discarded the others
    assert discarded <= far and len(discarded) > 0.6 * len(far) > 100


def test_bins_discard_what_is_not_similar(spark):
    """Pairs of sets of similarity 0.8 and more all pass; long ones of 0.5 hardly ever do."""
    rng = np.random.default_rng(3)
    rows, n = [], 400
    for kind, similarity in (("near", 0.81), ("far", 0.5)):
        for k in range(n):
            size = (6, 40, 300, 3000)[k % 4]
            shared = -(-int(100 * size * similarity) // 100)
            hashes = rng.integers(0, 1 << 63, 2 * size - shared, np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * size - shared, np.uint64)
            union = len(hashes)
            both = int(similarity * union) + 1  # of the union in both sets
            own = (union - both) // 2
            a, b = hashes[: both + own], np.concatenate([hashes[:both], hashes[both + own :]])
            rows.append((kind, size, neardup.bins(np.sort(a)), neardup.bins(np.sort(b))))
    found = spark.createDataFrame(rows, "kind string, size int, a array<long>, b array<long>").select("kind", "size", neardup.alike(F.col("a"), F.col("b"), 0.8).alias("pass")).collect()
    assert all(r["pass"] for r in found if r.kind == "near")
    assert sum(r["pass"] for r in found if r.kind == "far" and r.size == 3000) == 0
    assert sum(r["pass"] for r in found if r.kind == "far" and r.size == 300) < 0.3 * n / 4


@pytest.mark.parametrize("few", [neardup.FEW, 3])
def test_near_copies_of_the_pipeline(spark, few):
    """The stage keeps one text of each group linked by 5-word shingles of similarity 0.8, found by brute force."""
    import corpus_pipeline

    rnd = random.Random(few)
    texts = [[rnd.choice(VOCABULARY) for _ in range(120)] for _ in range(12)]
    for n, base in enumerate(list(texts)):
        for _ in range(30 if n == 0 else 2):
            copy = list(base)
            for _ in range(rnd.randrange(1, 5)):
                copy[rnd.randrange(120)] = rnd.choice(VOCABULARY)
            texts.append(copy)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(5000 + k, " ".join(t)) for k, t in enumerate(texts)] + [(9000, None), (9001, " "), (9002, "one two"), (9003, "One  two")]
    groups = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(1, len(words)))))
        groups.setdefault(grams, []).append(i)
    sets, holders = list(groups), {}
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, grams in enumerate(sets):
        shared = {}
        for g in grams:
            for j in holders.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            holders[g].append(k)
        for j, n in shared.items():
            if n >= 0.8 * (len(grams) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, grams in enumerate(sets):
        least[find(k)] = min([least.get(find(k), 1 << 40), *groups[grams]])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, neardup.FEW = neardup.FEW, few
    try:
        kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    finally:
        neardup.FEW = old
    assert kept == sorted(least.values())
    assert len(kept) < neardup.near_duplicates(docs).select("component_id").distinct().count()


def _sets(spark, texts, keys):
    """Texts, and their sets under the keys given."""
    rows = [(at, n, own, bits) for (at, own), (_, n, _, bits) in zip(keys.items(), (neardup.set_keys(texts[at]) for at in keys))]
    return spark.createDataFrame(rows, "at long, n int, keys array<long>, bins array<long>"), spark.createDataFrame(list(texts.items()), "at long, text string")


def test_many_sets_are_least_of_several_keys(spark):
    """More than a thousand sets that have pairs for over a thousandth of the sets each."""
    texts = {k: " ".join(f"w{k}x{j}" for j in range(40)) for k in range(1100)}
    sets, texts = _sets(spark, texts, {k: [k, k - 1, k - 2] for k in texts})
    assert neardup.similar_roots(sets, texts, 5, 0.8).count() == 0


def test_pairs_under_full_keys_of_the_last_level(spark, monkeypatch):
    """Two near copies that share all their keys, full ones, with a lesser set that is not so similar."""
    words = [f"w{k}" for k in range(60)]
    texts = {0: " ".join(words[:40] + ["x"] * 20), 1: " ".join(words), 2: " ".join(words[:-1])}
    sets, texts = _sets(spark, texts, {0: [7], 1: [7], 2: [7]})
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "shingle_sets", lambda dealt, size, level: sets)
    assert {(r.v, r.root) for r in neardup.similar_roots(sets, texts, 5, 0.8).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("known", [False, True])
def test_near_copies_without_a_common_key(spark, known):
    """Pairs that all keys miss are linked all the same, short and long ones, in whatever order the shingles are taken."""
    texts = {0: [f"w{k}" for k in range(60)], 2: [f"v{k}" for k in range(3000)], 4: [f"u{k}" for k in range(60)]}
    texts |= {1: [*texts[0], "more"], 3: [*texts[2][:2500], *("x" for _ in range(3)), *texts[2][2520:]], 5: [*texts[4][:30], "more", *texts[4][31:]]}
    sets, texts = _sets(spark, {k: " ".join(t) for k, t in texts.items()}, {k: [k] for k in texts})
    counts = np.random.default_rng(2).integers(0, 9, neardup.COUNTERS).astype(np.uint16) if known else None
    found = {(r.v, r.root) for r in neardup.similar_roots(sets, texts, 5, 0.8, *([counts] if known else [])).collect()}
    assert found == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 4)}


def test_bins_never_discard_surely(spark):
    """Sets differ in at least as many shingles as their bins say, and those of short texts that have little in common in many."""
    rng, rows = np.random.default_rng(5), []
    for k in range(400):
        size = (1, 6, 40, 300, 3000)[k % 5]
        union = np.unique(rng.integers(0, 1 << 63, 2 * size, np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * size, np.uint64))
        own = [np.sort(union[rng.random(len(union)) < share]) for share in (0.9, rng.random())]
        rows.append((size, len(np.setxor1d(*own)), *map(neardup.bins, own)))
    found = spark.createDataFrame(rows, "size int, differ int, a array<long>, b array<long>").select("size", "differ", neardup.least_differing(F.col("a"), F.col("b")).alias("least")).collect()
    assert all(r.least <= r.differ for r in found)
    short = [r for r in found if r["size"] <= 40]
    assert sum(r.least for r in short) > 0.8 * sum(r.differ for r in short)


def test_counts_of_shingles_put_common_ones_last(spark):
    """The counters of all tasks are added up; of a common passage nothing is among the first of a set."""
    common = " ".join(f"c{k}" for k in range(30))
    texts = {k: f"{common} " + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(40)}
    rows = spark.createDataFrame([*texts.items(), (99, None)], "at long, text string").repartition(3)
    sets = neardup.shingle_sets(rows, 5)
    counts = neardup.shingle_counts(sets)
    all_counters = np.concatenate([neardup.counters(neardup.set_hashes(t)) for t in texts.values()])
    assert (counts == np.rint(1500 * np.log2(1 + np.bincount(all_counters, minlength=neardup.COUNTERS))).astype(np.uint16)).all()
    passage = {int(h) for h in neardup.set_hashes(common).view(np.int64)}
    first = neardup.prefixes(rows, 5, 0.8, counts).collect()
    assert {r.at for r in first} == {*texts, 99} and not any(passage & set(r["first"]) for r in first)
    assert sets.where("at is not null").count() == 41


def test_large_groups_of_almost_near_copies(spark, monkeypatch):
    """A crowd about one text: those near it are one group, those that are not near any make few pairs to verify."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(150)]

    def copy(own, *places):
        return " ".join(f"own{own}" if k in places else w for k, w in enumerate(base))

    texts = {k: copy(k, 10 + k, 70) for k in range(60)}  # near the base, of a similarity of 0.75 to 0.93 to each other
    texts |= {100 + k: copy(100 + k, *(8 * j + rnd.randrange(3) for j in rnd.sample(range(18), 4))) for k in range(150)}  # about 0.76 to the base
    texts |= {300: " ".join(base), 301: texts[120] + " more"}  # a near copy of one of those
    monkeypatch.setattr(neardup, "FEW", 3)
    seen, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *more: (seen.append(pairs.count()), verified(pairs, *more))[1])
    kept = neardup.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=5, similarity=0.8)
    sets = {k: set(neardup.shingles(t, 5)) for k, t in texts.items()}
    least = {k: k for k in texts}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*least.values()})
    assert sum(seen) < 10 * len(texts)
