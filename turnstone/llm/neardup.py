"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets a table row: its Hamming distances to reference fingerprints (pivots).
There are two kinds of pivots, all fixed:

* block pivots: a base pivot, and for each of five blocks of bits several pivots that differ from
  the base inside that block only.  The distance to such a pivot less that to the base depends on
  the block alone.  Two fingerprints with at most two differing bits agree in all these relative
  distances on at least three of the five blocks, so they meet under at least one of ten keys, each
  made of the relative distances on three blocks.  No such pair is missed.
* free pivots, random over all bits.  By the triangle inequality two fingerprints with at most two
  differing bits have distances to any pivot that differ by at most two; so pairs whose largest
  coordinate difference is more are discarded, and the survivors are verified by their own distance.

A key's fingerprints are compared in pairs only while they are few (``FEW``).  The fingerprints of
fuller keys are linked exactly in another way, in proportion to their number: each is sent to the 65
points within one bit of it.  Two fingerprints have at most two differing bits just if they share
such a point, and no point can have more than 65 fingerprints, however large the group of copies is.

Components come from minimum labels with pointer jumping over links whose degrees are bounded.

Near copies by similarity (``similarity`` given, as the pipeline does) lie many bits apart, so they are
found another way: texts with the same set of shingles are one class; min-hashes of the sets place each class under
keys, and each class under a key is compared with the least one there, by the similarity (Jaccard) of their own shingles.
That links most of what is similar, but keys can miss a pair.  Only components matter, so then all classes meet
under the rare shingles of each (`prefixes`), by which no pair that is so similar is missed, and those that are still in different
components are compared; what a large group has in common finds no pair of it.  There, pairs are discarded before their texts are
read only if their sets surely differ in too many shingles (`least_differing`).
"""

from __future__ import annotations

import itertools
import math
import random
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import HOT_SHARE, bound_batches, join_hot, keep, release

SHINGLE, SEED, RADIUS = 3, 42, 2  # fixed values: words of a shingle, seed of XXH64, differing bits that link
FEW = 64  # fingerprints of one key that are compared in pairs
NEAR_SHINGLE, SIMILARITY = 5, 0.8  # words of a shingle and least similarity of near copies
ROWS, BANDS = 4, 20  # min-hashes to a key, keys
COUNTERS, COUNTER_BLOCKS = 1 << 18, 64  # counters of shingles by the first bits of their hashes, and parts that they are added up in
BLOCKS = [range(0, 13), range(13, 26), range(26, 39), range(39, 52), range(52, 64)]
BLOCK_PIVOTS, FREE_PIVOTS = 8, 16
_RANDOM = random.Random(20240501)
_SIGNED = lambda x: x - (1 << 64) if x >> 63 else x
BASE = _RANDOM.getrandbits(64)
IN_BLOCK = [[BASE ^ sum(1 << b for b in block if _RANDOM.random() < 0.5) for _ in range(BLOCK_PIVOTS)] for block in BLOCKS]
FREE = [_RANDOM.getrandbits(64) for _ in range(FREE_PIVOTS)]
KEYS = list(itertools.combinations(range(len(BLOCKS)), 3))
BINS, DEVIATIONS = 512, 5.5
TEXTS_A_TASK, MOST_TASKS = 1000, 2000
EASY = 1000  # rows of one key that need no route of their own
_TIMES = np.array([_RANDOM.getrandbits(64) | 1 for _ in range(ROWS * BANDS)], np.uint64)
_PLUS = np.array([_RANDOM.getrandbits(64) for _ in range(ROWS * BANDS)], np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text: bits set in over half of its shingles' hashes, repeats included."""
    from xxhash import xxh64_intdigest

    found = shingles(text, size)
    if not found:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        hashes = np.array([xxh64_intdigest(s, SEED) for s in found[at : at + (1 << 16)]], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_SIGNED(pivot)).cast("long")))


def pivot_table(classes: DataFrame) -> DataFrame:
    """fp, keys (ten longs) and the free pivots' distances, eight to a long."""
    fp, base = F.col("fp"), F.col("base")
    blocks = [F.xxhash64(F.lit(k), *(_distance(fp, p) - base for p in pivots)).alias(f"b{k}") for k, pivots in enumerate(IN_BLOCK)]
    rows = classes.select("fp", _distance(fp, BASE).alias("base")).select("fp", *blocks, *(_packed(fp, part).alias(f"t{part}") for part in (0, 1)))
    keys = F.array(*(F.xxhash64(F.lit(n), *(F.col(f"b{k}") for k in three)) for n, three in enumerate(KEYS)))
    return rows.select("fp", "t0", "t1", keys.alias("keys"))


def _packed(fp: Column, part: int) -> Column:
    out = F.lit(0).cast("long")
    for k, pivot in enumerate(FREE[8 * part : 8 * part + 8]):
        out = out.bitwiseOR(F.shiftleft(_distance(fp, pivot).cast("long"), 7 * k))
    return out


def largest_difference(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The largest difference of two rows' distances to the free pivots."""

    def at(c: Column, k: int) -> Column:
        return F.shiftright(c, 7 * k).bitwiseAND(F.lit(127))

    return F.greatest(*(F.abs(at(a[t], k) - at(b[t], k)) for t in ("t0", "t1") for k in range(8)))


def _near(a, b) -> Column:
    """Not discarded by the tables, and verified."""
    return (largest_difference(a, b) <= RADIUS) & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= RADIUS)


def links(classes: DataFrame, n: int) -> DataFrame:
    """a, b: links between n distinct fingerprints whose components are those of all links.

    All pairs of at most RADIUS differing bits that meet under a key of at most FEW fingerprints; in
    fuller keys, for each point shared, a link of each fingerprint to the least.
    """
    table = keep(pivot_table(classes).select("fp", "t0", "t1", F.explode("keys").alias("key")), "pivot-table")
    row = F.struct("fp", "t0", "t1")
    buckets = keep(table.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("lo"), F.max(row).alias("hi")).where("n > 1"), "pivot-buckets", 2 * n)
    two = buckets.where("n = 2").where(_near(F.col("lo"), F.col("hi"))).select(F.col("lo.fp").alias("a"), F.col("hi.fp").alias("b"))
    some = buckets.where(f"n between 3 and {FEW}").select("key")
    members = table.join(some, "key").groupBy("key").agg(F.collect_list(row).alias("m"))  # at most FEW of them
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b["fp"] > a["fp"]) & _near(a, b)), lambda b: F.struct(a["fp"].alias("a"), b["fp"].alias("b")))))
    several = members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    found = two.unionByName(several)
    full = buckets.where(f"n > {FEW}").select("key")
    if full.head(1):
        crowd = table.join(full, "key").select("fp").distinct()
        flips = F.array(F.lit(0).cast("long"), *(F.lit(_SIGNED(1 << b)).cast("long") for b in range(64)))
        points = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        shared = points.groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("m")).where(F.size("m") > 1)  # at most 65 of them
        found = found.unionByName(shared.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 64)).alias("b")))
    return keep(found.distinct(), "links", 8 * buckets.count())


def bins(hashes: np.ndarray) -> list[int]:
    """One bit of the least hash of each of BINS parts of the range of hashes (sorted), and which parts have one: 2 x BINS bits."""
    part = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    bits = np.zeros((2, BINS), np.uint8)
    bits[0, part[first]] = (hashes[first] & np.uint64(1)).astype(np.uint8)
    bits[1, part[first]] = 1
    return np.packbits(bits).view("<i8").tolist()


def alike(a: Column, b: Column, similarity: float) -> Column:
    """If sets of these `bins` can be so similar; if they are, this is false once in ten million times.

    Of the parts that either set has, a share as large as the similarity has the same least hash; their bits
    agree, and those of half of the other parts that both have.
    """
    half = BINS // 64
    add = lambda columns: sum(columns[1:], columns[0])
    both = [a[half + k].bitwiseAND(b[half + k]) for k in range(half)]
    either = add([F.bit_count(a[half + k].bitwiseOR(b[half + k])) for k in range(half)])
    agree = add([F.bit_count(both[k].bitwiseAND(F.bitwise_not(a[k].bitwiseXOR(b[k])))) for k in range(half)])
    same = 2 * agree - add([F.bit_count(x) for x in both])
    return same >= similarity * either - DEVIATIONS * F.sqrt((1 - similarity**2) * either)


def least_differing(a: Column, b: Column) -> Column:
    """In so many shingles at least two sets of these `bins` differ: one in each part that is not the same."""
    half = BINS // 64
    differ = [F.bit_count(a[k].bitwiseXOR(b[k]).bitwiseOR(a[half + k].bitwiseXOR(b[half + k]))) for k in range(half)]
    return sum(differ[1:], differ[0])


def set_hashes(text: str | None, size: int = NEAR_SHINGLE) -> np.ndarray:
    """The hashes of a text's set of shingles, sorted."""
    from xxhash import xxh64_intdigest

    found = set(shingles(text, size))
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))


def counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def set_keys(text: str | None, size: int = NEAR_SHINGLE) -> tuple[int, int, list[int], list[int]]:
    """A digest of a text's set of shingles, their number, the keys of its min-hashes, and its `bins`; without words none."""
    return keys_of(set_hashes(text, size))


def keys_of(hashes: np.ndarray) -> tuple[int, int, list[int], list[int]]:
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return 0, 0, [], [0] * (BINS // 32)
    least = np.full(ROWS * BANDS, np.uint64((1 << 64) - 1))
    at_once = (1 << 18) // len(least)
    for at in range(0, len(hashes), at_once):
        least = np.minimum(least, (hashes[at : at + at_once, None] * _TIMES + _PLUS).min(axis=0))
    keys = [_SIGNED(xxh64_intdigest(b.tobytes(), k)) for k, b in enumerate(least.reshape(BANDS, ROWS))]
    return _SIGNED(xxh64_intdigest(hashes.tobytes(), SEED)), len(hashes), keys, bins(hashes)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """at, fp (the digest of the set), n (its size), keys, bins of rows of at and text; and rows without at, for `shingle_counts`.

    Those are the counters of the shingles of one task that aren't zero: a block of them (fp), and each one and its count, packed (keys).
    """
    bound_batches(texts.sparkSession)

    def rows(at, found) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 4, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays([at, *columns], names=["at", "fp", "n", "keys", "bins"])

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            hashes = [set_hashes(t, size) for t in batch.column(1).to_pylist()]
            if hashes:
                counts += np.bincount(counters(np.concatenate(hashes)), minlength=COUNTERS)
            yield rows(batch.column(0), [keys_of(h) for h in hashes])
        blocks = [np.flatnonzero(own) + k * len(own) for k, own in enumerate(counts.reshape(COUNTER_BLOCKS, -1))]
        found = [(k, 0, (at << 40 | counts[at]).tolist(), []) for k, at in enumerate(blocks) if len(at)]
        yield rows(pa.nulls(len(found), pa.int64()), found)

    return texts.select("at", "text").mapInArrow(run, "at long, fp long, n int, keys array<long>, bins array<long>")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often, on a scale of logarithms, shingles of each counter stand in the sets; from the rows of `shingle_sets` without at.

    Of fixed size, whatever the input: half a megabyte.
    """

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = known.setdefault(block, np.zeros(COUNTERS // COUNTER_BLOCKS, np.int64))
                values = packed.values.to_numpy(zero_copy_only=False)
                own[(values >> 40) - block * len(own)] += values & (1 << 40) - 1
        logs = [np.rint(1500 * np.log2(1 + own)).astype(np.uint16).tobytes() for own in known.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.int64()), pa.array(logs, pa.binary())], names=["block", "logs"])

    out = np.zeros((COUNTER_BLOCKS, COUNTERS // COUNTER_BLOCKS), np.uint16)
    for r in sets.where("at is null").select("fp", "keys").repartition(COUNTER_BLOCKS, "fp").mapInArrow(run, "block long, logs binary").collect():
        out[r.block] = np.frombuffer(r.logs, np.uint16)
    return out.reshape(-1)


def frequent(rows: DataFrame, key: str, total: int) -> list:
    """The values of a column that stand in over HOT_SHARE of the rows, of which there are ``total``; none that one task takes easily."""
    most = max(EASY, HOT_SHARE * total)
    return [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).collect()] if total > most else []


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have sets of shingles of at least this similarity."""
    pairs = keep(pairs.distinct(), "set-pairs")
    total = pairs.count()
    if not total:
        return pairs
    wanted = pairs.select(F.col("a").alias("at")).unionByName(pairs.select(F.col("b").alias("at"))).distinct()
    texts = keep(texts.join(wanted, "at", "left_semi"), "set-texts")
    for end in ("b", "a"):  # the pairs of one a come together
        pairs = join_hot(pairs, texts.select(F.col("at").alias(end), F.col("text").alias(f"{end}_text")), end, frequent(pairs.select(end), end, total), "inner")

    def run(batches):
        last, own = None, set()
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, own = a, set(shingles(a, size))
                other = set(shingles(b, size))
                both = len(own & other)
                linked.append(both >= similarity * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    # small in bytes, yet much work: so many tasks, which are not drawn together again when their few rows are written
    dealt = pairs.select("a", "b", "a_text", "b_text").repartition(min(MOST_TASKS, -(-total // TEXTS_A_TASK)))
    return keep(dealt.mapInArrow(run, "a long, b long"), "set-links")


def prefixes(texts: DataFrame, size: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """at, n (size), first: so many hashes of each text's set, the frequent ones last, that two sets of this similarity share one of them.

    The order is the same for all texts.  Any order of all hashes is right; that by ``counts`` leaves few sets to a hash.
    """
    bound_batches(texts.sparkSession)

    def run(batches):
        for batch in batches:
            firsts, sizes = [], []
            for text in batch.column(1).to_pylist():
                h = set_hashes(text, size)
                order = np.lexsort((h, counts[counters(h)]))
                sizes.append(len(h))
                firsts.append(h[order][: len(h) - math.ceil(similarity * len(h) - 1e-6) + 1].view(np.int64).tolist())
            columns = [pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["at", "n", "first"])

    return texts.select("at", "text").mapInArrow(run, "at long, n int, first array<long>")


def enough(similarity: float, a: Column, b: Column) -> Column:
    """If the sets of two rows of the same hash (n, pos) can be so similar, should it be the first that they share: from there on
    either set has as many as they have in common, or more.
    """
    needed = F.ceil((a["n"] + b["n"]) * F.lit(similarity / (1 + similarity)) - 1e-6)
    return F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= needed


def shared_prefixes(first: DataFrame, labels: DataFrame) -> DataFrame:
    """h, at, pos, n, label, least of the `prefixes` of the sets that labels (at, label, n) has, of hashes that stand in sets of several labels.

    ``least`` is the row of the hash that has the fewest before it.  Most hashes stand in one set and go after one shuffle of little.
    """
    of_hash = Window.partitionBy("h")
    rows = first.select("at", F.posexplode("first").alias("pos", "h")).withColumn("lo", F.min("at").over(of_hash)).withColumn("hi", F.max("at").over(of_hash))
    rows = rows.where("lo <> hi").select("h", "at", "pos").join(labels, "at")
    rows = rows.withColumn("lo", F.min("label").over(of_hash)).withColumn("hi", F.max("label").over(of_hash)).withColumn("least", F.min(F.struct("pos", "at", "n", "label")).over(of_hash))
    return rows.where("lo <> hi").select("h", "at", "pos", "n", "label", "least")


def prefix_pairs(rows: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of different labels (at, label) that can be so similar, of `shared_prefixes`."""
    of_hash = Window.partitionBy("h")
    rows = rows.select("h", "at", "pos", "n").join(labels, "at").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h", "label")))
    rows = rows.withColumn("lo", F.min("label").over(of_hash)).withColumn("hi", F.max("label").over(of_hash))
    rows = rows.withColumn("top", F.max(F.struct("c", "label")).over(of_hash)["label"]).where("lo <> hi")  # the sets of a hash's largest label don't meet each other
    rows = keep(rows.select("h", F.struct("at", "pos", "n", "label").alias("a"), "top"), "prefix-rows")
    a, b = F.col("a"), F.col("b")
    once = (b["label"] == F.col("top")) | (a["at"] < b["at"])
    found = rows.where(a["label"] != F.col("top")).join(rows.select("h", F.col("a").alias("b")), "h").where((a["label"] != b["label"]) & once & enough(similarity, a, b))
    return found.select(F.least("a.at", "b.at").alias("a"), F.greatest("a.at", "b.at").alias("b")).distinct()


def similar_roots(sets: DataFrame, texts: DataFrame, size: int, similarity: float, counts: np.ndarray | None = None) -> DataFrame:
    """v, root: the component of each set that is as similar at least to another one.

    ``sets`` has at, n, keys and bins of one row for each set, ``texts`` at and text, ``counts`` the `shingle_counts`, if
    they are known: the result does not depend on them.  Pairs whose bins rule the similarity out are discarded before any text is read.
    """
    known = sets.select("at", F.struct("n", "bins").alias("own"))
    links, labels = None, None
    near = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)

    def add(pairs: DataFrame, sure: bool) -> None:
        """Link the pairs (kept, each once) that are so similar, by their bins and then by their texts; all of them if ``sure``."""
        nonlocal links, labels
        many = frequent(pairs.select("a"), "a", pairs.count())  # a set has many pairs: these are more than the sets
        pairs = join_hot(pairs.join(known.select(F.col("at").alias("b"), F.col("own").alias("b_own")), "b"), known.select(F.col("at").alias("a"), F.col("own").alias("a_own")), "a", many, "inner")
        few = least_differing(F.col("a_own.bins"), F.col("b_own.bins")) <= (F.col("a_own.n") + F.col("b_own.n")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
        found = verified(pairs.where(few if sure else few & alike(F.col("a_own.bins"), F.col("b_own.bins"), similarity)).select("a", "b"), texts, size, similarity)
        if links is None or found.head(1):
            links = found if links is None else links.unionByName(found)
            labels = components(links).withColumnRenamed("v", "at")
        release(texts.sparkSession)

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "at", "left").withColumn("label", F.coalesce("root", "at")).drop("root")

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows (key, at, n, m) with their labels, and the least row of their keys; those of keys of several labels alone."""
        rows = named(rows.select("key", "at", "n", "m"))
        keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("at", "n", "label")).alias("least")).where("lo <> hi")
        return keep(join_hot(rows, keys.select("key", "least"), "key", hot, "inner"), "set-mixed")

    def star(rows: DataFrame) -> DataFrame:
        return rows.where(near(F.col("n"), F.col("least.n"))).select(F.col("least.at").alias("a"), F.col("at").alias("b"), "m", "key")

    release(texts.sparkSession)
    rows = sets.select("at", "n", F.explode("keys").alias("key"))
    buckets = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("at", "n")).alias("least")).where("m > 1"), "set-buckets")
    most = max(EASY, HOT_SHARE * BANDS * sets.count())
    hot = [r.key for r in buckets.where(F.col("m") > most).collect()]
    members = keep(join_hot(rows, buckets, "key", hot, "inner"), "set-members")
    # of a group of near copies most are linked by one pair of each, under its fullest key; then by all first pairs across components
    add(keep(star(members.where(F.col("at") != F.col("least.at"))).groupBy("b").agg(F.max_by("a", F.struct("m", "key")).alias("a")).select("a", "b"), "set-stars"), False)
    members = mixed(members)
    add(keep(star(members.where(F.col("label") != F.col("least.label"))).select("a", "b").distinct(), "set-stars"), False)
    # the keys can have missed a pair: all sets once more, by their rare shingles, that miss none
    first = keep(prefixes(texts, size, similarity, np.zeros(COUNTERS, np.uint16) if counts is None else counts), "set-prefixes")
    shared = keep(shared_prefixes(first, named(sets.select("at", "n"))), "set-shared")
    release(texts.sparkSession)
    a, b = F.struct("at", "pos", "n", "label"), F.col("least")
    star_pairs = shared.where((F.col("label") != b["label"]) & enough(similarity, a, b))
    add(keep(star_pairs.select(F.least("at", "least.at").alias("a"), F.greatest("at", "least.at").alias("b")).distinct(), "prefix-stars"), True)
    add(keep(prefix_pairs(shared, named(sets.select("at")), similarity), "prefix-pairs"), True)
    return labels.withColumnRenamed("at", "v")


def components(edges: DataFrame) -> DataFrame:
    """v, root: the least node of its component for each node of a table of links a, b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    most = 2 * edges.count()
    labels = keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("l")), "labels", most)
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("l").alias("m"))
        moved = labels.join(near, labels.v == near.a).select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        moved = keep(moved, "labels", most)
        hot = frequent(moved.select("l"), "l", moved.count())
        parents = moved.select(F.col("v").alias("l"), F.col("l").alias("up"))
        labels = keep(join_hot(moved, parents, "l", hot).select("v", "old", F.least("l", "up").alias("l")), "labels", most)
        if not labels.where("l <> old").head(1):
            return labels.select("v", F.col("l").alias("root"))
        labels = labels.select("v", "l")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Links are fingerprints within RADIUS bits.  A null or blank text has fingerprint zero and is linked like any
    other.  A null id takes part and never becomes a component id; a component of null ids alone has none.
    Repeated rows stay repeated.  Other columns are not read, an empty table gives an empty one.
    """
    rows = keep(fingerprints(docs, id_col, text_col, size), "fingerprints")
    total = rows.count()
    classes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes", total)
    roots = components(links(classes, total)).withColumnRenamed("v", "fp")
    placed = roots.join(classes, "fp").select("fp", "root", "first")
    least = keep(placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "components", total)
    share = max(1.0, HOT_SHARE * total)  # few keys are hot in small tables too
    hot_roots = [r.root for r in least.where(F.col("n") > share).select("root").collect()] if total > 1 / HOT_SHARE else []
    named = join_hot(roots, least.select("root", "component_id"), "root", hot_roots).select("fp", "component_id")
    final = keep(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "classes", total)
    hot = [r.fp for r in final.where(F.col("n") > share).select("fp").collect()] if total > 1 / HOT_SHARE else []
    out = join_hot(rows, final.select("fp", "component_id"), "fp", hot)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of each group of near copies, with its columns as they were.

    A group is a component of rows whose fingerprints are within RADIUS bits, or with ``similarity`` whose
    sets of shingles are as similar at least.  The row of the smallest id stays, a null id only if there is no
    other; of rows of equal id the one whose text, then whose whole row, has the least hash.  So different texts
    under one id stay if they are in different groups, and equal rows become one.  Texts without words are one group.
    An empty table gives an empty one; columns may have any names.
    """
    mark = f"at_{uuid.uuid4().hex}"  # no column can have this name
    held = keep(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    text = F.col(text_col).cast("string")
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    whole = F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in t or "variant" in t else F.col(c) for c, (_, t) in zip(quoted, docs.dtypes)))
    order = held.select(F.col(mark).alias("at"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text"), whole.alias("whole"), F.col(mark).alias("at")).alias("order"))
    texts = held.select(F.col(mark).alias("at"), text.alias("text"))
    if similarity is None:
        rows = keep(fingerprints(texts, "at", "text", size).withColumnRenamed("doc_id", "at"), "fingerprints")
    else:
        sets = keep(shingle_sets(texts, size), "shingle-sets")
        counts, sets = shingle_counts(sets), sets.where("at is not null")
        rows = sets.select("at", "fp")
    classes = keep(rows.join(order, "at").groupBy("fp").agg(F.min("order").alias("first"), F.min("at").alias("at")), "classes")
    if similarity is None:
        roots = components(links(classes.select("fp"), classes.count())).withColumnRenamed("v", "fp")
        placed = classes.join(roots, "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    else:
        once = sets.join(classes.select("at"), "at", "left_semi")
        roots = similar_roots(keep(once.select("at", "n", "keys", "bins"), "set-classes"), texts, size, similarity, counts).withColumnRenamed("v", "at")
        placed = classes.join(roots, "at", "left").select("first", F.coalesce("root", "at").alias("root"))
    stay = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    go = keep(rows.select("at").join(stay, "at", "left_anti"), "rows-to-go", rows.count())  # fewer than those that stay
    return held.join(go.withColumnRenamed("at", mark), mark, "left_anti").select(*quoted)
