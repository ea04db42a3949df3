"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Each source gets a share of all words (`source_targets`); a document of a source is to be taken
target / source size times on average.  The whole part is taken for sure.  The fractional parts are
rounded in pairs: of two documents with fractional parts, mass (words) is moved from one to the
other at random until one of them is whole, so that every document keeps its expectation and the
source keeps its expected number of words exactly.

The pairs form a reduction tree: the units of a source are dealt to blocks of about ``BLOCK`` units
by a hash, each block is folded to at most one unit that is still fractional, and these go on to the
next level until one is left, which is rounded alone.  A level is one grouped aggregation of bounded
groups; random numbers are hashes of ids and level, so reruns agree whatever the partitioning.

Equal rows are one unit: of c rows that are each to be taken p times more, the whole part of c p are, and only
the rest is rounded.  The rows that are taken are told from the others by their numbers in the unit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import HOT_SHARE, join_hot, keep

WEIGHTS = (5, 2, 1)
MOST = 3  # a source is repeated so many times at most
BLOCK, SALTS = 64, 1024
AT_ONCE, BLOCK_BITS = 16 << 20, 12  # rows whose copies are broadcast; bits of a row's place in a block of them
WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what counts as a word


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row for each source of a table of source and source_size.

    Sources in code-point order, null last, get the weights in turn.  A source is full at ``most``
    times its size.  In the order of size by weight, the sources before some place are full, and the
    others share what is left by weight; that place is the first from which nobody is over.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (k + 1).cast("int"))
    full = (most * F.col("source_size")).cast("double")
    by = Window.orderBy((full / w).asc(), F.col("source").asc_nulls_last())
    table = sizes.withColumn("w", w).withColumn("full", full)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumns({"used": F.coalesce(F.sum("full").over(before), F.lit(0.0)), "left_w": F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0)), "words": F.sum("source_size").over(total).cast("double")})
    level = (F.col("words") - F.col("used")) / F.col("left_w")  # the level if all before are full and none from here on
    table = table.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("full"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table.withColumn("target", F.least(F.col("full"), F.coalesce(level * F.col("w"), F.col("full")))).select("source", "source_size", "target")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Fold units (key, p, w) to struct(left: the unit still fractional or null, done: units that became whole)."""
    unit = "struct<key:bigint,p:double,w:double>"
    start = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(f"array<{unit}>").alias("done"))

    def made(key, p, w):
        return F.struct(key.alias("key"), p.alias("p"), w.alias("w"))

    def step(state, x):
        a = state["left"]
        up = F.least(a["w"] * (1 - a["p"]), x["w"] * x["p"])  # words that may move to a
        down = F.least(a["w"] * a["p"], x["w"] * (1 - x["p"]))  # and from a
        to_a = _uniform(a["key"], x["key"], F.lit(level), F.lit(seed)) * (up + down) < down
        a_full = a["w"] * (1 - a["p"]) <= x["w"] * x["p"]
        a_out = a["w"] * a["p"] <= x["w"] * (1 - x["p"])
        one, zero = F.lit(1.0), F.lit(0.0)
        new_a = F.when(to_a, F.when(a_full, one).otherwise(a["p"] + up / a["w"])).otherwise(F.when(a_out, zero).otherwise(a["p"] - down / a["w"]))
        new_x = F.when(to_a, F.when(a_full, x["p"] - up / x["w"]).otherwise(zero)).otherwise(F.when(a_out, x["p"] + down / x["w"]).otherwise(one))
        # the one that became whole is done, the other goes on (it may be whole too: then both are)
        pair = F.array(made(a["key"], new_a, a["w"]), made(x["key"], new_x, x["w"]))
        whole = F.filter(pair, lambda u: (u["p"] <= 1e-12) | (u["p"] >= 1 - 1e-12))
        rest = F.filter(pair, lambda u: (u["p"] > 1e-12) & (u["p"] < 1 - 1e-12))
        moved = F.struct(F.try_element_at(rest, F.lit(1)).alias("left"), F.concat(state["done"], whole).alias("done"))
        return F.when(a.isNull(), F.struct(x.alias("left"), state["done"].alias("done"))).otherwise(moved)

    return F.aggregate(units, start, step)


def pivotal_round(units: DataFrame, seed: int, biggest: int, at_most: int, block: int = BLOCK) -> DataFrame:
    """source, key, up (0 or 1) of units (source, n, key, p, w) with p in (0, 1) and w over 0, each key once a source.

    ``n`` is the number of units of the source or more, ``biggest`` the largest n, ``at_most`` their sum.
    """
    done, level, size, now = [], 0, block, units
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / size))
        now = now.withColumn("b", F.pmod(F.xxhash64("key", F.lit(level), F.lit(seed)), blocks))
        # heavy units first: what stays fractional is light
        listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "key", "p", "w"))), lambda u: F.struct(u["key"].alias("key"), u["p"].alias("p"), u["w"].alias("w")))
        folded = now.groupBy("source", "b").agg(F.first("n").alias("n"), listed.alias("u")).select("source", "n", _fold(F.col("u"), level, seed).alias("f"))
        folded = keep(folded, f"pivotal-{level}", at_most)
        done.append(folded.select("source", F.explode("f.done").alias("u")).select("source", "u.key", F.round("u.p").cast("int").alias("up")))
        now = folded.where("f.left is not null").select("source", "n", "f.left.key", "f.left.p", "f.left.w")
        if size >= biggest:
            last = _uniform(F.col("key"), F.lit(level + 1), F.lit(seed)) < F.col("p")
            done.append(now.select("source", "key", last.cast("int").alias("up")))
            break
        level, size, at_most = level + 1, size * block, at_most // block
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """at, number: rows (at, skey, key) numbered from 1 in each key, in SALTS parts that no task needs to see together."""
    rows = keep(rows.select("at", "skey", "key", F.pmod("at", F.lit(SALTS)).alias("salt")), "repeated-rows")
    parts = rows.groupBy("skey", "key", "salt").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("skey", "key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    parts = parts.select("skey", "key", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("skey", "key", "salt").orderBy("at"))
    return rows.withColumn("own", own).join(parts, ["skey", "key", "salt"]).select("at", (F.col("before") + F.col("own")).alias("number"))


def _mixed(rows: DataFrame, seed: int) -> DataFrame:
    """at, doc_id, source, size, source_size, target, copies of stored rows (at, doc_id, source, size, digest)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = keep(sizes, "source-sizes")
    totals = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("biggest")).first()
    total = totals.n or 0
    targets = source_targets(sizes.select("source", "source_size")).join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = keep(targets, "targets")
    source_key = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = targets.withColumn("skey", source_key).withColumnRenamed("source", "named").withColumn("r", ratio)
    hot = [r.skey for r in sizes.where(F.col("n") > HOT_SHARE * total).select(source_key.alias("skey")).collect()]
    placed = join_hot(rows.withColumn("skey", source_key), named, "skey", hot)
    part = F.col("r") - F.floor("r")
    part = F.when(part < 1e-12, F.lit(0.0)).when(part > 1 - 1e-12, F.lit(1.0)).otherwise(part)
    placed = placed.withColumn("part", part).withColumn("key", F.xxhash64(F.col("doc_id"), F.col("size"), F.col("skey"), F.col("digest")))
    units = placed.where("part > 0 and part < 1 and size > 0").groupBy("skey", "key").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("part").alias("part"), F.max("size").cast("double").alias("w"))
    whole = F.floor(F.col("c") * F.col("part") + 1e-9)
    units = keep(units.withColumn("sure", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("c") * F.col("part") - whole)), "units", total)
    rounded = pivotal_round(units.where("p > 1e-12").select(F.col("skey").alias("source"), "n", "key", "p", "w"), seed, totals.biggest or 0, total)
    ups = units.join(rounded.select(F.col("source").alias("skey"), "key", "up"), ["skey", "key"], "left").select("skey", "key", "c", (F.col("sure") + F.coalesce("up", F.lit(0))).alias("ups"))
    ups = keep(ups, "ups", total)
    # the key alone finds a unit nearly always, the source's key makes sure
    often = [r.key for r in ups.where(F.col("c") > max(1.0, HOT_SHARE * total)).select("key").distinct().collect()] if total > 1 / HOT_SHARE else []
    is_often = F.col("key").isin(often) if often else F.lit(False)
    found = placed.where(~is_often).join(ups.where(~is_often), ["skey", "key"], "left")
    if often:
        found = found.unionByName(placed.where(is_often).join(F.broadcast(ups.where(is_often)), ["skey", "key"], "left"))
    more = F.when(F.col("part") >= 1, 1).when(F.col("c") == 1, F.col("ups")).otherwise(F.lit(0))
    if units.where("c > 1").head(1):
        repeated = keep(found.where("c > 1").select("at", "skey", "key", "ups"), "repeated", total)
        number = _numbered(repeated)
        taken = keep(number.join(repeated.select("at", "ups"), "at").where("number <= ups").select("at", F.lit(1).alias("extra")), "taken", total)
        found = found.join(taken, "at", "left")
        more = F.when(F.col("c") > 1, F.coalesce("extra", F.lit(0))).otherwise(more)
    copies = F.when(F.col("size") > 0, F.floor("r") + F.coalesce(more, F.lit(0))).otherwise(0)
    return found.withColumn("copies", copies.cast("int")).select("at", "doc_id", "source", "size", "source_size", "target", "copies")


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), F.xxhash64(text).alias("digest")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row.

    A null text has no words and is taken 0 times, as is any text without words.  A null source is a
    source of its own, the last.  Rows of equal id, source and text are one unit: their copies differ by one
    at most, and their sum is rounded like a single document's.  Null ids count as one id.  Other columns are not
    read, an empty table gives an empty one.
    """
    rows = keep(docs.select(*_rows(docs, id_col, text_col, source_col)), "sizes")
    out = _mixed(rows, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: each row as often as `mix` takes it, with its columns as they were.

    Rows with a null text, or without words, are taken 0 times; null ids and sources, repeated rows and empty
    tables are as in `mix`; columns may have any names.  Words are counted once.  Up to ``AT_ONCE`` rows the copies
    are broadcast, a byte for each, and texts stay where they are; of more rows texts are shuffled once.
    """
    mark = f"row_{uuid.uuid4().hex}"  # no column can have this name
    held = keep(docs.withColumn(mark, F.struct(*_rows(docs, id_col, text_col, source_col))), "rows")
    found = keep(_mixed(held.select(f"{mark}.*"), seed).select("at", "copies"), "copies")
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    at = F.col(f"{mark}.at")
    if found.count() <= AT_ONCE:
        # numbers of a partition's rows have no gap, and a block begins at a multiple of its rows
        listed = F.array_sort(F.collect_list(F.struct("at", F.col("copies").cast("byte").alias("copies"))))
        blocks = found.groupBy(F.shiftright("at", BLOCK_BITS).alias(f"{mark}_block")).agg(F.transform(listed, lambda x: x["copies"]).alias(f"{mark}_copies"))
        joined = held.withColumn(f"{mark}_block", F.shiftright(at, BLOCK_BITS)).join(F.broadcast(blocks), f"{mark}_block")
        copies = F.element_at(f"{mark}_copies", (at.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) + 1).cast("int")).cast("int")
    else:
        found = found.where("copies > 0").select(F.col("at").alias(f"{mark}_at"), F.col("copies").alias(f"{mark}_copies"))
        joined = held.withColumn(f"{mark}_at", at).join(found, f"{mark}_at")
        copies = F.col(f"{mark}_copies")
    joined = joined.select(*quoted, F.array_repeat(F.lit(0), copies).alias(f"{mark}_each"))
    return joined.withColumn(mark, F.explode(f"{mark}_each")).select(*quoted)
