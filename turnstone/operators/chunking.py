"""Turns to chunks: long turns are split, turns are packed into overlapping windows, windows are rendered.

Both steps are folds, for each next piece depends on where the last one ended; they run as array
aggregates inside the JVM, one lesson to a row.  A lesson is the unit of parallelism and is as long as
a talk, not as the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions.text import ratio, strip

# Where sentences end, the least budget of a turn, and what the gate demands.
SENTENCE_BREAK = r"(?U)(?<=[.!?。！？])\s+"
LEAST_BUDGET, LEAST_TARGET = 100, 200
TARGET_CHARS, OVERLAP_TURNS = 700, 1
LEAST_PARSED, MOST_OVERSIZE = 0.99, 0.05


def split_long(text: Column, budget: Column) -> Column:
    """Pieces of a text of at most ``budget`` characters.

    Sentences are joined by single spaces while they fit; a sentence that is too long gives its words
    to the same running piece; a word that is too long stays whole; a blank text is its own only piece.
    """
    sentences = F.filter(F.transform(F.split(strip(text), SENTENCE_BREAK), strip), lambda s: s != "")
    atoms = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > budget, F.split(s, r"(?U)\s+")).otherwise(F.array(s))))
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def add(state: Column, atom: Column) -> Column:
        fits = F.length(state["now"]) + 1 + F.length(atom) <= budget
        return (
            F.when(state["now"] == "", F.struct(atom.alias("now"), state["done"].alias("done")))
            .when(fits, F.struct(F.concat(state["now"], F.lit(" "), atom).alias("now"), state["done"].alias("done")))
            .otherwise(F.struct(atom.alias("now"), F.concat(state["done"], F.array(state["now"])).alias("done")))
        )

    pieces = F.aggregate(atoms, start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(text))


def units(turns: DataFrame, target_chars: int = TARGET_CHARS) -> DataFrame:
    """Turns cut to the budget: lesson, unit_index and the columns of the turn."""
    budget = F.greatest(F.lit(LEAST_BUDGET), target_chars - F.length("speaker") - 2)
    pieces = turns.withColumn("pieces", F.when(F.length(strip(F.col("text"))) <= budget, F.array(F.regexp_replace(strip(F.col("text")), SENTENCE_BREAK, " "))).otherwise(split_long(F.col("text"), budget)))
    pieces = pieces.withColumn("pieces", F.when(F.col("pieces")[0] == "", F.array("text")).otherwise(F.col("pieces")))
    unit = F.struct("turn_index", "piece_index", "speaker", F.col("piece").alias("text"), "source_line", "start_sec", "end_sec")
    cut = pieces.select("lesson", "turn_index", "speaker", "source_line", "start_sec", "end_sec", F.posexplode("pieces").alias("piece_index", "piece"))
    return cut.groupBy("lesson").agg(F.array_sort(F.collect_list(unit)).alias("units"))


def windows(sizes: Column, target_chars: int, overlap: int) -> Column:
    """Windows [first, end) over units of the given rendered sizes.

    A window takes units while they fit, separators counted, and always takes one.  The next one starts
    ``overlap`` units before its end, but at least one unit after its start.
    """
    n = F.size(sizes)
    window = "struct<first:int,end:int>"
    start = F.struct(F.lit(0).alias("first"), F.array().cast(f"array<{window}>").alias("done"))

    def close(state: Column, k: Column) -> Column:
        """End the open window before unit k, if it has a unit and k doesn't fit."""
        inside = F.slice(sizes, state["first"] + 1, F.greatest(k - state["first"], F.lit(0)))
        held = F.aggregate(inside, F.lit(0), lambda a, s: a + s) + F.size(inside)
        full = (k > state["first"]) & (held + F.element_at(sizes, k + 1) > target_chars)
        ended = F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), k.alias("end"))))
        return F.when(full, F.struct(F.greatest(state["first"] + 1, k - overlap).alias("first"), ended.alias("done"))).otherwise(state)

    def add(state: Column, k: Column) -> Column:
        # after so many closings unit k fits, or stands alone
        return F.aggregate(F.sequence(F.lit(0), F.lit(overlap)), state, lambda s, _: close(s, k))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    last = lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), n.alias("end"))))
    return F.when(n > 0, F.aggregate(places, start, add, last)).otherwise(F.array().cast(f"array<{window}>"))


def build_chunks(turns: DataFrame, target_chars: int = TARGET_CHARS, overlap_turns: int = OVERLAP_TURNS) -> DataFrame:
    """Chunks of each lesson: lesson, chunk_index, turn and line ranges, times, speakers, char_count, text."""
    if target_chars < LEAST_TARGET:
        raise ValueError(f"target_chars must be {LEAST_TARGET} at least")
    if overlap_turns < 0:
        raise ValueError("overlap_turns must not be negative")
    packed = units(turns, target_chars).withColumn("sizes", F.transform("units", lambda u: F.length(u["speaker"]) + F.length(u["text"]) + 2))
    cut = packed.select("lesson", "units", F.posexplode(windows(F.col("sizes"), target_chars, overlap_turns)).alias("chunk_index", "w"))
    cut = cut.select("lesson", "chunk_index", F.slice("units", F.col("w.first") + 1, F.col("w.end") - F.col("w.first")).alias("u"))

    def of(name: str) -> Column:
        return F.transform("u", lambda x: x[name])

    text = F.array_join(F.transform("u", lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n")
    return cut.select(
        "lesson", "chunk_index", F.col("u")[0]["turn_index"].alias("turn_start"), F.element_at("u", -1)["turn_index"].alias("turn_end"),
        F.array_min(of("source_line")).alias("source_line_start"), F.array_max(of("source_line")).alias("source_line_end"),
        F.array_min(of("start_sec")).alias("start_sec"), F.array_max(of("end_sec")).alias("end_sec"),
        F.array_distinct(of("speaker")).alias("speakers"), F.length(text).alias("char_count"), text.alias("text"),
    )


def chunk_metrics(turns: DataFrame, chunks: DataFrame, target_chars: int = TARGET_CHARS) -> DataFrame:
    """One row for each lesson: sizes, coverage, and rates of empty, oversize and duplicate chunks and of overlap."""
    source = turns.groupBy("lesson").agg(F.count(F.lit(1)).alias("source_turn_count"))
    cut = units(turns, target_chars).select("lesson", F.size("units").alias("unit_count"), F.aggregate("units", F.lit(0), lambda a, u: a + F.length(u["speaker"]) + F.length(u["text"]) + 2).alias("unit_chars"))
    covered = chunks.select("lesson", F.explode(F.sequence("turn_start", "turn_end")).alias("t")).groupBy("lesson").agg(F.count_distinct("t").alias("covered"))
    n = F.count(F.lit(1))
    sizes = F.array_sort(F.collect_list("char_count"))
    own = chunks.groupBy("lesson").agg(
        n.alias("chunk_count"), F.round(F.avg("char_count"), 1).alias("mean_chunk_chars"), F.round(F.median("char_count"), 1).alias("median_chunk_chars"),
        F.element_at(sizes, (F.bround((n - 1) * 0.95) + 1).cast("int")).cast("double").alias("p95_chunk_chars"),
        F.round(F.count_if(strip(F.col("text")) == "") / n, 4).alias("empty_chunk_rate"), F.round(F.count_if(F.col("char_count") > target_chars) / n, 4).alias("oversize_chunk_rate"),
        F.round(1 - F.count_distinct("text") / n, 4).alias("duplicate_text_rate"), F.sum("char_count").alias("stored_chars"),
    )
    unique = F.col("unit_chars") + F.greatest(F.lit(0), F.col("unit_count") - 1)
    return (
        source.join(cut, "lesson").join(covered, "lesson").join(own, "lesson")
        .withColumn("source_turn_coverage_rate", F.round(ratio(F.col("covered"), F.col("source_turn_count")), 4))
        .withColumn("estimated_overlap_rate", F.round(ratio(F.greatest(F.lit(0), F.col("stored_chars") - unique), F.col("stored_chars")), 4))
        .drop("covered", "unit_chars", "stored_chars")
    )


def chunk_gate(metrics: DataFrame) -> DataFrame:
    """lesson, five checks and status; ``metrics`` may have a parse_rate."""
    parsed = F.col("parse_rate") >= LEAST_PARSED if "parse_rate" in metrics.columns else F.lit(True)
    checks = {
        "parse_ok": parsed, "coverage_ok": F.col("source_turn_coverage_rate") == 1, "empty_ok": F.col("empty_chunk_rate") == 0,
        "oversize_ok": F.col("oversize_chunk_rate") <= MOST_OVERSIZE, "duplicate_ok": F.col("duplicate_text_rate") == 0,
    }
    rows = metrics.select("lesson", *(c.alias(name) for name, c in checks.items()))
    every = F.lit(True)
    for name in checks:
        every = every & F.col(name)
    return rows.withColumn("status", F.when(every, "PASS").otherwise("FAIL"))
