"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.sources.shared import input_bytes, shared_dir  # noqa: F401  the operators have both from here

#: A key is hot from this share of the rows; so at most 1000 keys can be hot, whatever the input.
HOT_SHARE = 0.001

#: Bounds of one Arrow batch that a Python worker holds.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a small table that go to one file.
ROWS_PER_FILE = 40_000


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives a lost executor.

    ``rows`` is a bound on the number of rows, where one is known: a small table then goes to few
    files, however many partitions it comes from.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Give back what the driver no longer needs, in a long row of jobs: its garbage holds memory, and keeps Spark from deleting
    shuffle files and broadcasts of jobs whose results were kept.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of this session holds, in rows and in bytes; for good, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_column(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, picks: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, max_bytes: int, per_label: int | None = None) -> list[tuple[str, object]]:
    """At most ``rows`` labelled texts of about ``max_bytes`` bytes at most, for fitting a model on the driver.

    ``picks`` holds (id, label).  The ids with the smallest hashes are taken, so a rerun takes the
    same ones; only these ids are broadcast, and only their texts are collected.  Of a longer text a
    window is taken, at a place that depends on the id.  With ``per_label`` each label has an equal part of
    the rows, and at least so many.  Null ids, labels and texts are left out, repeated ids count once.
    """
    spark = docs.sparkSession
    ids = picks.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(label_col).alias("y"))
    ids = ids.groupBy("i").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("i"))
    if per_label is None:
        chosen = ids.orderBy("h", "i").limit(rows)
    else:
        most = max(per_label, rows // max(1, ids.select("y").distinct().count()))
        least_first = Window.partitionBy("y").orderBy("h", "i")  # limited before it is shuffled
        chosen = ids.withColumn("n", F.row_number().over(least_first)).where(F.col("n") <= most)
    labels = {r.i: r.y for r in chosen.select("i", "y").collect()}
    if not labels:
        return []
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in labels], "i long"))
    text = F.col("t")
    size = F.floor(F.length(text) * (F.lit(max_bytes) / F.octet_length(text))).cast("int")
    window = F.substring(text, F.pmod(F.xxhash64("i"), F.length(text) - size + 1).cast("int") + 1, size)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(wanted, "i", "left_semi")
    found = texts.select("i", F.when(F.octet_length(text) > max_bytes, window).otherwise(text).alias("t")).collect()
    once = {}
    for r in found:
        once[r.i] = min(once.get(r.i, r.t), r.t)
    return [(once[i], labels[i]) for i in sorted(once)]


def join_hot(left: DataFrame, right: DataFrame, on: str, hot: list, how: str = "left") -> DataFrame:
    """Join on one column whose hot values are given: at most 1/HOT_SHARE of them.

    ``right`` has one row for each value.  Rows of hot values meet their partner by broadcast, the
    others in a shuffle in which no value is frequent.
    """
    if not hot:
        return left.join(right, on, how)
    assert len(hot) <= 1 / HOT_SHARE, "more hot keys than the share allows"
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), on, how)
    return cold.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how))


class Memo(dict):
    """A bounded memory of solved keys: two generations of at most ``size`` keys each."""

    def __init__(self, solve, size: int = 250_000, longest: int = 64):
        super().__init__()
        self.solve, self.size, self.longest, self.old = solve, size, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.solve(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
