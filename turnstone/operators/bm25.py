"""Column-weighted BM25 over an inverted index held as DataFrames.

The index is a table of postings (chunk_id, col, key, tf) and one of lengths (chunk_id, dl).  A batch of
queries is scored in one job: query terms meet the postings on (col, key), so only postings of asked
terms are read further; the corpus size and the mean length are two numbers.  The per-query top k is a
window that Spark limits on the map side.

`ensure_index` stores the index under a digest of the corpus and the rules: postings in folders by a hash of
the key, sorted by key, those of one key spread over several files; document frequencies; lengths.  It is written
anew only if the digest isn't there.

A term with a decimal point is indexed as its first part too, and counts twice in the length: the
index cuts it there, and a query for the whole is a phrase.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from turnstone.functions.rules import TermRules
from turnstone.functions.terms import exact_of, grams_of, variants
from turnstone.sources.shared import children, exists, input_bytes, kept, remove

# The weights of the two columns, BM25's constants, and the least weight of a term.
WEIGHTS = {"exact": 5.0, "ngram": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_K = 50
RANK_DIGITS, SCORE_DIGITS = 9, 6
SAME = 2 * 10.0**-RANK_DIGITS  # scores no further apart may be equal ones when they are rounded
BLOCK_TERMS = 500_000  # terms of queries that are scored together
LEAST_BUCKETS, BUCKET_BYTES, SPREAD = 8, 8 << 30, 4  # folders of a stored index, stored input for each, files of one at least


@dataclass
class Index:
    """``terms`` has chunk_id, dl, exact and ngram (arrays of distinct terms): postings and lengths come from it.

    ``stored`` has the postings, if they were written, in ``buckets`` folders, and ``frequencies`` how often each key is.
    """

    terms: DataFrame
    ngrams: bool
    stored: DataFrame | None = None
    frequencies: DataFrame | None = None
    buckets: int = 0

    def meet(self, terms: DataFrame) -> DataFrame:
        """The postings of the keys (col, key, and what else) that ``terms`` has; only their folders are read."""
        if not self.buckets:
            return self.postings.join(terms, ["col", "key"])
        return self.stored.join(terms.withColumn("bucket", bucket(self.buckets)), ["bucket", "col", "key"]).drop("bucket")

    @property
    def lengths(self) -> DataFrame:
        return self.terms.select("chunk_id", "dl")

    @property
    def postings(self) -> DataFrame:
        if self.stored is not None:
            return self.stored
        # terms are distinct in a chunk, so only the first part of a decimal can repeat: it is counted in the array
        one, point = F.lit(1).alias("tf"), F.lit(".")
        cut = F.transform("exact", lambda t: F.substring_index(t, ".", 1))
        firsts = F.transform(F.array_distinct(cut), lambda k: F.struct(k.alias("key"), F.size(F.filter(cut, lambda c: c == k)).alias("tf")))
        whole = F.transform(F.filter("exact", lambda t: F.contains(t, point)), lambda t: F.struct(t.alias("key"), one))
        without = self.terms.where("decimals = 0").select("chunk_id", "dl", F.lit("exact").alias("col"), F.explode("exact").alias("key"), one)
        having = self.terms.where("decimals > 0").select("chunk_id", "dl", F.lit("exact").alias("col"), F.inline(F.concat(firsts, whole)))
        found = without.unionByName(having)
        if self.ngrams:
            found = found.unionByName(self.terms.select("chunk_id", "dl", F.lit("ngram").alias("col"), F.explode("ngram").alias("key"), one))
        return found


def _terms(table: DataFrame, id_col: str, text_col: str, rules: TermRules) -> DataFrame:
    """id, exact, ngram: the distinct terms of each row."""
    found = table.select(F.col(id_col).alias("id"), variants(F.col(text_col), rules).alias("v"))
    return found.select("id", exact_of(F.col("v")).alias("exact"), grams_of(F.col("v"), rules).alias("ngram"))


def build_index(chunks: DataFrame, rules: TermRules = TermRules(), id_col: str = "chunk_id", text_col: str = "text") -> Index:
    """The index of chunks; its table is computed once if the caller stores or persists it."""
    found = _terms(chunks, id_col, text_col, rules).withColumnRenamed("id", "chunk_id")
    found = found.withColumn("decimals", F.size(F.filter("exact", lambda t: F.contains(t, F.lit(".")))))
    return Index(found.withColumn("dl", F.size("exact") + F.col("decimals") + F.size("ngram")), rules.ngrams)


def bucket(n: int) -> Column:
    """Which of n folders a key's postings are in."""
    return F.pmod(F.xxhash64("col", "key"), F.lit(n)).cast("int")


def ensure_index(chunks: DataFrame, path: str, rules: TermRules = TermRules(), id_col: str = "chunk_id", text_col: str = "text") -> tuple[Index, bool]:
    """The stored index of these chunks under these rules, and whether it had to be written.

    Each version has a folder of its own, named by the digest of corpus and rules; its frequencies are written last,
    so a version without them is unfinished and is written again.  Versions of other corpora in ``path`` go.
    """
    spark = chunks.sparkSession
    own = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    state = fingerprint(own).first()
    name = hashlib.sha256(f"{state.fingerprint}:{state.chunks}:{rules!r}".encode()).hexdigest()[:32]
    home = f"{path.rstrip('/')}/{name}"
    rebuilt = not exists(spark, f"{home}/frequencies/_SUCCESS")
    buckets = max(LEAST_BUCKETS, -(-input_bytes(chunks) // BUCKET_BYTES))
    if rebuilt:
        build_index(own, rules).terms.write.mode("overwrite").parquet(f"{home}/terms")
    terms = spark.read.parquet(f"{home}/terms")
    postings = Index(terms, rules.ngrams).postings.withColumn("bucket", bucket(buckets))
    if rebuilt:
        placed = postings.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "col", "key")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/postings")
        counted = spark.read.schema(postings.schema).parquet(f"{home}/postings").groupBy("bucket", "col", "key").agg(F.count(F.lit(1)).alias("df"))
        counted.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{home}/frequencies")
        for other in children(spark, path):
            if other != name:
                remove(spark, f"{path.rstrip('/')}/{other}")
    frequencies = spark.read.parquet(f"{home}/frequencies")
    held = frequencies.first()
    return Index(terms, rules.ngrams, spark.read.schema(postings.schema).parquet(f"{home}/postings"), frequencies, held.buckets if held else buckets), rebuilt


def query_terms(queries: DataFrame, rules: TermRules = TermRules(), id_col: str = "qid", text_col: str = "text") -> DataFrame:
    """qid, col, key: the distinct terms of each query."""
    found = _terms(queries, id_col, text_col, rules).withColumnRenamed("id", "qid")
    exact = found.select("qid", F.lit("exact").alias("col"), F.explode("exact").alias("key"))
    if not rules.ngrams:
        return exact
    return exact.unionByName(found.select("qid", F.lit("ngram").alias("col"), F.explode("ngram").alias("key")))


def corpus_stats(index: Index) -> DataFrame:
    """n_docs and avgdl, over the whole corpus."""
    return index.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_stats(index: Index) -> DataFrame:
    """col, key, df: in how many chunks each key stands in each column."""
    if index.frequencies is not None:
        return index.frequencies.select("col", "key", "df")
    return index.postings.groupBy("col", "key").agg(F.count(F.lit(1)).alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    raw = F.ln((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def term_parts(index: Index, terms: DataFrame) -> DataFrame:
    """col, key, chunk_id, part: what each posting of an asked term adds to a score, whatever the query."""
    wanted = terms.select("col", "key").distinct()
    if index.frequencies is None:
        postings = index.meet(wanted)
        found = postings.join(postings.groupBy("col", "key").agg(F.count(F.lit(1)).alias("df")), ["col", "key"])
    else:
        found = index.meet(term_stats(index).join(wanted, ["col", "key"]))
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("col") == name, F.lit(w)).otherwise(weight)
    f = weight * F.col("tf")
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    found = found.crossJoin(F.broadcast(corpus_stats(index)))  # one row
    return found.select("col", "key", "chunk_id", (idf(F.col("n_docs"), F.col("df")) * f * (K1 + 1) / (f + norm)).alias("part"))


def scores(index: Index, terms: DataFrame) -> DataFrame:
    """qid, chunk_id, score, matched: of all chunks that share a term with a query."""
    found = terms.join(term_parts(index, terms), ["col", "key"])
    return found.groupBy("qid", "chunk_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched"))


def by_topic(chunks: DataFrame, topic: str) -> DataFrame:
    return chunks.where(F.array_contains("topics", topic))


def by_question_number(chunks: DataFrame, number: int) -> DataFrame:
    return chunks.where(F.array_contains("question_numbers", number))


def search(index: Index, queries: DataFrame, k: int = 5, rules: TermRules = TermRules(), among: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """qid, rank, chunk_id, score, candidate_count: the best k chunks of each query.

    ``among`` has the chunk_ids that may be returned; it doesn't change the statistics.  Chunks of
    equal score are ordered by chunk_index, if ``order`` has one for each chunk_id, then by chunk_id.
    """
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must lie between 1 and {MOST_K}")
    terms = kept(query_terms(queries, rules), "query-terms")
    found = None
    for block in range(blocks := max(1, -(-terms.count() // BLOCK_TERMS))):
        own = terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else terms
        best = _best(index, own, k, among)
        found = best if found is None else found.unionByName(best)
    found = kept(found, "best-chunks")
    counted = found.where("n > 0").groupBy("qid").agg(F.sum("n").alias("candidate_count"))
    found = found.where("n = 0")
    if order is not None:
        found = found.join(order.select("chunk_id", "chunk_index"), "chunk_id", "left")
    keys = [F.round("score", RANK_DIGITS).desc(), *([F.col("chunk_index")] if order is not None else []), F.col("chunk_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*keys))).where(F.col("rank") <= k)
    return ranked.join(counted, "qid").select("qid", "rank", "chunk_id", F.round("score", SCORE_DIGITS).alias("score"), "candidate_count")


def _best(index: Index, terms: DataFrame, k: int, among: DataFrame | None) -> DataFrame:
    """qid, chunk_id, score, n: of each query the chunks that can be among its best k, with n = 0; and rows that count in n what chunks it meets.

    A chunk's parts come together once, and are added up there for all queries: no row is made for a chunk and a query but
    for those that are not below the k best that a task has seen, ties included.
    """
    rows = terms.collect()  # at most about BLOCK_TERMS
    number = {key: n for n, key in enumerate(dict.fromkeys((r.col, r.key) for r in rows))}
    queries = {qid: n for n, qid in enumerate(dict.fromkeys(r.qid for r in rows))}
    schema = StructType([terms.schema["qid"], index.terms.schema["chunk_id"], StructField("score", DoubleType()), StructField("n", LongType())])
    spark = terms.sparkSession
    if not rows:
        return spark.createDataFrame([], schema)
    at = np.array([number[r.col, r.key] for r in rows])
    asked_by = np.array([queries[r.qid] for r in rows])[np.argsort(at, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(number)))])
    numbered = spark.createDataFrame([(*key, n) for key, n in number.items()], "col string, key string, number int")
    parts = term_parts(index, terms).join(F.broadcast(numbered), ["col", "key"]).groupBy("chunk_id").agg(F.collect_list(F.struct("number", "part")).alias("l"))
    parts = parts.select("chunk_id", F.col("l.number").alias("number"), F.col("l.part").alias("part"))
    if among is not None:
        parts = parts.join(among.select("chunk_id").distinct(), "chunk_id", "left_semi")
    qids, width = list(queries), len(queries)
    qid_type, id_type = to_arrow_type(schema["qid"].dataType), to_arrow_type(schema["chunk_id"].dataType)
    at_once = max(1, min(64, (1 << 22) // width))

    def run(batches):
        best, counts = np.zeros((width, k)), np.zeros(width, np.int64)
        names = pa.array(qids, qid_type)
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                some = batch.slice(first, at_once)
                sizes = pc.list_value_length(some.column(1)).to_numpy(zero_copy_only=False)
                keys, values = some.column(1).flatten().to_numpy(), some.column(2).flatten().to_numpy()
                asked = starts[keys + 1] - starts[keys]
                into = np.repeat(starts[keys] - np.concatenate([[0], np.cumsum(asked)[:-1]]), asked) + np.arange(asked.sum())
                cells = asked_by[into] + np.repeat(np.repeat(np.arange(len(sizes)), sizes) * width, asked)
                sums = np.bincount(cells, np.repeat(values, asked), width * len(sizes)).reshape(-1, width)
                counts += (sums > 0).sum(axis=0)  # every part is above zero
                best = np.sort(np.concatenate([best, sums.T], axis=1), axis=1)[:, -k:]
                chunk, query = np.nonzero((sums > 0) & (sums >= best[:, 0] - SAME))
                score = pa.array(sums[chunk, query])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), some.column(0).take(pa.array(chunk)), score, pa.array(np.zeros(len(chunk), np.int64))], names=schema.names)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(met)), pa.nulls(len(met), id_type), pa.nulls(len(met), pa.float64()), pa.array(counts[met])], names=schema.names)

    return parts.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in schema.fields]))


def candidate_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("candidate_count"))


def termless(queries: DataFrame, rules: TermRules = TermRules()) -> DataFrame:
    """Queries without a term, as problems: they can't be searched for."""
    rows = queries.select("qid", F.size(variants(F.col("text"), rules)).alias("n"))
    return rows.where("n = 0").select(F.concat(F.lit("no search term in query "), F.col("qid").cast("string")).alias("problem"))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One digest of all chunks' ids and texts, in order of id: a two-level one, so that no task sees all.

    Each id and text digest falls in one of 4096 buckets by a hash of the id; a bucket is the sum of
    its rows' hashes, and the fingerprint is the digest of the buckets in order.
    """
    row = F.sha2(F.concat(F.col("chunk_id").cast("string"), F.lit(":"), F.sha2("text", 256)), 256)
    head = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    tail = F.conv(F.substring(row, 13, 12), 16, 10).cast("decimal(38,0)")
    bucket = F.conv(F.substring(F.sha2(F.col("chunk_id").cast("string"), 256), 1, 3), 16, 10).cast("int")
    parts = chunks.select(bucket.alias("bucket"), head.alias("head"), tail.alias("tail")).groupBy("bucket").agg(F.sum("head").alias("head"), F.sum("tail").alias("tail"), F.count(F.lit(1)).alias("n"))
    line = F.concat_ws(":", F.col("bucket").cast("string"), F.col("n").cast("string"), F.col("head").cast("string"), F.col("tail").cast("string"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", line.alias("line")))), lambda x: x["line"]), "\n")
    return parts.agg(F.sha2(F.coalesce(joined, F.lit("")), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
