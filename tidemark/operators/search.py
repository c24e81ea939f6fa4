"""Retrieval: vector search, BM25 full-text search, hybrid and reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors that one pass over all vectors takes along, vectors that a task compares with them at a time, and queries of one matrix product.
QUERY_BLOCK, ROWS, ASKED = 8_192, 2_000, 256


#: Hashes of terms by which documents' words are looked through.
TERM_HASHES = 1 << 19


def _sound(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have this length and only finite numbers, and those as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    values = column.filter(pa.array(ok)).flatten().cast(pa.float64())
    x = values.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls are NaN
    fine = np.isfinite(x).all(1)
    ok[ok] = fine
    return ok, x[fine]


def nearest_of_each(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): of each query vector (query_id, vector) the limit nearest of all vectors, by Euclidean distance to six decimals; of ties the smaller id.

    Queries go in blocks of bounded size; each block is one pass, in which tasks compare by matrix products of bounded size and keep the limit
    best of each query, so that is all that is shuffled. Of a product only what is no farther than the worst kept is sorted. Ids are whole numbers. Vectors that are null, not finite or of another length than the query are
    found by none, and such queries find none; queries of several lengths go one length at a time.
    """
    spark, schema = vectors.sparkSession, f"query_id bigint, {id_col} bigint, distance double"
    size = queries.select(F.size(vector).alias("size")).where("size > 0").groupBy("size").count().orderBy("size").collect()
    found = spark.createDataFrame([], schema)
    for r in size:
        blocks = -(-r["count"] // QUERY_BLOCK)
        for block in range(blocks):
            asked = queries.where((F.size(vector) == r["size"]) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select(F.col("query_id").cast("bigint"), vector).toArrow()
            ok, matrix = _sound(asked.column(1), r["size"])
            if ok.any():
                found = found.unionByName(_nearest_in_tasks(vectors, asked.column(0).to_numpy()[ok], matrix, limit, id_col, vector, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def _nearest_in_tasks(vectors: DataFrame, names: np.ndarray, matrix: np.ndarray, limit: int, id_col: str, vector: str, schema: str) -> DataFrame:
    squares = (matrix**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each query the best so far, by distance and id; places without one are infinitely far
        ids, best = np.zeros((len(names), limit), np.int64), np.full((len(names), limit), np.inf)
        for batch in batches:
            for part in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
                ok, x = _sound(part.column(1), matrix.shape[1])
                own, length = part.column(0).to_numpy()[ok], (x**2).sum(1)
                for lo in range(0, len(names) if len(x) else 0, ASKED):
                    hi = min(lo + ASKED, len(names))
                    far = matrix[lo:hi] @ x.T
                    far *= -2
                    far += squares[lo:hi, None]
                    far += length
                    worst = best[lo:hi, -1]
                    most = (worst + 1e-6) ** 2  # a little more than rounding hides
                    if len(x) > limit and np.isinf(worst).any():
                        most = np.minimum(most, (np.sqrt(np.maximum(np.partition(far, limit - 1, axis=1)[:, limit - 1], 0)) + 1e-6) ** 2)
                    at, col = np.nonzero(far <= most[:, None])
                    if not len(at):
                        continue
                    near = np.round(np.sqrt(np.maximum(far[at, col], 0)), 6)
                    some = np.unique(at)  # only queries with something new are sorted
                    at = np.concatenate([at, np.repeat(some, limit)])
                    near, new = np.concatenate([near, best[lo + some].ravel()]), np.concatenate([own[col], ids[lo + some].ravel()])
                    order = np.lexsort((new, near, at))
                    at, near, new = at[order], near[order], new[order]
                    keep = np.arange(len(at)) - np.searchsorted(at, at) < limit
                    best[lo + some], ids[lo + some] = near[keep].reshape(-1, limit), new[keep].reshape(-1, limit)
        for lo in range(0, len(names), ASKED):
            found = np.isfinite(best[lo : lo + ASKED])
            asked = np.broadcast_to(names[lo : lo + ASKED, None], found.shape)
            yield pa.RecordBatch.from_arrays([pa.array(asked[found]), pa.array(ids[lo : lo + ASKED][found]), pa.array(best[lo : lo + ASKED][found])], ["query_id", id_col, "distance"])

    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias(id_col), vector).mapInArrow(run, schema)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, n): term frequencies and document lengths. The inverted index; to be kept as a table sorted by term."""
    rows = docs.select("doc_id", terms(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("term", "doc_id", "n").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], limit: int, every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The limit best documents (doc_id, score) for any, or every, of the query's terms; of ties the smaller id."""
    wanted = sorted({w.lower() for w in query})
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size(terms(F.col("text")))).alias("mean"))
    hits = postings(docs).where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    # df has a row for each query term and size has one row
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(size)).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("found"))
    rows = rows.where(F.col("found") == len(wanted)) if every else rows
    return rows.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(limit)


def bm25_of_each(docs: DataFrame, queries: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the limit best documents for any of each query's terms (query_id, term), lower-cased; of ties the smaller id.

    Postings are made once for all queries, and only those of asked terms are counted and joined: a table of fixed size, of hashes of asked terms,
    goes to all tasks, so of other terms hardly any is shuffled, and asked terms then tell exactly. A document's scores add up before the
    shuffle that ranks them.
    """
    wanted = queries.select("query_id", F.lower("term").alias("term")).distinct()
    place = F.pmod(F.xxhash64("term"), F.lit(TERM_HASHES)).alias("place")
    likely = F.broadcast(wanted.select(place).distinct())  # at most TERM_HASHES rows
    words = docs.select("doc_id", terms(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), "w").select("doc_id", "n", F.explode("w").alias("term"))
    words = words.select("*", place).join(likely, "place", "left_semi")
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size(terms(F.col("text")))).alias("mean"))
    hits = words.groupBy("term", "doc_id", "n").agg(F.count(F.lit(1)).alias("tf")).join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    weighed = hits.join(df, "term").join(F.broadcast(size)).select("term", "doc_id", part.alias("w"))  # size has one row
    rows = weighed.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def fused_of_each(rankings: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """(query_id, id, score, rank): reciprocal-rank fusion of rankings (query_id, id, rank) for each query."""
    rows = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "id", "rank"))
    rows = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


def hybrid_of_each(vector: DataFrame, text: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, rank): each query's vector hits (query_id, id, rank) first, then text hits that aren't among them, cut to the limit."""
    both = vector.select("query_id", "id", F.lit(0).alias("part"), "rank").unionByName(text.select("query_id", "id", F.lit(1).alias("part"), "rank"))
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank")).where(F.col("rank") <= limit)
