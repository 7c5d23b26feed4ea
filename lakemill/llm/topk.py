"""Exact top-k by inner product: distributed histograms locate each query's kth score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm import common

SCALE = 1024
#: Queries that are scored against all rows in one pass: the only thing that is sent to every task.
QUERY_BLOCK = 4096
#: Numbers of queries and vector components that one block holds at most.
BLOCK_CELLS = 4_000_000
BINS = 256
#: Rows scored at once in a task.
ROW_BLOCK = 2048
#: Scores up to this are told apart by histograms; those beyond are exact too, and ranked by all their digits.
FAR = 1 << 61
#: A kth score is located well enough once so many rows reach the lower edge of its bin.
SLACK = 64


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as double; from 2 ** 53 on a double has no fraction, and a long might not hold it."""

    def one(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components; -x and x tell an infinity, isnan a NaN."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))), F.lit(False))


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def _products(matrix: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer inner products (queries x rows), those beyond FAR cut to it.

    Rows and queries whose products could pass what a number of 64 bits holds are multiplied with Python's integers.
    """
    width = max(matrix.shape[1], 1)
    small = np.sqrt(2.0**61 / width)
    query_most, row_most = np.abs(matrix).max(axis=1, initial=0.0), np.abs(block).max(axis=1, initial=0.0)
    if query_most.max(initial=0.0) * row_most.max(initial=0.0) * width < 2**53:  # every partial sum is an integer that a double holds
        return (matrix @ block.T).astype(np.int64)
    q, r = query_most < small, row_most < small
    out = np.zeros((len(matrix), len(block)), np.int64)
    out[np.ix_(q, r)] = matrix[q].astype(np.int64) @ block[r].astype(np.int64).T
    for i, j in np.argwhere(~(q[:, None] & r[None, :])).tolist():
        out[i, j] = max(-FAR, min(FAR, _exact(matrix[i], block[j])))
    return out


def _scores(ids: pa.Array, vectors: pa.Array, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and integer scores (queries x rows) of the rows as long as the queries, block by block."""
    width, lengths = matrix.shape[1], vectors.value_lengths().to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(lengths == width)
    ids = ids.to_numpy(zero_copy_only=False)
    for at in range(0, len(keep), ROW_BLOCK):
        part = keep[at : at + ROW_BLOCK]
        block = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)
        yield ids[part], block, _products(matrix, block)


def _digits(score: int) -> str:
    """Text that sorts as the numbers do."""
    size = f"{len(str(abs(score))):05d}{abs(score)}"
    return f"1{size}" if score >= 0 else "0" + size.translate(str.maketrans("0123456789", "9876543210"))


def _histograms(rows: DataFrame, qids: np.ndarray, matrix: np.ndarray, low: np.ndarray, step: np.ndarray) -> dict[int, np.ndarray]:
    """For each query, the number of scores in each of BINS bins from ``low`` on, ``step`` wide.

    Each task sums its own rows first, so a query sends one row of counts a task at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(qids), BINS), np.int64)
        lane = np.arange(len(qids))[:, None] * BINS
        for batch in batches:
            for ids, _, scores in _scores(batch.column(0), batch.column(1), matrix):
                place = (scores - low[:, None]) // step[:, None]
                good = (place >= 0) & (place < BINS) & (ids[None, :] != qids[:, None])
                total += np.bincount((place + lane)[good], minlength=total.size).reshape(total.shape)
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b])], ["q", "bin", "n"])

    counts = rows.mapInArrow(common.task("none", count), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    out = {}
    for q, bins, n in counts.groupBy("q").agg(F.collect_list("bin"), F.collect_list("n")).toLocalIterator():
        out[q] = np.zeros(BINS, np.int64)
        out[q][bins] = n
    return out


def _edges(rows: DataFrame, qids: np.ndarray, matrix: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that at least k rows reach and few more do, by refining histograms of the scores."""
    low = -reach
    step = np.maximum((2 * reach + BINS) // BINS, 1)
    above = np.zeros(len(qids), np.int64)  # rows over the range in hand
    edge = np.full(len(qids), np.iinfo(np.int64).min)
    todo = np.arange(len(qids))
    while len(todo):
        found = _histograms(rows, qids[todo], matrix[todo], low[todo], step[todo])
        rest = []
        for i, q in enumerate(todo.tolist()):
            reached = above[q] + np.cumsum(found.get(i, np.zeros(BINS, np.int64))[::-1])[::-1]
            bins = np.flatnonzero(reached >= k)
            if not len(bins):
                continue  # fewer than k rows: all are wanted
            b = int(bins[-1])
            edge[q] = low[q] + b * step[q]
            if step[q] > 1 and reached[b] > k + SLACK:
                above[q] = reached[b + 1] if b + 1 < BINS else above[q]
                low[q], step[q] = edge[q], max(-(-int(step[q]) // BINS), 1)
                rest.append(q)
        todo = np.array(rest, np.int64)
    return edge


@common.tidy
def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k highest integer inner products of each query row with all other rows of ``vectors`` (vec_id, embedding).

    Every row is scored in every pass. Histograms of the scores, summed over all tasks and refined where the kth
    score lies, give each query an edge that at least k rows reach; a last pass keeps rows at or over it, each task
    its k best by (score, smaller vec_id), and the k best of those are ranked. So however many rows tie, a query
    receives k rows a task at most. Queries go in blocks of at most ``query_block``, cut by a hash of vec_id; only a
    block is on the driver and in a task, and each block reads all rows once more for each pass.

    Defined results: vectors that are null or hold null or non-finite components take no part; vectors of other
    lengths than the query's are not compared; rows with the query's vec_id or a null vec_id are not candidates;
    repeated query rows with one vec_id ask once, by the smallest vector; repeated candidates each count; fewer than
    k candidates give fewer rows; an empty table gives none; other columns are ignored; components whose scaled value
    is no finite double count as non-finite; scores are ranked exactly whatever their size, and those that 64 bits do
    not hold are returned as the nearest number that they do.
    """
    spark = vectors.sparkSession
    ready = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding"), scale).alias("v"))
    ready = ready.where(usable(F.col("v")))
    rows = common.cut(ready, "vectors")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = asked.select(F.size("v").alias("width")).groupBy("width").count().collect()
    path = common.new_path(spark, "topk")  # of all blocks, so that the plan of the result does not grow with them
    found = False
    # one integer a vector length, whose number the model's widths bound
    for width, n in sorted(map(tuple, size)):
        same = rows.where(F.size("v") == width)
        far = same.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)))).first()[0]
        blocks = math.ceil(1.5 * n / min(query_block, max(1, BLOCK_CELLS // max(width, 1)))) if n > query_block or n * width > BLOCK_CELLS else 1
        for b in range(blocks):
            got = asked.where((F.size("v") == width) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toPandas()
            if not len(got):
                continue
            got = got.sort_values("vec_id")
            qids, matrix = got["vec_id"].to_numpy(np.int64), np.array(got["v"].tolist(), np.float64).reshape(len(got), width)
            with np.errstate(over="ignore", invalid="ignore"):
                reach = np.minimum(np.nan_to_num(np.abs(matrix).max(axis=1, initial=0.0) * far), float(FAR)).astype(np.int64)
            _best(same, qids, matrix, _edges(same, qids, matrix, reach, k), k).write.mode("append").parquet(path)
            found = True
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def _best(rows: DataFrame, qids: np.ndarray, matrix: np.ndarray, edge: np.ndarray, k: int) -> DataFrame:
    """The k best of each query. Only scores beyond FAR, which are as one there, have ``digits``."""
    names = ["q", "vec_id", "score", "digits"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.DataFrame({"q": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64), "digits": np.empty(0, object)})
        for batch in batches:
            for ids, block, scores in _scores(batch.column(0), batch.column(1), matrix):
                q, r = np.nonzero((scores >= edge[:, None]) & (ids[None, :] != qids[:, None]))
                found, digits = scores[q, r], np.full(len(q), "", object)
                for i in np.flatnonzero(np.abs(found) >= FAR).tolist():
                    exact = _exact(matrix[q[i]], block[r[i]])
                    found[i], digits[i] = max(-(1 << 63), min((1 << 63) - 1, exact)), _digits(exact)
                held = pd.concat([held, pd.DataFrame({"q": q, "vec_id": ids[r], "score": found, "digits": digits})])
                held = held.sort_values(names[:1] + ["score", "digits", "vec_id"], ascending=[True, False, False, True]).groupby("q").head(k)
        columns = [pa.array(qids[held["q"]]), pa.array(held["vec_id"].to_numpy()), pa.array(held["score"].to_numpy()), pa.array(held["digits"], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "digits"])

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("digits").desc(), "vec_id")
    found = rows.mapInArrow(common.task("none", keep), "query_id long, vec_id long, score long, digits string")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
