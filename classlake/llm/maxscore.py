"""Exact top-k inner products with MaxScore over integer vectors.

Dimensions are terms; a term's postings are the vectors with a non-zero component
there.  Each Arrow batch of vectors is a shard with postings by term, in blocks of
documents, and the best scores so far give a threshold.  For a query the terms are
ordered by their greatest contribution in the shard; those whose bounds together stay
below the threshold are non-essential.  Essential postings are traversed term by term
and add up scores of the vectors in them; the other terms are probed from the largest
bound down while a vector can still reach the threshold.  A shard returns its k best for each query; the shards are merged by
a window over the few rows of each query.

Queries go to the shards in blocks of ``per_block``; every block meets all vectors.

Defined results: vectors that are null or hold a null or non-finite component take
no part; shorter vectors have zeros behind; rows that share a vec_id are candidates and
queries of their own, also of each other; a row without a vec_id is a candidate and no
query; equal scores rank the smaller vec_id first, none last; fewer candidates than k are all returned; an
empty table gives no rows; other columns are ignored.  Scores are exact while sums
stay in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classlake.llm.shared import bounded_batches, tidied, written

TOP = 5
SCALE = 256
PER_BLOCK = 2048
BLOCK_ROWS = 2048
FIRST, PROBE = 4, 8  # terms read at once: at least, and between two tests of the threshold
PLANS = 16  # query blocks in one plan


NO_ID = 2**63 - 1  # stands for a missing vec_id inside a shard


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, x): integer vectors that take part, written once with a number for each row."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return written(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("v").isNotNull() & ~bad)
        .select(F.monotonically_increasing_id().alias("row"), "vec_id",
                F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("x")))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, with zeros behind short ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(width, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = column.flatten().to_numpy()
    return out


class Shard:
    """Postings of one batch of vectors, in blocks of documents."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, x = rows[order], ids[order], x[order]
        # doubles are exact for the sums of small components, and much faster
        self.largest = float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        self.x = np.asfortranarray(x)
        self.floats = self.x.astype(np.float64)
        self.high, self.low = (x.max(axis=0, initial=-(2**62)), x.min(axis=0, initial=2**62))
        self.postings = [[np.flatnonzero(self.x[at:at + BLOCK_ROWS, t]) for t in range(x.shape[1])]
                         for at in range(0, len(x), BLOCK_ROWS)]

    def top(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best vectors but the row ``own``, ties to smaller ids."""
        small = self.largest * float(np.abs(q).max(initial=0)) < 2**53
        x, q = (self.floats, q.astype(np.float64)) if small else (self.x, q)
        bound = np.maximum(q * self.high, q * self.low)  # the greatest contribution of each term here
        terms = np.flatnonzero(q)
        terms = terms[np.argsort(-bound[terms], kind="stable")]
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # what terms from the i-th on can add
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, x.dtype)
        for number, at in enumerate(range(0, len(x), BLOCK_ROWS)):
            part, ids, postings = x[at:at + BLOCK_ROWS], self.ids[at:at + BLOCK_ROWS], self.postings[number]
            threshold = best[k - 1] if len(best) >= k else None
            essential = len(terms)
            if threshold is not None and threshold > 0:
                # terms behind the essential ones cannot reach the threshold together
                reach = np.flatnonzero(np.maximum.accumulate(rest[::-1])[::-1] >= threshold)
                essential = min(len(terms), max(FIRST, int(reach[-1]) + 1 if len(reach) else 0))
            total, met = np.zeros(len(part), x.dtype), np.zeros(len(part), bool)
            for t in terms[:essential]:
                found = postings[t]
                if len(found) == len(part):
                    total += q[t] * part[:, t]
                    met[:] = True
                else:
                    total[found] += q[t] * part[found, t]
                    met[found] = True
            rows = np.flatnonzero(met) if threshold is not None and threshold > 0 else np.arange(len(part))
            score, done = total[rows], essential
            while done < len(terms) and len(rows):
                alive = score + rest[done] >= threshold
                rows, score = rows[alive], score[alive]
                step = min(len(terms), done + PROBE)
                score = score + part[np.ix_(rows, terms[done:step])] @ q[terms[done:step]]
                done = step
            if threshold is not None:
                alive = score >= threshold
                rows, score = rows[alive], score[alive]
            keep = self.rows[at:at + BLOCK_ROWS][rows] != own
            all_ids = np.concatenate([best_ids, ids[rows][keep]])
            all_scores = np.concatenate([best, score[keep]])
            order = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best = all_ids[order], all_scores[order]
        return list(zip(best_ids.tolist(), best.astype(np.int64).tolist(), strict=True))


def _block(vectors: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """The k best of each shard for one block of queries."""
    own, ids, q = queries["row"].to_numpy(), queries["vec_id"].to_numpy(), matrix(queries["x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), q.shape[1])
            shard = Shard(batch.column("row").to_numpy(), batch.column("vec_id").fill_null(NO_ID).to_numpy(), x)
            wide = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
            found = [(int(r), int(i), None if v == NO_ID else v, s)
                     for r, i, line in zip(own, ids, wide, strict=True) for v, s in shard.top(int(r), line, k)]
            cols = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["query", "query_id", "vec_id", "score"])

    return vectors.mapInArrow(tidied(run), "query long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, per_block: int = PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): ``vectors`` as :func:`scaled` makes them, ``queries`` some of their rows
    with a vec_id.  A row is not its own candidate."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    n = 1 + queries.count() // per_block
    tables, parts = [], []
    for b in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("row"), F.lit(n)) == b) if n > 1 else queries
        got = rows.toArrow()
        if got.num_rows:
            parts.append(_block(vectors, got, k))
        if parts and (len(parts) == PLANS or b == n - 1):
            found = parts[0]
            for p in parts[1:]:
                found = found.unionByName(p)
            tables.append(written(found) if n > PLANS else found)
            parts = []
    if not tables:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
