"""Exact top-k by inner product: a Voronoi kNN join.

1. Pivots are fitted to a bounded sample; every vector belongs to the cell of its nearest pivot.
2. Each cell is summed up by its number of rows and its radius.
3. Each query is solved against the cells that promise most; its k-th score there is a lower bound.
4. No vector of a cell scores above q.p + |q| * radius, so a query goes on only to the cells where that
   reaches its bound. Queries, a small part of the rows, are what is replicated; vectors move once.
5. Cells are split into blocks of rows, each solved by one matrix product, and the best k are merged.

Wrong pivots cost time, never results. Scores are exact integers: products run in 64-bit floats while
no sum can reach 2**53 and in 64-bit integers beyond.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part;
shorter vectors count as padded by zeros; equal scores go by smaller vec_id; rows with a query's own id
are never its results; repeated rows are candidates as often as they stand, repeated queries are one
(the least vector); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the fit of pivots, rows in a block, and queries sent to one block at once.
SAMPLE, MOST_PIVOTS, BLOCK, QUERIES, SEED = 4096, 256, 4096, 4096, 5
#: Cells that each query is first solved against.
FIRST = 2


def integers(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds null, NaN or infinity."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    if len(flat):
        out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def fit_pivots(sample: np.ndarray, count: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """Pivots by a few rounds of k-means."""
    x = sample.astype(float)
    pivots = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:count])]
    for _ in range(rounds):
        own = _nearest(x, pivots)[0]
        n = np.bincount(own, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, x)
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = ((pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)).argmin(1)
    return own, np.sqrt(((x - pivots[own]) ** 2).sum(1))


def solve(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """The best k rows of one block for each query."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    scores = (queries.astype(float) @ rows.astype(float).T).astype(np.int64) if reach < 2**53 else queries @ rows.T
    out = []
    for q, own in zip(query_ids, scores):
        other = np.flatnonzero(ids != q)
        s = own[other]
        if len(s) > k:
            near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
            other, s = other[near], s[near]
        best = np.lexsort((ids[other], -s))[:k]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[other[best]], "score": s[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _solved(data: DataFrame, sent: DataFrame, width: int, k: int, parts: dict[int, int]) -> DataFrame:
    """Solves (query_id, cell, v) against the blocks of those cells."""
    table = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    spread = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(table, F.col("cell")) - 1)))
    # more queries than one call should hold: another copy of the block takes the next part of them
    loads = sent.groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERIES).cast("int").alias("loads"))
    spread = spread.join(loads, "cell").withColumn("load", F.pmod(F.xxhash64("query_id"), F.col("loads")).cast("int")).drop("loads")
    blocks = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(table, F.col("cell"))).cast("int"))
    blocks = blocks.join(loads, "cell").withColumn("load", F.explode(F.sequence(F.lit(0), F.col("loads") - 1))).drop("loads")
    key = ["cell", "block", "load"]

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        make = lambda c: np.frombuffer(b"".join(c), np.int64).reshape(len(c), width)
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return solve(queries["query_id"].to_numpy(), make(queries["v"]), rows["vec_id"].to_numpy(), make(rows["v"]), k)

    return blocks.select(*key, "vec_id", "v").groupBy(*key).cogroup(spread.select(*key, "query_id", "v").groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best k for each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k highest-scoring other rows for each row where is_query holds, exactly."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(vector), scale).alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = _matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, width)
    shared = spark.sparkContext.broadcast(fit_pivots(sample, max(1, min(MOST_PIVOTS, int(n**0.5) // 4))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width)
            own, far = _nearest(v.astype(float), shared.value)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "v": pa.array([r.tobytes() for r in v], pa.binary()), "q": batch.column(2), "cell": pa.array(own, pa.int32()), "far": pa.array(far, pa.float64())})

    placed = cut(rows.mapInArrow(assign, "vec_id long, v binary, q boolean, cell int, far double"))
    cells = {c: (m, far) for c, m, far in placed.groupBy("cell").agg(F.count("*"), F.max("far")).collect()}  # a row for each pivot
    parts = {c: -(-m // BLOCK) for c, (m, _) in cells.items()}
    order = np.array(sorted(cells))
    pivots, radius = shared.value[order], np.array([cells[c][1] for c in order])

    def bounds(v: np.ndarray) -> np.ndarray:
        """Highest score possible for each query in each cell, rounded up."""
        top = v.astype(float) @ pivots.T + np.sqrt((v.astype(float) ** 2).sum(1))[:, None] * radius
        return top + 1 + 1e-9 * np.abs(top)

    first = min(FIRST, len(order))

    def send_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, width)
            at = np.argsort(-bounds(v), axis=1, kind="stable")[:, :first]
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(v)), first))), "v": batch.column(1).take(pa.array(np.repeat(np.arange(len(v)), first))), "cell": pa.array(order[at].ravel(), pa.int32())})

    def send_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, width)
            top = bounds(v)
            done = np.argsort(-top, axis=1, kind="stable")[:, :first]
            least = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
            need = top >= least[:, None]
            np.put_along_axis(need, done, False, axis=1)
            who, at = np.nonzero(need)
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0).take(pa.array(who)), "v": batch.column(1).take(pa.array(who)), "cell": pa.array(order[at], pa.int32())})

    queries = placed.where("q").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    schema = "query_id long, v binary, cell int"
    data = placed.select("vec_id", "v", "cell")
    early = cut(best(_solved(data, queries.mapInArrow(send_first, schema), width, k, parts), k))
    least = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    late = _solved(data, queries.join(least, "query_id", "left").select("query_id", "v", "least").mapInArrow(send_rest, schema), width, k, parts)
    return best(early.select("query_id", "vec_id", "score").unionByName(late), k)
