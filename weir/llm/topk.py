"""Exact top-k search by inner product: a Voronoi kNN join (operator 10).

Vectors get one coordinate more, so that all data vectors have the same length; the greatest inner products then are
the smallest distances. Data and queries are grouped by their nearest pivots, about as many as the square root of their
number. From small summaries (of each query group the radius, of each data cell the k+1 smallest distances of
different ids to its pivot) follows, for each query group, a distance within which every query of it has k candidates;
a data vector is sent to a group only if the triangle inequality can't rule it out. Groups are solved locally, in
blocks of bounded queries and data, with exact integer scores.

Where vectors have no clusters the bounds rule little out, and many groups would be sent nearly all data each. What
every group needs is counted before anything is sent; if it's too much, queries are grouped more coarsely, at last in
blocks that memory holds. ``plan`` tells the share that is sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.llm.shared import written

#: Queries of a block and data rows of a block, about: both are in memory together.
QUERY_ROWS, DATA_ROWS = 2000, 20_000
MOST_PIVOTS = 1024
#: Times that the data may be sent in all, or as often as there are blocks of queries.
MOST_SENT = 4
SCALE = 64
_NO_ID = np.iinfo(np.int64).max  # stands for a null id, after all others


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` with integer components; rows whose vector is null or has a null or non-finite component are out."""
    v = F.col(vector_col)
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & finite)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double")).alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column, with zeros up to ``dims``."""
    out = np.zeros((len(column), dims))
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    cell = squares.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _pivots(rows: DataFrame, count: int, n: int, dims: int) -> np.ndarray:
    """``n`` different vectors, about, of ``count`` in the order of a hash of their components; one at least."""
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 40))
    one = rows.select("v", draw.alias("draw"))
    # equal vectors are drawn or left together, so that copies can't take all places
    found = one.where(F.col("draw") < min(1 << 40, 4 * n * (1 << 40) // count)).distinct().orderBy("draw", "v").limit(n).collect()
    found = found or one.orderBy("draw", "v").limit(1).collect()
    out = np.zeros((len(found), dims))
    for i, r in enumerate(found):
        out[i, : len(r.v)] = r.v
    return out


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))])


def _placed(rows: DataFrame, pivots, dims: int, longest: float | None) -> DataFrame:
    """``vec_id, v, cell, far``: the nearest pivot and its distance; data vectors are lifted to equal length first."""
    shipped = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            raw = [r.tobytes() for r in np.ascontiguousarray(x)]
            x = np.column_stack([x, np.zeros(len(x))]) if longest is None else _lifted(x, longest)
            cell, far = _nearest(x, shipped.value) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "v": pa.array(raw, pa.binary()), "cell": pa.array(cell, pa.int32()), "far": pa.array(far)})

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id bigint, v binary, cell int, far double")


def _smallest_of_ids(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` smallest numbers of different ids, ascending, and their ids."""
    order = np.argsort(far, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return far[order][first], ids[order][first]


def _smallest(placed: DataFrame, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each cell the ``k`` smallest distances of different ids to its pivot, and the ids; those without one are as one.

    Tasks keep their own ``k`` before anything moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cells, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))
            ids = np.asarray(batch.column("vec_id").fill_null(int(_NO_ID)))
            for c in np.unique(cells):
                known, own = best.get(int(c), (np.zeros(0), np.zeros(0, np.int64))), cells == c
                best[int(c)] = _smallest_of_ids(np.concatenate([known[0], far[own]]), np.concatenate([known[1], ids[own]]), k)
        rows = [(c, f, i) for c, own in best.items() for f, i in zip(*own, strict=True)]
        yield pa.RecordBatch.from_pydict({"cell": pa.array([r[0] for r in rows], pa.int32()), "far": pa.array([r[1] for r in rows], pa.float64()), "vec_id": pa.array([r[2] for r in rows], pa.int64())})

    kept = placed.select("cell", "far", "vec_id").mapInArrow(run, "cell int, far double, vec_id bigint").groupBy("cell", "vec_id").agg(F.min("far").alias("far"))
    ranked = kept.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id")))
    out: dict[int, list] = {}
    for r in ranked.where(F.col("r") <= k).collect():  # MOST_PIVOTS * k rows at most
        out.setdefault(r.cell, []).append((r.far, r.vec_id))
    return {c: (np.array([f for f, _ in own]), np.array([i for _, i in own], np.int64)) for c, own in out.items()}


def _counted(data: DataFrame, needed: np.ndarray) -> dict[int, int]:
    """Data rows that each group needs, from cells and distances alone."""
    shipped = data.sparkSession.sparkContext.broadcast(needed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = shipped.value
        sums = np.zeros(len(least), np.int64)
        for batch in batches:
            cell, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))
            for g in range(len(least)):
                sums[g] += np.count_nonzero(far >= least[g][cell])
        yield pa.RecordBatch.from_pydict({"g": pa.array(range(len(sums)), pa.int32()), "n": pa.array(sums)})

    return {r.g: r.n for r in data.select("cell", "far").mapInArrow(run, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()}


@dataclass(frozen=True)
class Plan:
    """Where data and queries go."""

    #: ``vec_id, v, cell, far`` of all data and all queries, a query's cell being its group
    data: DataFrame
    asked: DataFrame
    dims: int
    #: of each group and cell the distance from the cell's pivot from which a data vector may be needed
    needed: np.ndarray
    queries: dict[int, int]
    sent: dict[int, int]
    rows: int

    @property
    def share(self) -> float:
        """Of all pairs of a query and a data row, those that are compared."""
        return sum(m * self.sent[g] for g, m in self.queries.items()) / (self.rows * sum(self.queries.values()))


def plan(df: DataFrame, id_col: str, vector_col: str, *, k: int = 20, every: int = 20, query_rows: int = QUERY_ROWS) -> Plan | None:
    """Groups of the queries and what data they need; None without queries."""
    rows = written(valid_vectors(df, id_col, vector_col), "vectors")
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, n_queries, dims, longest = rows.agg(
        F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    ).first()
    if not n_queries:
        return None
    queries = rows.where(is_query).distinct()
    data_pivots = _lifted(_pivots(rows, n, min(MOST_PIVOTS, math.ceil(math.sqrt(n))), dims), longest)
    data = written(_placed(rows, data_pivots, dims, longest), "cells")
    nearest = _smallest(data, k + 1)  # one id of them may be the query's own
    coarse = min(MOST_PIVOTS, math.ceil(n_queries / query_rows))
    fine = min(MOST_PIVOTS, max(coarse, math.ceil(math.sqrt(n_queries))))
    for groups in sorted({fine, math.ceil(math.sqrt(fine * coarse)), coarse}, reverse=True):
        query_pivots = _pivots(queries, n_queries, groups, dims)
        query_pivots = np.column_stack([query_pivots, np.zeros(len(query_pivots))])
        asked = written(_placed(queries, query_pivots, dims, None), "groups")
        sizes = {r.cell: (r.far, r.n) for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
        between = np.sqrt(((query_pivots[:, None, :] - data_pivots[None, :, :]) ** 2).sum(2))
        slack = 1e-6 * (1 + float(between.max(initial=0.0)) + math.sqrt(longest))
        needed = np.full(between.shape, np.inf)
        for g, (radius, _) in sizes.items():
            # an id's rows may lie in several cells
            bounds, _ = _smallest_of_ids(
                np.concatenate([radius + between[g, c] + far for c, (far, _) in nearest.items()]), np.concatenate([ids for _, ids in nearest.values()]), k + 1
            )
            within = bounds[k] if len(bounds) > k else np.inf
            needed[g] = between[g] - radius - within - slack
        sent = _counted(data, needed)
        if groups == coarse or sum(sent.values()) <= n * max(MOST_SENT, coarse):
            return Plan(data, asked, dims, needed, {g: m for g, (_, m) in sizes.items()}, sent, n)


def search(df: DataFrame, id_col: str, vector_col: str, *, k: int = 20, every: int = 20, query_rows: int = QUERY_ROWS, data_rows: int = DATA_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row whose id is divisible by ``every`` the ``k`` best other rows.

    Rows are known by their ids: rows with the query's id aren't its candidates; equal query rows are answered once;
    repeated candidates count as often as they occur; candidates without an id come last among equal scores. Vectors
    that are null or hold null or non-finite components take no part; shorter ones end in zeros. Scores are exact
    while products of vectors stay below 2**53. No queries give no rows.
    """
    spark = df.sparkSession
    planned = plan(df, id_col, vector_col, k=k, every=every, query_rows=query_rows)
    if planned is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dims = planned.dims
    shipped = spark.sparkContext.broadcast((planned.needed, sorted(planned.queries)))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, own = shipped.value
        for batch in batches:
            cell, far = np.asarray(batch.column("cell")), np.asarray(batch.column("far"))
            for g in own:
                kept = far >= least[g][cell]
                if kept.any():
                    some = batch.select(["vec_id", "v"]).filter(pa.array(kept))
                    yield some.append_column("g", pa.array(np.full(some.num_rows, g, np.int32)))

    # MOST_PIVOTS rows at most, or as many as blocks of queries
    blocks = [(g, math.ceil(m / query_rows), max(1, math.ceil(planned.sent[g] / data_rows))) for g, m in planned.queries.items()]
    blocks = F.broadcast(spark.createDataFrame(blocks, "g int, blocks int, salts int"))
    drawn = lambda most: F.pmod(F.xxhash64("vec_id", "v"), F.col(most).cast("long")).cast("int")
    sent = planned.data.mapInArrow(replicate, "vec_id bigint, v binary, g int").join(blocks, "g").withColumn("salt", drawn("salts"))
    sent = sent.select("g", F.coalesce("vec_id", F.lit(int(_NO_ID))).alias("vec_id"), "v", "salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = planned.asked.select("vec_id", "v", F.col("cell").alias("g")).join(blocks, "g").withColumn("block", drawn("blocks"))
    asked = asked.select(*[F.col(c).alias(c) for c in ("g", "vec_id", "v", "block")], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids = right["vec_id"].to_numpy("int64")
        x = np.frombuffer(b"".join(right["v"]), np.float64).reshape(len(right), dims)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        for start in range(0, len(left), 256):
            part = left.iloc[start : start + 256]
            q = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), dims)
            scores = q @ x.T
            for i, (query, raw) in enumerate(zip(part["vec_id"], part["v"], strict=True)):
                keep = np.flatnonzero(ids != query)
                own = scores[i, keep]
                if len(own) > k:
                    least = np.partition(own, len(own) - k)[len(own) - k]
                    # ids ascend, so of equal scores the first are the smallest ids
                    above, equal = np.flatnonzero(own > least), np.flatnonzero(own == least)
                    pick = np.concatenate([above, equal[: k - len(above)]])
                    keep, own = keep[pick], own[pick]
                out += [(query, raw, int(v), int(s)) for v, s in zip(ids[keep], own, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"])

    keys = ["g", "block", "salt"]
    local = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "query_id bigint, q binary, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(int(_NO_ID))).alias("vec_id"), "score")


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64.0 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i]))::BIGINT AS score
  FROM v q, v d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
