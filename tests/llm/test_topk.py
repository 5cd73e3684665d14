"""Operator 10 against brute force and DuckDB."""

import math
import random

import pytest

from weir.llm import topk
from weir.llm.queries import ORACLES, QUERIES

from .oracle import compare


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in ok if i is not None and i % 20 == 0}
    out = []
    for q, qv in queries:
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for i, v in ok if i != q)[:k]
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored, 1)]
    return sorted(map(str, out))


def result(df, **kw):
    return sorted(str(tuple(r)) for r in topk.search(df, "vec_id", "embedding", **kw).collect())


@pytest.mark.parametrize("blocks", [{}, {"query_rows": 5, "data_rows": 40}, {"query_rows": 2, "data_rows": 10}])
def test_search_matches_brute_force(spark, blocks):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(60)]  # a hot vector
    rows += [(500, None), (520, [1.0, float("nan")]), (540, [None, 1.0]), (560, [float("inf")]), (580, [0.5, 0.25]), (600, []), (None, rows[3][1]), (0, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    assert result(df, **blocks) == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert result(df) == ["(20, 1, 1, 8192)"]
    assert result(df.limit(0)) == [] and result(df.where("vec_id = 1")) == [] and result(df.where("vec_id = 20")) == []


def test_far_cells_are_not_sent(spark):
    """Well separated groups: the triangle inequality rules most data out."""
    rng = random.Random(5)
    rows = [(i, [1000.0 * (i % 5 == j) + rng.random() for j in range(5)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    planned = topk.plan(df, "vec_id", "embedding", query_rows=10)
    assert planned.share < 0.25 and sum(planned.sent.values()) < 0.25 * len(rows) * len(planned.queries)
    assert result(df, query_rows=10, data_rows=100) == brute(rows)


def test_clustered_vectors_are_mostly_ruled_out(spark):
    """Above one half with the constants of the query."""
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i * 7 % 30]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk.plan(df, "vec_id", "embedding").share < 0.5
    assert result(df) == brute(rows)


def test_queries_are_grouped_coarsely_where_nothing_is_ruled_out(spark):
    rng = random.Random(13)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    planned = topk.plan(df, "vec_id", "embedding")
    assert len(planned.queries) <= topk.MOST_SENT and sum(planned.sent.values()) <= topk.MOST_SENT * len(rows)
    assert result(df) == brute(rows)


def test_oracle(spark):
    assert compare(spark, QUERIES["op10_topk"], ORACLES["op10_topk"])


@pytest.mark.parametrize("step", [0, 1])
def test_copies_of_a_query_dont_tighten_its_bound(spark, step):
    """More rows of the query's id than k, in cells of their own: its candidates are all far away."""
    rng = random.Random(7)
    rows = [(20, [1000.0, step * i / 64]) for i in range(25)] + [(21 + 20 * (i // 19) + i % 19, [rng.random(), 1000.0]) for i in range(75)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df, query_rows=1, data_rows=10) == brute(rows)
