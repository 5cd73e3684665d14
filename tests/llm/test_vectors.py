"""Operator 5 against brute force; the graph, the search and the audit."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from weir.llm import vectors
from weir.llm.queries import ORACLES, QUERIES
from weir.llm.shared import table, written

from .oracle import compare


def brute(rows):
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v, label) in enumerate(rows) if usable(v, label)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ok):
        for j in ok[:k]:
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a == b and len(v) == len(w) and float(vectors.unit(np.array([v]))[0] @ vectors.unit(np.array([w]))[0]) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (vec, *_) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(least.get(find(i), vec), vec)
    out = []
    for i, (vec, *_) in enumerate(rows):
        comp = least.get(find(i))
        out.append((vec, links[i], comp, vec == comp if vec is not None else comp is None))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in vectors.group(df, "vec_id", "embedding", "label").collect())


def sample(n=400, dims=8, noise=0.12, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(30)]
    return [(i, [x + rng.gauss(0, noise) for x in rng.choice(centres)], i % 3) for i in range(n)]


def test_groups_match_brute_force(spark, monkeypatch):
    rows = sample() + [(900 + i, sample()[4][1], 1) for i in range(50)]  # many copies
    rows += [(801, None, 1), (802, [0.0] * 8, 1), (803, [float("nan")] * 8, 1), (804, [None] * 8, 1), (805, [], 1), (806, [1.0, 2.0], None), (807, [1.0, 2.0], 1)]
    rows += [(808, [2.0, 4.0], 1), (809, [1e300, 2e300], 1), (810, [1e-300, 2e-300], 1), (811, [-0.0, 1.0], 2), (812, [0.0, 1.0], 2), (None, sample()[4][1], 1), (4, sample()[4][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)
    want = brute(rows)
    assert result(df) == want
    monkeypatch.setattr(vectors, "SHARD_ROWS", 40)  # many clusters and split ones
    monkeypatch.setattr(vectors, "MOST_CENTROIDS", 3)
    assert result(df) == want
    assert result(df.limit(0)) == []


def test_query_matches_brute_force_on_a_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    assert result(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_search_reaches_every_near_vector():
    x = vectors.unit(np.array([v for _, v, _ in sample(700, 16, 0.2)]))
    links = vectors.build_graph(x)
    true = x @ x.T >= 0.9
    found = sum(len(set(np.flatnonzero(true[i])) & set(own)) for i, own in vectors.range_search(x, links, x, 0.9))
    assert found >= 0.999 * true.sum() and np.mean([len(s) for s in links]) < 60


def in_classes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return written(vectors.classes(df, "vec_id", "embedding", "label").withColumn("size", F.lit(1).cast("long")).select("node", "label", "v", "size"), "t")


def links_of(found):
    return found.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]


def test_audit_counts_missed_links(spark):
    nodes = in_classes(spark, sample())
    found = vectors.find(nodes)
    true, seen = vectors.audit(nodes, found, sample=400)
    assert true == seen == links_of(found)
    assert vectors.audit(nodes, found.limit(0), sample=400) == (true, 0)


def test_pairs_in_farther_clusters_are_found_once(spark, monkeypatch):
    """Two near vectors with homes of their own that share their second cluster, and two that share all clusters."""
    def at(degrees, tilt=0.0):
        a, t = math.radians(degrees), math.radians(tilt)
        return [math.cos(a) * math.cos(t), math.sin(a) * math.cos(t), math.sin(t)]

    nodes = in_classes(spark, [(1, at(0), 1), (2, at(15), 1), (3, at(120), 1), (4, at(121), 1)])
    centroids = np.array([at(-10), at(25), at(7.5, 12), at(119)])

    def assigned(sized, overlap):
        rows = [(*r, np.argsort(-(centroids @ np.array(r.v)))[:overlap].tolist()) for r in sized.select("node", "v", "size", "label", "dims").collect()]
        return spark.createDataFrame(rows, "node long, v array<double>, size long, label int, dims int, clusters array<int>")

    monkeypatch.setattr(vectors, "_assigned", assigned)
    assert links_of(vectors.find(nodes, overlap=2)) == 4 and links_of(vectors.find(nodes, overlap=4)) == 4


def test_lost_links_lead_to_an_exact_comparison(spark, monkeypatch):
    rows = sample() + [(1000 + i, v, 7) for i, v, _ in sample(150, 16, 0.2)]
    monkeypatch.setattr(vectors, "find", lambda nodes, *_: spark.createDataFrame([], vectors._FOUND))
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == brute(rows)


def test_audit_draws_until_a_large_label_shows_links(spark, monkeypatch):
    """One label has links everywhere, one has only three in 600 vectors, which a sample of 20 misses."""
    rng = random.Random(9)
    rows = sample(300) + [(1000 + i, [rng.gauss(0, 1) for _ in range(64)], 8) for i in range(600)]
    rows += [(2000 + i, [x + 0.01 for x in rows[400 + i][1]], 8) for i in range(3)]
    monkeypatch.setattr(vectors, "SHARD_ROWS", 250)
    assert links_of(vectors.truth(in_classes(spark, rows), sample=20).where("label = 8")) == 6


def test_recall_over_many_clusters_without_the_fallback(spark):
    """12,000 vectors of one label, some of them near others: many clusters, some split, with the query's constants."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24))
    x = np.concatenate([x, x[:3000] + rng.normal(0, 0.15, (3000, 24)), np.repeat(x[:1], 1500, 0) + rng.normal(0, 0.1, (1500, 24)), rng.normal(size=(3500, 24))])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    nodes = in_classes(spark, rows)
    u = vectors.unit(x)
    true = sum(int((u[i : i + 1000] @ u.T >= 0.93).sum()) for i in range(0, len(u), 1000)) - len(u)
    found = vectors.find(nodes)
    assert true > 1_000_000 and links_of(found) >= 0.99 * true
    # nothing but counts and forests: rows don't grow with the links
    assert found.count() < 40 * len(rows)


def test_oracle(spark):
    assert compare(spark, QUERIES["op5_vectors"], ORACLES["op5_vectors"])
