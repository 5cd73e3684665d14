"""Near-duplicate vectors by robust-pruned flat graphs (operator 5).

Vectors of one label go to overlapping clusters (their nearest centroids), whose members make shards of bounded size.
Each shard builds a flat graph: of each vector's nearest neighbours, robust pruning keeps those that no kept one is
much closer to. Adjacency lists of a vector in several shards are united. Every vector is then searched for, from the
medoid of each of its clusters' shards, by greedy search with a beam, which expands its range while it finds vectors
within the threshold. Links are verified in double precision.

A link is counted where it is found, in the first of the clusters that its two vectors share, and united where it is
found: a task gives its members' counts and a forest of them, never its pairs, whose number grows with the square of
a group of near copies. An audit compares a sample of queries with all rows of their label; of each label larger than
a shard it draws until it has seen ``LEAST_LINKS`` links or asked all. Labels with too many links missed are searched
again with more overlap and a wider beam, and at last compared exactly, in blocks.

Equal vectors of a label are one class from the start, so copies are never expanded into pairs. A cluster with more
members than a shard holds is split into blocks, and each two blocks are searched for each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.components import components
from weir.llm.shared import small_or_not, union_all, written

COSINE = 0.93
#: Vectors of a shard, about.
SHARD_ROWS = 256
#: Centroids of a label at most.
MOST_CENTROIDS = 256
OVERLAP = 3
#: Centroids of a label have cosines below this.
APART = 0.7
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
BEAM = 16
#: Queries of the audit, about, in each large label and in all others; and the share of their links that must be found.
AUDITED, RECALL = 64, 0.99
#: Links that the audit must see in each large label; it draws on, to the last vector, until it has.
LEAST_LINKS = 200
#: Vectors of a block that is compared exactly, and of one that is assigned to clusters.
BLOCK_ROWS = 2048
_DRAWS = 1 << 40


def classes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows as ``vec_id, label, v, node``: node is null for rows that can't be linked."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    # zero may have a sign: equal vectors must hash alike
    return rows.withColumn("node", F.when(usable, F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0.0)))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build_graph(x: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Adjacency lists of unit vectors by robust pruning, with reverse links, reachable from the medoid."""
    n = len(x)
    near = x @ x.T
    far = np.sqrt(np.maximum(0.0, 2 - 2 * near))
    np.fill_diagonal(near, -np.inf)
    m = min(CANDIDATES, n - 1)
    if m < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    candidates = np.argsort(-near, axis=1, kind="stable")[:, :m]
    distance = np.take_along_axis(far, candidates, 1)
    alive, rows = np.ones((n, m), bool), np.arange(n)
    links: list[set[int]] = [set() for _ in range(n)]
    for _ in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        chosen = candidates[rows, pick]
        for i in np.flatnonzero(some):
            links[i].add(int(chosen[i]))
            if len(links[chosen[i]]) < 2 * degree:  # else hubs would make every step as wide as they are
                links[chosen[i]].add(int(i))
        alive[rows, pick] = False
        alive &= ~(ALPHA * far[chosen[:, None], candidates] <= distance) | ~some[:, None]
    while True:
        seen, todo = np.zeros(n, bool), [medoid(x)]
        seen[todo] = True
        while todo:
            new = [j for j in links[todo.pop()] if not seen[j]]
            seen[new] = True
            todo += new
        if seen.all():
            break
        a, b = np.flatnonzero(seen), np.flatnonzero(~seen)
        between = near[np.ix_(a, b)]
        i, j = divmod(int(between.argmax()), len(b))
        links[a[i]].add(int(b[j]))
        links[b[j]].add(int(a[i]))
    return [np.array(sorted(s), np.int64) for s in links]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def range_search(x: np.ndarray, links: list[np.ndarray], queries: np.ndarray, least: float, beam: int = BEAM) -> Iterator[tuple[int, np.ndarray]]:
    """Of each query the members found with a cosine of about ``least`` or more. All queries take their steps together.

    A query expands the best member of its beam that it hasn't expanded; beyond the beam, members within the range
    are expanded too, until the range holds no more that are new.
    """
    n, q = len(x), len(queries)
    width = max((len(s) for s in links), default=0)
    table = np.full((n, max(1, width)), -1)
    for i, own in enumerate(links):
        table[i, : len(own)] = own
    cosine = np.full((q, n), -np.inf, np.float32)
    open_ = np.full((q, n), -np.inf, np.float32)  # met, but not yet expanded
    start = medoid(x)
    cosine[:, start] = open_[:, start] = queries @ x[start]
    best = np.full((q, beam), -np.inf, np.float32)
    best[:, 0] = cosine[:, start]
    going = np.arange(q)
    margin = least - 0.02
    while len(going):
        node = open_[going].argmax(1)
        value = open_[going, node]
        # the beam's last place is -inf until the beam is full
        more = (value > -np.inf) & ((value >= best[going].min(1)) | (value >= margin))
        going, node = going[more], node[more]
        if not len(going):
            break
        open_[going, node] = -np.inf
        near = table[node]
        fresh = (near >= 0) & (cosine[going[:, None], near] == -np.inf)
        row, col = np.nonzero(fresh)
        member = near[row, col]
        value = np.einsum("ij,ij->i", queries[going[row]], x[member]).astype(np.float32)
        cosine[going[row], member] = open_[going[row], member] = value
        found = np.full(near.shape, -np.inf, np.float32)
        found[row, col] = value
        both = np.concatenate([best[going], found], axis=1)
        best[going] = -np.partition(-both, beam - 1, axis=1)[:, :beam]
    for i in range(q):
        yield i, np.flatnonzero(cosine[i] >= least - 1e-5)


KEY = ("label", "dims")
SHARD = (*KEY, "cluster", "block")
_FOUND = "node bigint, links bigint, n bigint, root bigint"


def _label(nodes: DataFrame) -> str:
    return f"label {dict(nodes.dtypes)['label']}, dims int"


def _sized(nodes: DataFrame) -> DataFrame:
    """``node, v, label, size, dims`` with ``total``, the vectors of the label and dimension; as it is, if it has them."""
    if "total" in nodes.columns:
        return nodes
    rows = nodes.select("node", "v", "label", "size", F.size("v").alias("dims"))
    sizes = written(rows.groupBy(*KEY).agg(F.count("*").alias("total")), "sizes")
    return rows.join(small_or_not(sizes), [*KEY])


def _hashed(seed: int, blocks) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "node"), blocks)


def _assigned(sized: DataFrame, overlap: int) -> DataFrame:
    """``node, v, label, size, dims, clusters``: each vector with its nearest clusters.

    Centroids of a label larger than a shard are some of its vectors, in the order of their hashes, none near another:
    a large group of near copies so has one centroid and stays together. A smaller label is one cluster.
    """
    large = sized.where(F.col("total") > SHARD_ROWS)
    wanted = F.least(F.lit(MOST_CENTROIDS), F.ceil(OVERLAP * F.col("total") / SHARD_ROWS))
    drawn = large.withColumn("draw", _hashed(3, F.lit(_DRAWS))).where(F.col("draw") < 4 * wanted * _DRAWS / F.col("total"))

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "node"])
        x = unit(np.array(part["v"].tolist()))
        most, own = min(MOST_CENTROIDS, -(-OVERLAP * int(part["total"].iloc[0]) // SHARD_ROWS)), []
        for i in range(len(x)):
            if len(own) < most and (not own or (x[own] @ x[i]).max() < APART):
                own.append(i)
        return pd.DataFrame({"label": [key[0]] * len(own), "dims": key[1], "cluster": range(len(own)), "v": list(x[own])})

    found = drawn.select(*KEY, "node", "v", "draw", "total").groupBy(*KEY).applyInPandas(choose, f"{_label(sized)}, cluster int, v array<double>")
    parts = F.ceil(F.col("total") / BLOCK_ROWS)
    centroids = written(found, "centroids").join(small_or_not(written(large.select(*KEY, parts.alias("parts")).distinct(), "parts")), [*KEY])
    centroids = centroids.select(*[F.col(c).alias(c) for c in (*KEY, "cluster", "v")], F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.drop(columns="part")
        if len(right) and len(left):
            near = np.argsort(-(unit(np.array(left["v"].tolist())) @ np.array(right["v"].tolist()).T), axis=1, kind="stable")
            out["clusters"] = list(right["cluster"].to_numpy()[near[:, :overlap]])
        else:
            out["clusters"] = [[0]] * len(left)
        return out

    fields = f"node bigint, v array<double>, size bigint, {_label(sized)}"
    split = large.select("node", "v", "size", *KEY, _hashed(7, parts).alias("part"))
    near = split.groupBy(*KEY, "part").cogroup(centroids.groupBy(*KEY, "part")).applyInPandas(assign, f"{fields}, clusters array<int>")
    alone = sized.where(F.col("total") <= SHARD_ROWS).select("node", "v", "size", *KEY, F.array(F.lit(0)).alias("clusters"))
    return near.unionByName(alone)


def _owned(a: np.ndarray, b: np.ndarray, cluster: int) -> np.ndarray:
    """Whether ``cluster`` is the first one that two lists of clusters, row by row, share."""
    out = np.empty(len(a), bool)
    for start in range(0, len(a), 8192):
        x, y = a[start : start + 8192], b[start : start + 8192]
        shared = (x[:, :, None] == y[:, None, :]).any(2)
        out[start : start + 8192] = np.where(shared, x, np.iinfo(np.int32).max).min(1) == cluster
    return out


def _roots(hit: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric matrix of links the first row that it is connected with."""
    n = len(hit)
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(hit, root[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def find(nodes: DataFrame, overlap: int = OVERLAP, beam: int = BEAM, least: float = COSINE) -> DataFrame:
    """``node, links, n, root`` of classes ``node, label, v, size``, by shard: links found there and counted there, as
    classes and as vectors, and a node that they connect with."""
    assigned = written(_assigned(_sized(nodes), overlap), "assigned")
    spread = assigned.withColumn("cluster", F.explode("clusters"))
    counts = spread.groupBy(*KEY, "cluster").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("blocks"))
    members = spread.join(small_or_not(written(counts, "blocks")), [*KEY, "cluster"])
    members = written(members.withColumn("block", _hashed(5, F.col("blocks"))), "shards")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        x, ids = unit(np.array(part["v"].tolist())), part["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[own] for own in build_graph(x)]})

    built = members.select(*SHARD, "node", "v").groupBy(*SHARD).applyInPandas(build, "node bigint, near array<bigint>")
    # a vector's lists from all its shards as one
    united = written(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    meeting = members.join(united, "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meeting = meeting.select(*SHARD, "node", "v", "size", "clusters", "near", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["node"].to_numpy(), unit(np.array(part["v"].tolist()))
        hit = np.zeros((len(ids), len(ids)), bool)
        blocks = part["block"].to_numpy()
        for own in dict.fromkeys(key[3:]):
            # two near vectors may share none but their farther clusters, so each is searched for wherever it is a member
            inside, asked = np.flatnonzero(blocks == own), np.flatnonzero(blocks != own) if key[3] != key[4] else np.arange(len(ids))
            if len(inside) and len(asked):
                place = {node: i for i, node in enumerate(ids[inside])}
                links = [np.array([place[j] for j in near if j in place], np.int64) for near in part["near"].iloc[inside]]
                for i, found in range_search(x[inside], links, x[asked], least, beam):
                    hit[asked[i], inside[found]] = True
        hit |= hit.T
        np.fill_diagonal(hit, False)
        i, j = np.nonzero(hit)
        near = np.einsum("ij,ij->i", x[i], x[j]) >= least
        hit[i[~near], j[~near]] = False
        i, j = i[near], j[near]
        clusters = np.array(part["clusters"].tolist(), np.int64)
        counted = _owned(clusters[i], clusters[j], key[2])
        n = np.bincount(i[counted], weights=part["size"].to_numpy()[j[counted]], minlength=len(ids)).astype(np.int64)
        return pd.DataFrame({"node": ids, "links": np.bincount(i[counted], minlength=len(ids)), "n": n, "root": ids[_roots(hit)]})

    found = meeting.groupBy(*KEY, "cluster", "low", "high").applyInPandas(search, _FOUND)
    return written(found.where("links > 0 OR node <> root"), "found")


def compared(asked: DataFrame, nodes: DataFrame, least: float = COSINE) -> DataFrame:
    """As ``find`` gives, the links of the classes ``asked`` with all of their label, block by block.

    Classes that weren't asked for themselves occur where they are connected, without counts.
    """
    nodes = _sized(nodes)
    asked = written(asked.select("node", "v", "label", "size", F.size("v").alias("dims")), "asked")
    totals = nodes.select(*KEY, "total").distinct()
    wanted = asked.groupBy(*KEY).agg(F.count("*").alias("asked")).join(totals, [*KEY])
    wanted = wanted.select(*KEY, F.ceil(F.col("total") / BLOCK_ROWS).alias("block"), F.ceil(F.col("asked") / BLOCK_ROWS).alias("asking"))
    wanted = small_or_not(written(wanted, "wanted"))
    keys = [*KEY, "block", "asking"]

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        joined = df.select("node", "v", "label", "size", F.size("v").alias("dims")).join(wanted, [*KEY])
        # the same columns on both sides would be ambiguous
        return joined.select(*[F.col(c).alias(c) for c in ("node", "v", "size", *KEY)], _hashed(5, F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "n": [], "root": []}, dtype="int64")
        ids, x, size = right["node"].to_numpy(), unit(np.array(right["v"].tolist())), right["size"].to_numpy()
        queries, q = left["node"].to_numpy(), unit(np.array(left["v"].tolist()))
        links, n, parts = [], [], []
        root = np.arange(len(ids))
        for start in range(0, len(q), 512):
            hit = q[start : start + 512] @ x.T >= least
            links.append((hit & (ids[None, :] != queries[start : start + 512, None])).sum(1))
            n.append(np.where(ids[None, :] != queries[start : start + 512, None], hit * size[None, :], 0).sum(1))
            # the first of each query's neighbours stands for it; neighbours are connected with that one
            first = np.where(hit.any(1), hit.argmax(1), -1)
            parts.append(first)
            root = _joined(root, hit)
        first = np.concatenate(parts)
        asks = pd.DataFrame({"node": queries, "links": np.concatenate(links), "n": np.concatenate(n), "root": np.where(first >= 0, ids[first], queries)})
        return pd.concat([asks, pd.DataFrame({"node": ids, "links": 0, "n": 0, "root": ids[root]})])

    both = placed(asked, "asking", "block").groupBy(*keys).cogroup(placed(nodes, "block", "asking").groupBy(*keys)).applyInPandas(run, _FOUND)
    return both.where("links > 0 OR node <> root")


def _joined(root: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """``root``, a forest of the columns, with each row's columns of ``hit`` connected."""
    for row in hit:
        own = np.unique(root[row])
        if len(own) > 1:
            root = np.where(np.isin(root, own), own[0], root)
    return root


def _share(asked: int) -> Column:
    """How much of a label is asked, as a bound of draws."""
    return F.when(4 * asked >= F.col("total"), F.lit(_DRAWS)).otherwise(F.ceil(F.lit(asked).cast("double") * _DRAWS / F.col("total")))


def truth(nodes: DataFrame, least: float = COSINE, sample: int = AUDITED) -> DataFrame:
    """``label, dims, node, links``: of sampled classes the links, by brute force against all of their label.

    ``sample`` classes, about, are asked in each large label and in all others together; in large labels that show
    fewer than ``LEAST_LINKS`` links, ever more, until they do or all are asked.
    """
    nodes = _sized(nodes)
    sized = nodes.withColumn("draw", _hashed(11, F.lit(_DRAWS)))
    small, large = sized.where(F.col("total") <= SHARD_ROWS), sized.where(F.col("total") > SHARD_ROWS)
    rest = max(1, small.count())
    chosen, parts, asked = small.where(F.col("draw") < -(-sample * _DRAWS // rest)).unionByName(large.where(F.col("draw") < _share(sample))), [], sample
    short = written(large.select(*KEY, "total").distinct(), "short")
    while True:
        own = compared(chosen.select("node", "v", "label", "size"), nodes, least).where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
        parts.append(written(own.join(chosen.select("node", *KEY), "node").select(*KEY, "node", "links"), "audit"))
        seen = union_all(parts).groupBy(*KEY).agg(F.sum("links").alias("seen"))
        short = short.join(seen, [*KEY], "left").where((F.coalesce("seen", F.lit(0)) < LEAST_LINKS) & (_share(asked) < _DRAWS)).select(*KEY, "total")
        short = written(short, "short")
        if short.isEmpty():
            return union_all(parts)
        drawn = large.join(small_or_not(short.select(*KEY)), [*KEY], "left_semi")
        chosen = drawn.where((F.col("draw") >= _share(asked)) & (F.col("draw") < _share(8 * asked)))
        asked *= 8


def _judged(true: DataFrame, found: DataFrame) -> DataFrame:
    own = found.groupBy("node").agg(F.sum("links").alias("found"))
    judged = true.join(own, "node", "left").groupBy(*KEY).agg(F.sum("links").alias("links"), F.sum(F.least("links", F.coalesce("found", F.lit(0)))).alias("found"))
    return judged


def audit(nodes: DataFrame, found: DataFrame, least: float = COSINE, sample: int = AUDITED) -> tuple[int, int]:
    """The links of ``truth``, and how many of them were found."""
    sums = _judged(truth(nodes, least, sample), found).agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
    return tuple(sums)


def linked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, n`` (vectors linked) and ``node, root`` of classes, searched for until the audit finds enough links in every label."""
    overlap, beam, nodes = OVERLAP, BEAM, _sized(nodes)
    found, true = find(nodes, overlap, beam), truth(nodes)
    while not (failing := written(_judged(true, found).where(F.col("found") < RECALL * F.col("links")).select(*KEY), "failing")).isEmpty():
        part = nodes.join(small_or_not(failing), [*KEY], "left_semi")
        if overlap >= 4 * OVERLAP:
            more = written(compared(part, nodes), "found")
        else:
            overlap, beam = 2 * overlap, 2 * beam
            more = find(part, overlap, beam)
        # the new counts stand for the old ones of those labels
        found = written(found.join(part.select("node"), "node", "left_anti").unionByName(more), "found")
    return found.groupBy("node").agg(F.sum("n").alias("n")), found.where("node <> root").select("node", "root")


def group(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Vectors of equal, known labels and equal dimensions are compared. A null vector or label, a zero or empty vector,
    and one with null or non-finite components link with nothing. Repeated rows link with each other. A null id never
    is a component's smallest; a row without an id is kept only if its component has none.
    """
    rows = written(classes(df, id_col, vector_col, label_col), "rows")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("size"))
    nodes = written(nodes, "classes")
    others, edges = linked(nodes)
    counted = nodes.select("node", "size").join(others, "node", "left").join(components(edges), "node", "left")
    counted = counted.select("node", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("comp")).where("n_links > 0")
    full = rows.select("vec_id", "node").join(small_or_not(written(counted, "linked")), "node", "left")
    full = written(full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "comp"), "linked")
    least = full.where("comp IS NOT NULL").groupBy("comp").agg(F.min("vec_id").alias("least"))
    joined = full.join(small_or_not(written(least, "least")), "comp", "left")
    component = F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return joined.select("vec_id", "n_links", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def oracle() -> str:
    """DuckDB SQL of ``group`` over vectors with different ids."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT x AS vec_id, y AS other FROM links UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x),
least_of AS (SELECT vec_id, min(other) AS least FROM reach GROUP BY vec_id), counted AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(least, vec_id), vec_id) AS component_id, vec_id = coalesce(least(least, vec_id), vec_id) AS kept
FROM embeddings LEFT JOIN least_of USING (vec_id) LEFT JOIN counted USING (vec_id)"""
