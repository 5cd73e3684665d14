"""Connected components of a link table: local union-find, then hooking and pointer jumping until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import written

#: Links that a task unites before it passes its forest on.
LINKS_AT_ONCE = 500_000


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task: each node that occurs, with the smallest node that it is linked to, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def forest() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        out = pa.RecordBatch.from_pydict({"a": pa.array([find(x) for x in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})
        parent.clear()
        return out

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            low, high = min(ra, rb), max(ra, rb)
            parent[high] = low
            parent.setdefault(low, low)
        if len(parent) > LINKS_AT_ONCE:
            yield forest()
    if parent:
        yield forest()


def components(links: DataFrame) -> DataFrame:
    """``node, comp``: every node of ``links`` (two columns of longs) with the smallest node that it can reach."""
    a, b = links.columns
    own = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = written(own.mapInArrow(_local_forests, "a bigint, b bigint").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        # the smallest label next to each label, for the label's root: hooking whole trees
        left = edges.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
        ends = left.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb")
        hooks = ends.select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hooks = written(hooks, "hooks")
        up = labels.where("node <> comp").select(F.col("node").alias("root"), F.col("comp").alias("over"))
        if hooks.isEmpty() and labels.join(up, F.col("comp") == F.col("root"), "left_semi").isEmpty():
            return labels
        hooked = labels.join(hooks, F.col("comp") == F.col("root"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
        hooked = written(hooked, "labels")
        over = hooked.where("node <> comp").select(F.col("node").alias("root"), F.col("comp").alias("over"))
        labels = written(hooked.join(over, F.col("comp") == F.col("root"), "left").select("node", F.coalesce("over", "comp").alias("comp")), "labels")
