"""Connected components of a table of links, without gathering links on the driver.

Each round first runs union-find inside every partition, which leaves a forest of stars, then points each
node at the least node of its neighbourhood, and contracts the links to those. Rounds alternate between
the order of the ids, in which stars around small ids vanish at once, and a hashed order, in which long
chains lose a constant fraction of their nodes; so their number is logarithmic. The driver sees only
whether links are left. Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.llm.common import join_hot, map_arrow, materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition to (node, root) by union-find, the root the least id."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (above := up.setdefault(root, root)) != root:
            root = above
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(x, r) for x in up if (r := find(x)) != x]
    for i in range(0, len(pairs), 100_000):
        part = pairs[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, component): a row per linked node, with its component's least id."""
    edges = materialise(map_arrow(links, _forest, "a long, b long"), "forest")
    labels: DataFrame | None = None
    rounds = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if rounds % 2 == 0:
            least = F.least(F.min("a"), F.min("b"))
        else:
            by = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("h"), F.col(c).alias("id"))
            least = F.least(F.min(by("a")), F.min(by("b")))["id"]
        parents = materialise(both.groupBy(F.col("a").alias("node")).agg(least.alias("parent")), "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            step = parents.select(F.col("node").alias("label"), "parent")
            labels = materialise(join_hot(labels, step, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        pa_, pb = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        # Of a node as "a" a partition's forest has one link, but a root is "b" of many.
        moved = join_hot(edges, pb, "b").join(pa_, "a").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        edges = materialise(map_arrow(moved, _forest, "a long, b long"), "forest")
        rounds += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if rounds == 1:
        return labels.withColumnRenamed("label", "component")
    least = labels.groupBy("label").agg(F.least(F.min("node"), F.min("label")).alias("component"))
    return join_hot(labels, least, "label").select("node", "component")
