"""Connected components: spanning forests of bounded blocks of links, then minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Links that one task joins by itself.
BLOCK_LINKS = 500_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a block: each vertex with the smallest of its tree."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    keys = list(root)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(k) for k in part], pa.int64())], names=["key", "comp"])


def components(links: DataFrame, block: int = BLOCK_LINKS) -> DataFrame:
    """(key, comp) for every end of the links (a, b); comp is the smallest key that can be reached.

    Each block of links is reduced to a forest first. Several blocks are then joined in rounds, each of which takes the
    smallest label among a vertex and its neighbours, then the label of that label. Labels are gathered by partial
    aggregation, so that a vertex with very many links is no single task's work.
    """
    blocks = -(-links.count() // block)
    trees = materialize(links.select("a", "b").coalesce(max(blocks, 1)).mapInArrow(forest, "key long, comp long"), "cc-forest")
    if blocks <= 1:
        return trees
    edges = materialize(trees.union(trees.select("comp", "key")).toDF("key", "other").distinct(), "cc-edges")
    labels = materialize(edges.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("comp")), "cc-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("comp").alias("near"))
        low = labels.join(near, "key").select("key", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        far = labels.select(F.col("key").alias("low"), F.col("comp").alias("far"))
        new = materialize(low.join(far, "low").select("key", F.least("low", "far").alias("comp"), (F.least("low", "far") != F.col("old")).alias("moved")), "cc-labels")
        labels = new.select("key", "comp")
        if not new.where("moved").take(1):
            return labels
