"""Connected components of a table of edges, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, release


#: Edges (two keys each) that one task unites; more of them are united by rounds of joins.
ONE_TASK_EDGES = 50_000


def _unite(edges: DataFrame) -> DataFrame:
    """Union-find over a bounded table in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for frame in frames:
            for a, b in zip(frame["a"], frame["b"], strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        nodes = list(root)
        yield pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").repartition(1).mapInPandas(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b); root is the least node of the component.

    Each round a node takes the least root among its neighbours and then its root's root, so
    chains shorten by halves. Rounds go through the shared folder. A table of at most ``one_task``
    edges is united in one task instead.
    """
    if edges.limit(one_task + 1).count() <= one_task:
        return _unite(edges)
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))
    roots = materialise(roots, "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = materialise(roots.join(near, "node").select("node", "root", F.least("root", "near").alias("hooked")), "hooked")
        jump = hooked.select(F.col("node").alias("hooked"), F.col("hooked").alias("jump"))
        new = materialise(
            hooked.join(jump, "hooked", "left").select("node", F.coalesce("jump", "hooked").alias("root"), (F.coalesce("jump", "hooked") != F.col("root")).alias("moved")),
            "roots",
        )
        moved = new.where("moved").limit(1).count()
        release(roots)
        release(hooked)
        roots = new.drop("moved")
        if not moved:
            release(both)
            return roots
