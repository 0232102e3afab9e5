"""Connected components of a link table. Nothing reaches the driver but a count.

Up to TASK_LINKS links, a counted bound, are united in one task. More of them go by rounds of least labels and pointer
jumping over the whole cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm._util import drop_path, tidied, written

#: Links that one task unites: some 100 MB of arrays.
TASK_LINKS = 1_000_000


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node reachable) of links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        now = root.copy()
        np.minimum.at(now, root[x], low)
        np.minimum.at(now, root[y], low)
        while True:
            up = now[now]
            if (up == now).all():
                break
            now = up
        if (now == root).all():
            return nodes, nodes[root]
        root = now


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if rows:
        nodes, roots = united(*(np.concatenate(z) for z in zip(*rows, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", in_task: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node of links that has another neighbour; root is the least node reachable. Links are whole
    numbers, may repeat and may be loops. An empty table gives an empty table.

    In each distributed round a node takes the least root among its neighbours, then its root's root, twice; tables are
    written each round, so a lost executor costs one round at most."""
    one = written(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b"), "links")
    if one.count() <= in_task:
        return written(one.coalesce(1).mapInArrow(tidied(_in_task), "node long, root long"), "labels")
    two = one.select(F.col("a").alias("u"), F.col("b").alias("v")).union(one.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = written(two.distinct(), "links")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        step = labels.join(near, "u").select("u", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        up = labels.select(F.col("u").alias("root"), F.col("root").alias("r"))
        for _ in range(2):
            step = step.join(up, "root").select("u", "old", F.least("root", "r").alias("root"))
        now = written(step, "labels")
        drop_path(labels.sparkSession, labels.written_path)
        labels = now
        if labels.where("root != old").isEmpty():
            return labels.select(F.col("u").alias("node"), "root")
