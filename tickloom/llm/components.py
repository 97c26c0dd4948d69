"""Connected components of a table of links, by union-find in blocks and pointer jumps between them."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .store import written

BLOCK = 1_000_000  # links in a task


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node connected to it) for the nodes of links a - b."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    up = np.arange(len(node))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        for side in (x, y):
            np.minimum.at(new, up[side], low)
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            return node, node[up]
        up = new


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node connected to it, for the nodes of links (a, b), both whole numbers.

    The result lists each node that has a smaller one in its component, once; others are their own component. Each round
    unites the links of a block (all that share their larger node, so a hub doesn't gather its leaves) and then lets every
    node point to what its root points to; it ends when all nodes point to roots.
    """
    spark = links.sparkSession
    link = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).where("node <> up")

    def unite(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            p = pd.concat(parts)
            node, root = roots(p["node"].to_numpy(np.int64), p["up"].to_numpy(np.int64))
            lower = root < node
            yield pd.DataFrame({"node": node[lower], "up": root[lower]})

    n = None
    while True:
        link = written(link.distinct(), "links") if n is None else link
        n = link.count() if n is None else n
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCK))
        # All links of a larger node are in one block, so its roots meet there.
        one = written(link.repartition(blocks, "node").mapInPandas(unite, "node long, up long").distinct(), "forest")
        above = one.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        jumped = one.join(above, one["up"] == above["mid"], "left")
        link = written(jumped.select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")).distinct(), "jumped")
        s = link.agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"), F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)).alias("moved")).first()
        n, link = s["n"], link.select("node", "up")
        if s["n"] == s["nodes"] and not s["moved"]:
            return link.select("node", F.col("up").alias("component"))
