"""Connected components of a link table: tasks contract their share of the links, minimum labels join the rest.

A task reads its links in chunks of at most ``chunk`` and gives each chunk's spanning forest. Where all links fit
one chunk, that is the answer. Beyond, rounds of large and small stars spread minimum labels over the forests; their
number goes as the logarithm of the longest chain. Every round is a written table, so a lost executor costs one
round at most; nothing is collected. Labels are the smallest id of the component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialise, release

#: Links that a task contracts at once (16 MiB).
CHUNK = 1 << 20


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of some links, and the smallest id that each reaches."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(u):
        x, y = up[u], up[v]
        u, v = np.minimum(x, y), np.maximum(x, y)
        u, v = u[u != v], v[u != v]
        np.minimum.at(up, v, u)
        while not np.array_equal(up, further := up[up]):
            up = further
    return nodes, nodes[up]


def _forest(chunk: int):
    def run(batches):
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                held.append(b.slice(at, chunk))
                n += held[-1].num_rows
                if n >= chunk:
                    node, root = _roots(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1)))
                    yield batch(u=node, v=root)
                    held, n = [], 0
        if held:
            node, root = _roots(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1)))
            yield batch(u=node, v=root)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "components", chunk: int = CHUNK) -> DataFrame:
    """(node, component) for each node of ``edges``, a table that is read twice.

    Null ends are left out and repeated edges do not matter.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    tasks = max(1, -(-e.count() // chunk))
    forest = e.coalesce(tasks).mapInArrow(_forest(chunk), "u long, v long")
    if tasks == 1:
        return forest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    star = materialise(forest.where("u <> v").distinct(), label)
    same = F.bit_xor(F.xxhash64("u", "v"))
    before = star.agg(F.count(F.lit(1)), same).first()
    while True:
        # Large star: every larger neighbour of a node is tied to the smallest node around it.
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours, and the node itself, are tied to the smallest of them.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), label)
        after = following.agg(F.count(F.lit(1)), same).first()
        release(spark, star.scratch)
        star = following
        if before == after:
            break
        before = after
    heads = star.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.distinct())
