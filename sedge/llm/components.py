"""Connected components of a large graph, by alternating large and small stars, and joins that stand hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import batch, cut

SALTS = 16


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left", most: int = 50_000, hot: int = 2_000) -> DataFrame:
    """rows joined with table (one row per key). The table is broadcast if it has at most `most` rows, which is counted.

    Else both sides are shuffled, and keys of more than `hot` rows (and of more than a 20,000th of all, so there are 20,000
    of them at most) are salted on both sides: a key with a third of all rows is spread, and no other key is copied."""
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key, how)
    least = max(hot, rows.count() // 20_000)
    keys = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > least)
    keys = F.broadcast(cut(keys.select(key, F.lit(True).alias("__hot")), "hot-keys"))
    salt = F.when(F.col("__hot") | F.col(key).isNull(), F.floor(F.rand(11) * SALTS).cast("int")).otherwise(0)
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.join(keys, key, "left").withColumn("__salt", salt).drop("__hot")
    spread = table.join(keys, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these links that aren't the least of their component, and the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contracted(edges: DataFrame, links: int) -> DataFrame:
    """u, v: the links u, v of each partition, so many at a time, as stars around the least node of what they connect."""
    fields = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        own, n = [], 0
        for got in batches:
            own.append((got.column("u").to_numpy(), got.column("v").to_numpy()))
            n += len(own[-1][0])
            if n >= links:
                yield batch(fields, [*stars(*map(np.concatenate, zip(*own, strict=True)))])
                own, n = [], 0
        if n:
            yield batch(fields, [*stars(*map(np.concatenate, zip(*own, strict=True)))])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most: int = 60, links: int = 500_000) -> DataFrame:
    """edges: a, b (long, not null) -> node, root: the least node of each node's component, of all nodes in edges that differ.

    Each partition's links become stars first. If no more than `links` are left, which is counted, one task joins them.
    Else, in rounds, a link u, v of the greater u becomes one to the least that v links to; then a node links the others
    below it, and itself, to the least of them; partitions become stars again. No step adds links, and each lowers the sum
    of their ends unless it changes nothing, so a round that changes nothing leaves stars: after about log2 of the longest
    path. A round is two tables in the shared folder and about eight jobs, as each job costs the driver memory. A node is
    the greater end of few links, as each partition has one; hubs, at the lesser end, meet minima in a join of written
    tables, which Spark splits where it is skewed."""
    now = cut(contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), max(links, 1)).distinct(), "components")
    if now.limit(links + 1).count() <= links:
        joined = cut(contracted(now.coalesce(1), links + 1), "components").select(F.col("u").alias("node"), F.col("v").alias("root"))
        return joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    mark = None
    for _ in range(most):
        least = cut(now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "components-least")
        jumped = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).repartition("u").distinct()
        low = jumped.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(contracted(small, max(links, 1)), "components")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    joined = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
