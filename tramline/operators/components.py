"""Connected components of links between 64-bit nodes.

Links are contracted inside tasks first: a task joins all links that it holds and hands on one
row a node, (node, the smallest node that it was joined with). A node that several tasks saw has
as many rows as tasks saw it, however many links it has, so no key is hotter than there are
tasks. Its smallest root joins the others, which are links of a next, smaller round. Each round
at least joins every node to its smallest neighbour, and once few links are left, a single task
has them all. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.shared import fresh_path, removed, written

#: Links that a task joins, and parts that the rows of a component fall into when they meet its number.
TASK_LINKS, SALTS = 200_000, 32


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): every node of the links (a, b) and the smallest node connected to it."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y = np.maximum(rx[apart], ry[apart]), np.minimum(rx[apart], ry[apart])
        np.minimum.at(root, x, y)
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    column = lambda k: np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) if held else np.zeros(0, np.int64)
    nodes, roots = joined(column(0), column(1))
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], ["node", "root"])


def components(edges: DataFrame, by: str | None = None, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component): the smallest node that is connected, whatever the edges' direction; with `by`, in each group of that column, which one task holds."""
    if by is not None:

        def group(key: tuple, table: pa.Table) -> pa.Table:
            nodes, roots = joined(table.column("src").to_numpy(), table.column("dst").to_numpy())
            return pa.table({by: pa.array(np.full(len(nodes), key[0].as_py()), pa.int64()), "node": pa.array(nodes, pa.int64()), "component": pa.array(roots, pa.int64())})

        return edges.select(F.col(by).cast("bigint").alias(by), "src", "dst").groupBy(by).applyInArrow(group, f"{by} bigint, node bigint, component bigint")
    spark, path, rounds = edges.sparkSession, fresh_path(edges.sparkSession, "components"), []
    links = written(edges.select(F.greatest("src", "dst").cast("bigint").alias("a"), F.least("src", "dst").cast("bigint").alias("b")).distinct(), "", f"{path}-0-links")
    while left := links.count():
        k, tasks = len(rounds), -(-left // task_links)
        dealt = links.coalesce(1) if tasks == 1 else links.repartitionByRange(tasks, "b") if not k else links.repartition(tasks, "b")
        seen = written(dealt.mapInArrow(_contract, "node bigint, root bigint"), "", f"{path}-{k}-seen")
        if tasks == 1 and not k:
            removed(spark, f"{path}-0-links")
            return seen.select("node", F.col("root").alias("component"))
        low = seen.groupBy("node").agg(F.min("root").alias("low"))
        if tasks == 1:
            rounds.append(low)
            break
        # As many rows a node as tasks saw it.
        again = written(seen.join(low, "node"), "", f"{path}-{k}-low")
        rounds.append(again.select("node", "low").distinct())
        links = written(again.where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct(), "", f"{path}-{k + 1}-links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds.pop()
    while rounds:
        last = found.select(F.col("node").alias("low"), F.col("low").alias("_lower"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        rows = rounds.pop().withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        found = rows.join(last, ["low", "_salt"], "left").select("node", F.coalesce("_lower", "low").alias("low"))
    found = written(found.withColumnRenamed("low", "component"), "components")
    removed(spark, f"{path}-*")
    return found
