"""Connected components, and groups of rows that stream through a task one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node but the roots: root is the least node that the edges (a, b) connect it with.

    Large-star and small-star rounds, which end in some logarithm of the longest path: each node hands its neighbours above
    it to its least neighbour, then its neighbours below it. Nothing but two numbers comes to the driver; each round's edges are written to
    the shared folder, so a lost executor never costs more than a round.
    """
    current = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).collect()[0])
    before = mark(current)
    while before[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Written, so that the join has plain exchanges, whose large partitions can be split.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        lower = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        down = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, current = current, cut(down.unionAll(lower.select("a", F.col("m").alias("b"))).distinct())
        drop(last, least, large, lower)
        after = mark(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The tables of equal keys, one after another, of batches that are sorted by the keys (longs without nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys], 1)
        new = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(last.schema.get_field_index(k))[0].as_py() != values[0, i] for i, k in enumerate(keys)):
                yield pa.Table.from_batches(held)
                held = []
        at = 0
        for end in new.tolist():
            held.append(batch.slice(at, end - at))
            yield pa.Table.from_batches(held)
            held, at = [], end
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def tiled(rows: DataFrame, key: str, tile: int, salt: str) -> DataFrame:
    """Rows with their group's pairs of tiles: each row has its own tile `t`, and one copy for each other tile (ti <= tj) it has to meet.

    rows: with the group's size `size`. Groups of up to `tile` rows have one tile, and one copy of each row.
    """
    n = F.ceil(F.col("size") / tile)
    own = F.pmod(F.xxhash64(F.col(salt), F.lit(17)), n)
    out = rows.withColumn("t", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return out.withColumn("ti", F.least("t", "other")).withColumn("tj", F.greatest("t", "other")).drop("other")


def by_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def binary_matrix(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


class Forest:
    """Union-find over 0 to n - 1 whose roots are the least members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def spread(adjacent: np.ndarray) -> np.ndarray:
    """Component (least member) of each node of a symmetric boolean matrix."""
    label = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if label[i] < 0:
            front = np.array([i])
            label[i] = i
            while len(front):
                front = np.flatnonzero(adjacent[front].any(0) & (label < 0))
                label[front] = i
    return label


__all__ = ["Forest", "binary_matrix", "by_group", "components", "grouped", "pc", "spread", "tiled"]
