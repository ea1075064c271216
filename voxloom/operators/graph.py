"""Connected components of an edge table, without collecting edges or nodes anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.arrow import merged
from voxloom.session import durable, release

#: Edges that a task contracts at once: some tens of MB, whatever the input.
CHUNK = 250_000


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(hi, lo) with the same components: each chunk of a partition as stars around its components' smallest ids."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        hi, lo = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        ids, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        root = merged(len(ids), at[: len(hi)], at[len(hi) :])
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], names=["hi", "lo"])

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                if rows + part.num_rows > chunk:
                    yield stars(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield stars(held)

    return edges.select("hi", "lo").mapInArrow(shortened, "hi long, lo long")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", chunk: int = CHUNK) -> DataFrame:
    """(id, root) of each node of ``edges`` that is not its own root; root is the smallest id of its component.

    Distinct edges are first contracted in chunks, which leaves at most one per node and chunk.  What
    then fits into one chunk is finished by one more contraction.  Otherwise chunks of many small
    partitions are contracted together, and the published large-star and small-star steps (Kiveris
    et al., 2014) alternate.  Each step takes a minimum per node, which Spark combines on the map
    side, and joins it back; joins on a node of very many edges are left to adaptive skew splitting.
    Each round is checkpointed, and rounds end when a fingerprint of the edge set stays as it was, or
    sooner when the edges fit into one chunk.  Nodes with no edge but to themselves, and null ends,
    do not appear.  What earlier rounds left on disk is released each round.
    """
    pairs = edges.select(F.greatest(src, dst).cast("long").alias("hi"), F.least(src, dst).cast("long").alias("lo"))
    # The shuffle of distinct() also parts this Python step from one that made the edges: a task would hold a worker for each.
    pairs = durable(contracted(pairs.where("hi > lo").distinct(), chunk))
    n = pairs.count()
    if n > chunk:
        pairs = durable(contracted(pairs.coalesce(math.ceil(n / chunk)), chunk).distinct())
    last = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state[0] <= chunk:
            return durable(contracted(pairs.coalesce(1), chunk)).select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        if state == last:
            return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        last = state
        both = pairs.selectExpr("hi u", "lo v").union(pairs.selectExpr("lo u", "hi v"))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(low, "u").where("v > u").selectExpr("v hi", "least(low, u) lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low, "hi").where("lo > low").selectExpr("lo hi", "low lo")
        pairs = durable(small.union(low.selectExpr("hi", "low lo")).distinct())
        del both, low, large, small
        release(edges.sparkSession)
