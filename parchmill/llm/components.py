"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back
from .storage import Scratch


#: Nodes that a task holds.
NODES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition, as stars of local components; every ``NODES`` nodes are sent on."""
    parent: dict = {}
    kind = None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def done() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > NODES:
            yield done()
    if parent:
        yield done()
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v: of one type with an order) -> (node, root), root the smallest node reachable, for nodes with an edge to another.

    Each round joins nodes with their smallest neighbour; a round's edges are written
    to the shared folder, and those of the round before are deleted.  It ends when a round
    changes nothing, after about the logarithm of the longest path many rounds.  Hot nodes
    only meet in joins, which adaptive execution splits.
    """
    kind = edges.schema["u"].dataType.simpleString()
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.where("u != v").mapInArrow(_contract, f"u {kind}, v {kind}"), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after_scratch = Scratch(edges.sparkSession)
        # written, so that both sides of the join are exchanges, of which a hot node's can be split
        least = after_scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # after a large star every edge points from the larger to the smaller node
        large = after_scratch.keep(large, "large")
        low = after_scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        rest, after_scratch.paths = after_scratch.paths, []
        edges = after_scratch.keep(small, "edges")
        scratch.paths += rest
        scratch.drop()
        scratch = after_scratch
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.count_distinct("u")).first()
        if after == before and after[0] == after[2]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
