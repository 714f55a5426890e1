"""Connected components of an edge list: in one task where it fits, else by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadstone.session import discard, materialize

#: Edge lists of up to so many different edges are solved by one task, which holds up to 300 bytes an edge. Every round of
#: stars is a dozen exchanges, whose plans, threads and broadcasts cost the driver the same however few edges there are.
AT_ONCE = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1, which u and v join: roots are hooked to lesser roots
    that they are joined with, and paths made short, a number of rounds logarithmic in the nodes."""
    label = np.arange(n)
    while True:
        x, y = label[u], label[v]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _solved(e: DataFrame) -> DataFrame:
    """node, component of the edges u, v, by one task."""
    kind = e.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not read:
            return
        u, v = (pa.concat_arrays([x.column(k) for x in read]) for k in (0, 1))
        nodes = pc.unique(pa.chunked_array([u, v]))
        nodes = nodes.take(pc.sort_indices(nodes))
        label = least_labels(*(pc.index_in(x, nodes).to_numpy() for x in (u, v)), len(nodes))
        for at in range(0, len(nodes), 10_000):
            yield pa.RecordBatch.from_arrays([nodes[at : at + 10_000], nodes.take(pa.array(label[at : at + 10_000]))], names=["node", "component"])

    return e.coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, at_once: int = AT_ONCE) -> DataFrame:
    """Every node of `edges` with the least node of its component: node, component.

    Up to `at_once` different edges are solved by one task. With more, large-star and small-star steps alternate until
    nothing changes, a number of rounds logarithmic in a component's size. Each step is an aggregation of a node's least
    neighbour, which combines before the shuffle, and a join; the edge list is written to the shared checkpoint folder each
    round and the one before it removed. Self loops and nulls are left out; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if e.count() <= at_once:
        return _solved(e)
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
