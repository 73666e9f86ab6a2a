"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, tidy, written

#: Links (4 MB) that one task unites; more go through rounds over all tasks.
LOCAL_LINKS = 1 << 18


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


@tidy
def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of links, by labels that hook onto smaller ones and are cut short."""
    pairs = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    node, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = back[: len(a)], back[len(a) :]
    lab = np.arange(len(node))
    while len(a):
        la, lb = lab[a], lab[b]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))  # labels are roots, whose links go down
        while not np.array_equal(lab, lab[lab]):
            lab = lab[lab]
        apart = lab[a] != lab[b]
        a, b = a[apart], b[apart]
    if len(node):
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[lab])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b: long, a link either way); component is the smallest node reachable.

    Loops, repeats and nulls are dropped; no edges give no rows. Up to LOCAL_LINKS links, by a count of them, are united in
    one task. More go through rounds of alternating stars: each points nodes at smaller neighbours, and the stars that
    remain are the answer. A round writes its edges twice; minima are grouped with partial sums and broadcast where the
    nodes are at most SMALL, else Spark splits the joins of hubs. Rounds grow with the logarithm of the largest component.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = now.count()
    if n <= LOCAL_LINKS:
        return written(now.coalesce(1).mapInArrow(_united, "node long, component long"), "components")

    def least(rows: DataFrame) -> DataFrame:
        low = rows.groupBy("a").agg(F.min("b").alias("m"))
        return F.broadcast(low) if 2 * n <= SMALL else low

    seen, last = _signature(now), None
    while seen != last:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = F.least("a", "m")
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), near.alias("b")).where("a <> b")
        large = written(large.distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least(large), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, seen = seen, _signature(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
