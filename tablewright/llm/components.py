"""Connected components: alternating large and small stars while there are many edges, one task for the last few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import staged

#: So many edges (16 bytes each) are finished by one task; with more, rounds of stars run over all tasks.
FEW = 1_000_000


def _closed(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node it reaches, by pointer jumping."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(places, 2)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b) of type long -> (node, label): label is the smallest node reachable. Nodes without edges are not listed.

    A round of stars is two joins on group minima, with partial aggregation and no list of a node's neighbours, so a hub
    may have any number of them; the edges are written after each round. Up to `few` edges go to one task instead,
    which gives the same labels. An empty table gives none.
    """
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() > few:
        return _stars(e)

    def task(batches):
        parts = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches if x.num_rows]
        if parts:
            node, label = _closed(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    return e.coalesce(1).mapInArrow(task, "node long, label long")


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only pairs of different labels are looked at, then the labels follow."""
    at = lambda x: F.coalesce(F.col(f"{x}.label"), F.col(f"l.{x}"))
    ends = links.alias("l").join(labels.alias("a"), F.col("l.a") == F.col("a.node"), "left").join(
        labels.alias("b"), F.col("l.b") == F.col("b.node"), "left")
    moved = staged(components(ends.select(at("a").alias("a"), at("b").alias("b"))), "moved").toDF("old", "new")
    kept = labels.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = moved.select(F.col("old").alias("node"), F.col("new").alias("label"))  # a label is a node too
    return kept.unionByName(fresh.join(labels.select("node"), "node", "left_anti"))


def _stars(e: DataFrame) -> DataFrame:
    """Labels of the edges (u, v), u > v."""
    mark = None
    while True:
        # Large star: neighbours above a node move to the smallest of its neighbours and itself.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its neighbours below it move to the smallest of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = staged(e, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # Every edge now ends in its component's smallest node.
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
