"""Connected components of an edge table by repeated contraction.

Each round maps every vertex to its least neighbour, replaces edges by their images and
keeps the map as a table; composing the maps gives each vertex the least id it reaches.
A first pass contracts edges batch by batch, so stars and chains inside a partition never
reach a shuffle.  No vertex's neighbours are ever collected together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import Scratch, ship


def local_labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, least reachable vertex) of an edge list in memory."""
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        new = new[label]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _contract(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, root = local_labels(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        own = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(root[own]), pa.array(ids[own])], names=["src", "dst"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every vertex that has an edge; ``edges`` holds src and dst as long, never null."""
    ship(edges.sparkSession)
    edges = edges.where("src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    left = scratch.cut(edges.mapInArrow(_contract, "src long, dst long").distinct())
    maps = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        to = scratch.cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("to")))
        maps.append(to)
        a, b = to.select(F.col("id").alias("src"), F.col("to").alias("a")), to.select(F.col("id").alias("dst"), F.col("to").alias("b"))
        image = left.join(a, "src").join(b, "dst").where("a <> b")
        new = scratch.cut(image.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        scratch.drop(left)
        left = new
    if not maps:
        return left.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    out = maps[-1].withColumnRenamed("to", "component")
    for to in reversed(maps[:-1]):
        below = out.withColumnRenamed("id", "to")
        out = to.join(below, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    done = scratch.cut(out)
    scratch.drop(left, *maps)
    return done
