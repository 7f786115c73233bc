"""Connected components by alternating star contraction, on executors only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._rows import batch
from ._store import dealt, free, save

#: Edges that a task holds at a time (about 100 bytes each while it contracts them), and edges for each task of a round.
HELD, EACH = 1 << 20, 100_000
_EDGE = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _stars_of(edges: list[np.ndarray]):
    """Stars round the least node of each tree of these edges."""
    nodes, at = np.unique(np.concatenate(edges), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at.reshape(-1, 2).T
    while True:  # least label over edges, then pointer jumping
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.arange(len(nodes)) != root
    return batch({"a": nodes[root[own]], "b": nodes[own]}, _EDGE)


def _contract(batches):
    """Replace the edges of a task, HELD at a time, by stars that connect the same nodes."""
    held, n = [], 0
    for b in batches:
        held.append(np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()], 1))
        n += b.num_rows
        if n >= HELD:
            yield _stars_of(held)
            held, n = [], 0
    if n:
        yield _stars_of(held)


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One half round: point neighbours at the least node of the neighbourhood."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.select("a", "b") if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = save(dealt(around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), n, EACH))
    joined = around.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    done = out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = save(dealt(done, n, EACH))
    free(least)
    return done


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node.

    ``edges`` has long columns a and b, and is read twice, so it should be a written table.  Each task first contracts its own edges, HELD at a
    time.  Then every round is a group-by and a join; the table of minima is written first,
    so both join sides are plain exchanges that adaptive execution can split where one node
    has very many edges.
    """
    edges = edges.where("a <> b").select("a", "b")
    n = edges.count()
    cur = save(dealt(edges.mapInArrow(_contract, _EDGE).distinct(), n, EACH))
    mark = None
    while True:
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or now.n == 0:
            break
        mark = now
        big = _stars(cur, True, now.n)
        free(cur)
        cur = _stars(big, False, now.n)
        free(big)
    nodes = cur.select(F.col("b").alias("node"), F.col("a").alias("component"))
    out = save(dealt(nodes.unionByName(cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), n, EACH))
    free(cur)
    return out
