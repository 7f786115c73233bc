"""Embedding near-duplicates by spherical-cap filters with random product codes.

A filter is a direction made of one codeword per block of coordinates (after one seeded
rotation), so ``codes ** blocks`` filters are described by ``codes * blocks`` short
vectors.  List decoding gives, for each vector, all filters whose direction it exceeds in
inner product by the cap's height: block scores are sorted out by what the other blocks
can add at most, and the two halves' sums are merged.  A vector that exceeds fewer than
``at_least`` takes its best ones.  Vectors meet in shared filters, and each distinct pair
is verified once in double precision.

The number of filters follows the number of vectors (FILL filters each) and the height is
such that a vector exceeds about ``per_vector`` of them, so unrelated vectors seldom meet,
at any size.  For 64 coordinates a pair at cosine 0.95 is missed about once in a hundred.

Groups of near copies take no pair for each two of their vectors:

1. In turns, each vector is compared with one representative of every filter it shares,
   and components of links contract.  Then vectors of different components that share a
   filter are compared, where a filter's vectors outside its main component probe the others.
2. In a component, the vectors within half the threshold's angle of the component's mean
   are a ball: any two of them link, so their links are counted and not compared.
3. The vectors outside the ball are compared with the vectors of their component that share
   a filter with them.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components has no links and is its own component; only vectors of equal length are
compared; equal vectors collapse before and count in full after; rows that repeat a
vec_id are separate vectors, each with its own links; a vector without an id links as any
other, and its component is null where no vector of it has an id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._rows import batch, extend, fields, lists, slices
from ._store import dealt, free, save

BLOCKS = 4
#: Filters per vector of the table.
FILL = 256
#: Turns of comparison with representatives at most, and the share of pairs that must link for another turn.
TURNS, WORTH = 4, 0.05
#: For each task: vectors or filter entries, and pairs that are compared.
EACH, COMPARED = 100_000, 20_000


class ProductCode:
    """Filters for vectors of ``dim`` coordinates."""

    def __init__(self, dim: int, vectors: int, per_vector: float = 64, at_least: int = 32, seed: int = 3):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.width, self.at_least = dim, -(-dim // BLOCKS), at_least
        full = self.width * BLOCKS
        self.codes = max(8, math.ceil((FILL * vectors) ** (1 / BLOCKS)))
        self.rotation = np.linalg.qr(rng.standard_normal((full, full)))[0]
        words = rng.standard_normal((BLOCKS, self.codes, self.width))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True) / math.sqrt(BLOCKS)
        self.height = NormalDist().inv_cdf(1 - min(0.5, per_vector / self.codes**BLOCKS)) / math.sqrt(full)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Filters of each row of unit vectors."""
        full = np.zeros((len(x), self.width * BLOCKS))
        full[:, : self.dim] = x
        turned = (full @ self.rotation).reshape(len(x), BLOCKS, self.width)
        scores = np.einsum("nbw,bcw->nbc", turned, self.words)
        return [self._list(s, self.height) for s in scores]

    def _list(self, s: np.ndarray, height: float) -> np.ndarray:
        best = s.max(1)
        height = min(height, best.sum())
        while True:
            found, sums = self._above(s, best, height)
            if len(found) >= self.at_least or len(found) == self.codes**BLOCKS:
                break
            height -= 0.02
        if height < self.height:  # lowered for this vector: only its best
            found = found[np.argsort(-sums, kind="stable")[: self.at_least]]
        return found

    def _above(self, s: np.ndarray, best: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
        slack = best.sum() - height
        own = [np.flatnonzero(s[b] >= best[b] - slack) for b in range(BLOCKS)]
        half = []
        for a, b in ((0, 1), (2, 3)):
            total = s[a][own[a]][:, None] + s[b][own[b]][None, :]
            i, j = np.nonzero(total >= best[a] + best[b] - slack)
            half.append((total[i, j], own[a][i] * self.codes + own[b][j]))
        (left, left_id), (right, right_id) = half
        order = np.argsort(right)
        right, right_id = right[order], right_id[order]
        start = np.searchsorted(right, height - left)
        n = len(right) - start
        at = np.repeat(np.arange(len(left)), n)
        to = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + start[at]
        return left_id[at].astype(np.int64) * self.codes**2 + right_id[to], left[at] + right[to]


def _rows_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = _rows_of(blobs)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(blobs: list[bytes]):
    """Places of the vectors of each length."""
    n = np.array([len(b) for b in blobs])
    return [np.flatnonzero(n == k) for k in np.unique(n)]


def _scaled(values) -> bytes | None:
    """The components as doubles, scaled by their largest so that no norm overflows; None if not a direction."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max()
    return None if not np.isfinite(top) or top == 0 else (x if 1e-100 < top < 1e100 else x / top).tobytes()


def _linked(pairs: DataFrame, nodes: DataFrame, count: int, cosine: float) -> DataFrame:
    """The pairs (a, b) of at least ``cosine``, in double precision, with components (pa, pb) and copies (ca, cb)."""

    def verify(batches):
        for b in slices(batches, 4096):
            xa, xb = b.column("xa").to_pylist(), b.column("xb").to_pylist()
            keep = np.zeros(b.num_rows, bool)
            for at in _by_length(xa):  # both sides have equal lengths
                keep[at] = np.einsum("ij,ij->i", _unit([xa[i] for i in at]), _unit([xb[i] for i in at])) >= cosine
            yield b.select(out.names).filter(pa.array(keep))

    out = fields("a long, b long, pa long, pb long, ca long, cb long")
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("x").alias(f"x{k}"), F.col("comp").alias(f"p{k}"), F.col("copies").alias(f"c{k}"))
    return save(dealt(pairs.join(side("a"), "a").join(side("b"), "b"), count, COMPARED).select(*out.names, "xa", "xb").mapInArrow(verify, out))


def _contracted(nodes: DataFrame, links: DataFrame, size: int) -> DataFrame:
    near = components(links.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    own = [c for c in nodes.columns if c != "comp"]
    out = nodes.join(near.withColumnRenamed("node", "comp"), "comp", "left").select(*own, F.coalesce("component", "comp").alias("comp"))
    out = save(dealt(out, size, EACH))
    free(nodes, near)
    return out


def _pairs(left: DataFrame, right: DataFrame, on: list[str], which: str, entries: int) -> DataFrame:
    """Distinct pairs, the lesser first, of ``node`` and ``other`` that meet."""
    met = left.join(right, on).where(which)
    return save(dealt(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), entries, EACH))


def _with_balls(nodes: DataFrame, size: int, cosine: float) -> DataFrame:
    """Nodes with ``ball``: whether they lie within half the threshold's angle of their component's mean."""

    def sums(batches):
        for b in slices(batches, 4096):
            comp, x = b.column("comp").to_numpy(), b.column("x").to_pylist()
            ids, means = [], []
            for at in _by_length(x):
                own, to = np.unique(comp[at], return_inverse=True)
                total = np.zeros((len(own), len(x[at[0]]) // 8))
                np.add.at(total, to, _unit([x[i] for i in at]))
                ids += own.tolist()
                means += list(total)
            yield batch({"comp": ids, "total": lists(means, pa.float64())}, part)

    def near(x, center):
        out = np.zeros(len(x), bool)
        for at in _by_length(x):
            c = np.array([center[i] for i in at])
            norm = np.linalg.norm(c, axis=1)
            out[at] = (norm > 0) & (np.einsum("ij,ij->i", _unit([x[i] for i in at]), c) >= (half + 1e-9) * norm)
        return {"ball": out}

    half, part = math.sqrt((1 + cosine) / 2), fields("comp long, total array<double>")
    shared = nodes.groupBy("comp").count().where("count > 1").select("comp")
    each = nodes.join(shared, "comp", "left_semi").select("comp", "x").mapInArrow(sums, part)
    spread = each.select("comp", F.posexplode("total").alias("pos", "v")).groupBy("comp", "pos").agg(F.sum("v").alias("v"))
    center = spread.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("c"))  # as many values as coordinates
    center = save(dealt(center, size, EACH).select("comp", F.transform("c", lambda p: p["v"]).alias("center")))
    own = extend(nodes.join(center, "comp"), ["x", "center"], near, "ball boolean", ["node"])
    out = save(dealt(nodes.join(own, "node", "left"), size, EACH).withColumn("ball", F.coalesce("ball", F.lit(False))))
    free(center)
    return out


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, per_vector: float = 64) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id and kept."""
    spark = table.sparkSession

    def read(values):
        raw = [_scaled(v) for v in values]
        return {"dim": [0 if r is None else len(r) // 8 for r in raw], "x": raw}

    slim = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = save(extend(slim, ["v"], read, "dim int, x binary", ["vec_id"]).withColumn("digest", F.unhex(F.sha2("x", 256))))
    nodes = vectors.where("dim > 0").groupBy("digest").agg(F.min("vec_id").alias("node"), F.first("dim").alias("dim"), F.first("x").alias("x"), F.count("*").alias("copies"))
    nodes = save(nodes.withColumnRenamed("node", "vec_id").withColumn("node", F.monotonically_increasing_id()))  # written, so that every reading finds the same keys
    every, nodes = nodes, save(nodes.withColumn("comp", F.col("node")))
    free(every)
    sizes = {r.dim: r["count"] for r in nodes.groupBy("dim").count().collect()}
    codes = spark.sparkContext.broadcast({d: vars(ProductCode(d, n, per_vector)) for d, n in sizes.items()})
    entry = fields("node long, dim int, f long")

    def filters(batches):
        own = {}
        for d, values in codes.value.items():
            own[d] = ProductCode.__new__(ProductCode)
            own[d].__dict__.update(values)
        for b in slices(batches, 256):
            node, x = b.column("node").to_numpy(), b.column("x").to_pylist()
            for at in _by_length(x):
                d = len(x[at[0]]) // 8
                found = own[d].decode(_unit([x[i] for i in at]))
                yield batch({"node": np.repeat(node[at], [len(f) for f in found]), "dim": np.full(sum(map(len, found)), d), "f": np.concatenate(found)}, entry)

    size = sum(sizes.values())
    rows = save(nodes.select("node", "x").mapInArrow(filters, entry))
    shared = rows.groupBy("dim", "f").count().where("count > 1").drop("count")
    every, rows = rows, save(dealt(rows.join(shared, ["dim", "f"]), size, EACH // 32))
    free(every)
    entries = rows.count()

    at = ["dim", "f"]
    for turn in range(TURNS):
        now = rows.join(nodes.select("node", "comp"), "node")
        first = now.groupBy(*at).agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("place"), "node", "comp")).alias("r"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        first = first.where("low <> high").select(*at, F.col("r.node").alias("other"), F.col("r.comp").alias("other_comp"))
        pairs = _pairs(now, first, at, "comp <> other_comp", entries)
        count = pairs.count()
        links = _linked(pairs, nodes, count, cosine)
        made = links.count()
        if made:
            nodes = _contracted(nodes, links, size)
        worth = made > WORTH * count
        free(pairs, links)
        if not worth:
            break

    now = rows.join(nodes.select("node", "comp"), "node")
    main = now.groupBy(*at, "comp").agg(F.count("*").alias("k")).groupBy(*at).agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps"))
    main = save(dealt(main, entries, EACH).where("comps > 1").select(*at, F.col("m.comp").alias("main")))
    probes = now.join(main, at).where("comp <> main").select(*at, "main", F.col("node").alias("other"), F.col("comp").alias("other_comp"))
    pairs = _pairs(now, probes, at, "comp <> other_comp AND (comp = main OR node < other)", entries)
    links = _linked(pairs, nodes, pairs.count(), cosine)
    if links.count():
        nodes = _contracted(nodes, links, size)
    free(main, pairs, links)

    nodes = _with_balls(nodes, size, cosine)
    now = rows.join(nodes.select("node", "comp", "ball"), "node")
    outside = now.where("NOT ball").select(*at, "comp", F.col("node").alias("other"))
    pairs = _pairs(now, outside, [*at, "comp"], "ball OR node < other", entries)
    links = _linked(pairs, nodes, pairs.count(), cosine)
    near = links.select(F.col("a").alias("node"), F.col("cb").alias("n")).unionByName(links.select(F.col("b").alias("node"), F.col("ca").alias("n"))).groupBy("node").agg(F.sum("n").alias("near"))
    label = nodes.groupBy("comp").agg(F.min("vec_id").alias("component_id"), F.sum(F.when(F.col("ball"), F.col("copies"))).alias("balled"))
    facts = nodes.join(near, "node", "left").join(label, "comp")
    n_links = F.when(F.col("ball"), F.col("balled")).otherwise(F.col("copies")) - 1 + F.coalesce("near", F.lit(0))
    facts = save(dealt(facts, size, EACH).select("digest", n_links.alias("n_links"), "component_id"))
    free(rows, pairs, links, nodes)
    labels = vectors.select("vec_id", "digest").join(facts, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return labels.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
