"""Mixing sources to target weights by capped water-filling.

Targets share a budget by weight; a source whose share exceeds its cap (maximum epochs
times its size) is clamped and the excess goes to the others by weight, until none is
above.  With sources sorted by cap over weight, the clamped ones are a head of that order,
found from running sums.  Each source then takes whole repetitions of all its documents,
and for the rest of its target the documents that come first in a seeded hash order.
That order is cut by per-bucket sums, so only one bucket of a source is sorted, however
large the source is.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 take 0; repeated rows are separate documents with equal fate
in the hash order, told apart by nothing but their rows; mixed rows are told apart by a row key that is made
and written first, so null and repeated ids lose or multiply no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import join_small, save

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: int) -> DataFrame:
    """Add ``target`` to a table of sources with columns source_size and weight."""
    whole = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    rows = sources.withColumn("cap", F.col("source_size") * epochs)
    rows = rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # clamped while the level left for this and later sources lies at or above its cap
    rows = rows.withColumn("level", F.col("rest") / F.col("open")).withColumn("clamped", F.col("level") * F.col("weight") >= F.col("cap"))
    free = F.min(F.when(~F.col("clamped"), F.struct("pos", "level"))).over(whole)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("first", free)
    target = F.when(F.col("first").isNull() | (F.col("pos") < F.col("first.pos")), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return rows.withColumn("target", target.cast("double")).select(*sources.columns, "target")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (size times repetitions), repeats, and ``row_col`` if given.

    Sources in order take ``weights`` in turn; targets share ``share`` of all sizes.
    """
    key = [] if row_col is None else [row_col]
    size = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_of(text_col).alias("size"), *key))
    # a bucket of a fixed seeded order; equal rows get the same place
    # rows without an id take places by their row key, so that they spread over the buckets
    place = F.xxhash64(F.lit(seed), "doc_id") if row_col is None else F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), row_col)).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    size = size.withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(BUCKETS)).cast("int"))
    sums = save(size.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    sources = water_fill(sources, share, epochs)
    sources = sources.withColumn("turns", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = save(sources.withColumn("part", F.col("target") - F.col("turns") * F.col("source_size")).select("source", "source_size", "target", "turns", "part"))

    # the bucket of each source in which the fractional repetition ends, and the words before it
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    run_sums = sums.withColumn("upto", F.sum("words").over(run))
    known = sources.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    cut = join_small(run_sums.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), known, ["source_key"])
    cut = cut.where(F.col("upto") > F.col("part")).groupBy("source_key").agg(F.min(F.struct("bucket", "upto", "words")).alias("c"))
    known = known.join(cut, "source_key", "left").select("source_key", "source_size", "target", "turns", "part", F.coalesce("c.bucket", F.lit(BUCKETS)).alias("edge"), F.coalesce(F.expr("c.upto - c.words"), F.lit(0)).alias("before"))
    known = save(known)

    rows = join_small(size.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), known, ["source_key"])
    on_edge = rows.where("bucket = edge")
    within = W.partitionBy("source_key").orderBy("place", "doc_id", "size", *key).rowsBetween(W.unboundedPreceding, 0)
    on_edge = on_edge.withColumn("upto", F.col("before") + F.sum("size").over(within))
    # the document at the border is taken where most of it lies before the border
    on_edge = on_edge.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("part")).cast("long")).drop("upto")
    rest = rows.where("bucket <> edge").withColumn("extra", (F.col("bucket") < F.col("edge")).cast("long"))
    out = rest.unionByName(on_edge)
    times = F.least(F.col("turns") + F.col("extra"), F.lit(epochs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("repeats"), *key)


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all where that is 0)."""
    keyed = save(docs.withColumn("__mix_row", F.monotonically_increasing_id()))  # written, so that every reading finds the same keys
    times = mix_sources(keyed, id_col=id_col, row_col="__mix_row", **options).where("repeats > 0")
    times = save(times.select("__mix_row", F.col("repeats").alias("__mix_repeats")))
    rows = keyed.join(times, "__mix_row")
    return rows.withColumn("__mix_turn", F.explode(F.sequence(F.lit(1), F.col("__mix_repeats").cast("int")))).select(*docs.columns)
