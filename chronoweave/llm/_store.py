"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import free, save, sweep  # noqa: F401


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` of about ``rows`` rows in as many tasks as give ``each`` rows to one, or in those it has if these are fewer."""
    return df.coalesce(rows // each + 1)


#: Rows up to which a side is broadcast: a bound that callers check by counting first.
BROADCAST_ROWS = 10_000


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Join ``big`` with a table of unique keys that is usually tiny.

    ``small`` is counted; up to BROADCAST_ROWS rows it is broadcast.  Beyond that the
    key is salted at random but repeatably by the row's place, so that one key with a third of all rows spreads over ``salts`` tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("__cw_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    key = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return big.withColumn("__cw_salt", key).join(salted, [*on, "__cw_salt"], how).drop("__cw_salt")
