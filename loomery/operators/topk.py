"""Top k rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str] | str, order: list[Column], k: int, rank: str = "rank", salts: int = 0, salt_on: str | None = None) -> DataFrame:
    """Add ``rank`` (from 1) and keep ranks up to ``k``.

    The rank filter becomes a group limit in front of the shuffle, so each task
    sends at most k rows per group. With ``salts`` a first round takes the top k
    of every salted part, so that many tasks share a group before one ends it.
    """
    by = [by] if isinstance(by, str) else list(by)
    if salts:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
        df = (
            salted.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)))
            .where(F.col("_rn") <= k)
            .drop("_rn", "_salt")
        )
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
