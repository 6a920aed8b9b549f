"""Results kept by content: computed once, read again while they are fresh.

A store is a versioned table that only grows: (tenant_id, key, value, stored_at), in cells
by key. ``fill`` computes what is missing or too old, adds it as a commit of its own
(nothing that lies there is rewritten), and joins the values back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from loomery.session import materialize
from loomery.sources.versions import VersionedTable

KEY = ["tenant_id", "key"]


class ReuseStore:
    def __init__(self, spark: SparkSession, path: str, value: DataType, max_age: int | None = None, buckets: int = 8):
        """``max_age`` in seconds; None keeps results for good."""
        fields = [StructField("tenant_id", StringType()), StructField("key", StringType()), StructField("value", value), StructField("stored_at", LongType())]
        self.table = VersionedTable(spark, path, StructType(fields), "key", buckets)
        self.max_age = max_age

    def fresh(self, now: int, keys: DataFrame | None = None) -> DataFrame:
        """The latest result of each key that is not too old at ``now`` (epoch seconds);
        with ``keys`` (tenant_id, key) only their cells are read."""
        rows = self.table.rows() if keys is None else self.table.rows_near(keys).join(keys, KEY, "left_semi")
        age = F.lit(now) - F.col("stored_at")
        if self.max_age is not None:
            rows = rows.where((age >= 0) & (age < self.max_age))
        return rows.groupBy(*KEY).agg(F.max_by("value", "stored_at").alias("value"), F.max("stored_at").alias("stored_at"))

    def fill(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], now: int) -> tuple[DataFrame, int]:
        """(``wanted`` with value and stored_at, number of results computed).

        ``wanted`` has tenant_id, key and what ``make`` needs; rows of one key must need
        the same result, and the first of them is handed on. ``make`` adds ``value``.
        Rows without tenant or key get no value and are not handed on. Values may be null.
        """
        rest = [c for c in wanted.columns if c not in KEY]
        named = wanted.where("tenant_id is not null and key is not null")
        once = named.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(*KEY, "_r.*") if rest else named.select(*KEY).distinct()
        keys = materialize(once.select(*KEY), "asked-keys")
        missing = materialize(once.join(self.fresh(now, keys).select(*KEY), KEY, "left_anti"), "misses")
        n = missing.count()
        if n:
            self.table.add(make(missing).select(*KEY, "value", F.lit(now).cast("bigint").alias("stored_at")))
        return wanted.join(self.fresh(now, keys), KEY, "left"), n
