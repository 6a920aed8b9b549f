"""Stages whose rows are counted while they are written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomery.session import materialize


@dataclass
class Stage:
    """``make`` turns the rows of the stage before into those of this one; ``counts`` are
    aggregates over them."""

    name: str
    make: Callable[[DataFrame], DataFrame]
    counts: dict[str, Column]


def run_stages(df: DataFrame, stages: list[Stage]) -> tuple[DataFrame, DataFrame]:
    """(rows of the last stage, (stage_no, stage, metric, value) of every stage).

    Each stage is stored, and observed by the tasks that store it: counting takes no
    further pass, and only the totals come to the driver. An empty sum counts as 0.
    """
    spark = df.sparkSession
    found = []
    for no, stage in enumerate(stages, 1):
        seen = Observation(stage.name)
        aggs = [F.coalesce(c.cast("bigint"), F.lit(0)).alias(name) for name, c in stage.counts.items()]
        df = materialize(stage.make(df).observe(seen, *aggs), stage.name)
        found += [(no, stage.name, name, seen.get[name]) for name in stage.counts]
    return df, spark.createDataFrame(found, "stage_no int, stage string, metric string, value bigint")
