"""Counters, histograms, gauges, rates, quantiles, alerts, sessions, cache hits.

Raw events are first reduced map-side to (labels, time bucket); windows, runs
and sessions are then found over these few rows, so a busy label costs no more
than a quiet one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery import constants as k
from loomery.session import materialize


def counters(df: DataFrame, labels: list[str], value: str | None = None, subtotals: bool = False) -> DataFrame:
    """Count and sum per label set; ``subtotals`` adds the rolled-up levels."""
    grouped = df.rollup(*labels) if subtotals else df.groupBy(*labels)
    aggs = [F.count("*").alias("count")] + ([F.sum(value).alias("sum")] if value else [])
    return grouped.agg(*aggs)


def histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Rows (labels, le, bucket, sum, count): cumulative buckets up to +Inf."""
    v = F.col(value)
    hits = [F.count_if(v <= x).alias(f"b{i}") for i, x in enumerate(bounds)]
    agg = df.groupBy(*labels).agg(*hits, F.sum(v).alias("sum"), F.count(v).alias("count"))
    rows = [F.struct(F.lit(float(x)).alias("le"), F.col(f"b{i}").alias("bucket")) for i, x in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket")))
    return agg.select(*labels, "sum", "count", F.explode(F.array(*rows)).alias("r")).select(*labels, "r.*", "sum", "count")


def gauges(df: DataFrame, labels: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Last value per label set; of values at the same time the largest."""
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(ts, value)).alias("value"), F.max(ts).alias("at"))


def request_rate(df: DataFrame, labels: list[str], window: str = "1 minute", ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Events per second in tumbling windows; works on streams too."""
    out = df.groupBy(F.window(ts, window), *labels).agg(F.count("*").alias("count"))
    return out.select(F.col("window.start").alias("start"), *labels, "count", (F.col("count") / seconds).alias("rate"))


def bucket_quantile(counts: Column, bounds: list[float], q: float) -> Column:
    """Quantile of cumulative ``counts`` (one per bound, then +Inf), linear inside a
    bucket; beyond the last bound that bound; null without observations."""
    n = len(bounds)
    total = F.get(counts, F.lit(n))
    rank = total * q
    out = F.when(total == 0, F.lit(None).cast("double"))
    for i, hi in enumerate(bounds):
        lo = float(bounds[i - 1]) if i else 0.0
        here = F.get(counts, F.lit(i))
        before = F.get(counts, F.lit(i - 1)) if i else F.lit(0)
        step = F.coalesce(F.try_divide((rank - before).cast("double"), (here - before).cast("double")), F.lit(0.0))
        out = out.when(here >= rank, lo + (float(hi) - lo) * step)
    return out.otherwise(float(bounds[-1]))


def window_quantiles(df: DataFrame, labels: list[str], value: str, bounds: list[float], quantiles: dict[str, float],
                     minutes: int = 5, ts: str = "ts") -> DataFrame:
    """Quantiles over sliding windows of ``minutes``, one per minute."""
    v = F.col(value)
    per_minute = df.groupBy(*labels, F.date_trunc("minute", ts).alias("minute")).agg(
        *[F.count_if(v <= x).alias(f"b{i}") for i, x in enumerate(bounds)], F.count(v).alias("total")
    )
    starts = F.transform(F.sequence(F.lit(0), F.lit(minutes - 1)), lambda i: F.timestamp_seconds(F.unix_timestamp("minute") - i * 60))
    cols = [f"b{i}" for i in range(len(bounds))] + ["total"]
    sums = per_minute.select(*labels, *cols, F.explode(starts).alias("start")).groupBy(*labels, "start").agg(*[F.sum(c).alias(c) for c in cols])
    counts = F.array(*[F.col(c) for c in cols])
    return sums.select(*labels, "start", F.col("total").alias("count"), *[bucket_quantile(counts, bounds, q).alias(n) for n, q in quantiles.items()])


def sustained(df: DataFrame, labels: list[str], value: str, above: float, unit: str = "minute", least: int = 5, ts: str = "ts") -> DataFrame:
    """Runs of at least ``least`` consecutive time units whose maximum is above the threshold."""
    seconds = {"minute": 60, "hour": 3600, "day": 86400}[unit]
    slots = df.groupBy(*labels, F.floor(F.unix_timestamp(ts) / seconds).alias("slot")).agg(F.max(value).alias("peak")).where(F.col("peak") > above)
    run = F.col("slot") - F.row_number().over(Window.partitionBy(*labels).orderBy("slot"))
    out = slots.withColumn("_run", run).groupBy(*labels, "_run").agg(F.min("slot").alias("first"), F.count("*").alias("length"), F.max("peak").alias("peak"))
    return out.where(F.col("length") >= least).select(*labels, F.timestamp_seconds(F.col("first") * seconds).alias("start"), "length", "peak")


def silences(df: DataFrame, labels: list[str], unit: str = "minute", least: int = 1, ts: str = "ts") -> DataFrame:
    """Stretches of at least ``least`` whole time units without any event."""
    seconds = {"minute": 60, "hour": 3600, "day": 86400}[unit]
    slots = df.select(*labels, F.floor(F.unix_timestamp(ts) / seconds).alias("slot")).distinct()
    before = F.lag("slot").over(Window.partitionBy(*labels).orderBy("slot"))
    out = slots.withColumn("length", F.col("slot") - before - 1).where(F.col("length") >= least)
    return out.select(*labels, F.timestamp_seconds((F.col("slot") - F.col("length")) * seconds).alias("start"), "length")


def hit_rate(df: DataFrame, labels: list[str], hit: Column, miss: Column) -> DataFrame:
    out = df.groupBy(*labels).agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def task_outcomes(df: DataFrame, labels: list[str], max_retries: int = k.TASK_MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """(counts per task and status, dead letters). ``df``: task_id, attempt, status, error."""
    counts = df.groupBy(*labels, "status").agg(F.count("*").alias("count"))
    last = df.groupBy("task_id", *labels).agg(
        F.max("attempt").alias("attempts"), F.max_by(F.struct("status", "error"), F.struct("attempt", "status")).alias("l")
    )
    dead = last.where((F.col("l.status") == "failure") & (F.col("attempts") > max_retries))
    return counts, dead.select("task_id", *labels, "attempts", F.col("l.error").alias("error"), F.lit("failed").alias("status"))


def by_route(df: DataFrame, route: str, value: str, window: str, ts: str = "ts") -> DataFrame:
    """Mean and approximate median and p95 per window and route."""
    v = F.col(value)
    out = df.groupBy(F.window(ts, window), route).agg(F.avg(v).alias("mean"), F.percentile_approx(v, [0.5, 0.95], 10000).alias("p"), F.count("*").alias("count"))
    return out.select(F.col("window.start").alias("start"), route, "mean", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), "count")


def status_latest(log: DataFrame) -> DataFrame:
    """Per document the latest status, whatever the order of arrival, with start and end times.

    ``log``: document_id, ts, event_id, status, error.
    """
    return log.groupBy("document_id").agg(
        F.max_by(F.struct("status", "error"), F.struct("ts", "event_id")).alias("l"),
        F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"),
    ).select("document_id", "l.*", "started_at", "completed_at")


# Progress marks of the preparation stages.
STAGE_PROGRESS = {"parse": 0.1, "clean": 0.3, "chunk": 0.5, "embed": 0.7, "index": 0.9, "done": 1.0}


def stage_progress(log: DataFrame) -> DataFrame:
    """Per document: furthest stage reached and its mark. ``log``: document_id, stage."""
    marks = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    return log.withColumn("progress", F.try_element_at(marks, F.col("stage"))).groupBy("document_id").agg(
        F.max_by("stage", "progress").alias("stage"), F.max("progress").alias("progress"), F.countDistinct("stage").alias("stages_done")
    )


def sessions(df: DataFrame, key: str, gap: int = k.SESSION_TTL, ts: str = "ts") -> DataFrame:
    """(key, session_start, session_end, events): a session ends ``gap`` seconds after its last event.

    Two events in one slot of ``gap`` seconds are always in one session, so each
    slot is first reduced to its ends and count; only slots are ordered per key.
    """
    slots = df.groupBy(key, F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (gap * 1_000_000)).alias("slot")).agg(
        F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count("*").alias("n")
    )
    w = Window.partitionBy(key).orderBy("slot")
    idle = F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(w))
    marked = slots.withColumn("_new", F.coalesce(idle > gap * 1_000_000, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(key, "_s").agg(F.min("lo").alias("session_start"), F.max("hi").alias("last"), F.sum("n").alias("events"))
    return out.select(key, "session_start", F.timestamp_micros(F.unix_micros("last") + gap * 1_000_000).alias("session_end"), "events")


_NEVER = -(2**62)


def _jumps(t: np.ndarray, ttl: int) -> np.ndarray:
    return np.searchsorted(t, t + ttl, "left")


def cache_flags(
    df: DataFrame, key: str, ident: str, ttl: int = k.QUERY_TTL, ts: str = "ts", block_seconds: int = 86_400, stored: DataFrame | None = None
) -> DataFrame:
    """(key, id, ts, is_hit): an answer stored at a miss serves for ``ttl`` seconds.

    Hits do not extend it, so every miss depends on the one before. Only times count
    for that, so events are first reduced to the distinct times of a key (combined
    map-side). Each key's time is cut into blocks: a block becomes a short table "expiry
    on entry -> expiry on exit", the tables are chained per key, and with its entry known
    each block names the times of its misses. The events themselves are never grouped:
    they meet the misses in a join on key, time and id. Of several events at a miss the
    one with the least id is the miss; rows of one id at one time share its flag.

    ``stored`` (key, stored) holds answers from before, as of an earlier batch: events
    older than that answer are misses and don't replace it.
    """
    if block_seconds < ttl:
        raise ValueError("a block must be at least as long as the time to live")
    width, life = block_seconds * 1_000_000, ttl * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(F.col(key).alias("k"), F.col(ident).alias("id"), at.alias("t"))
    key_type = rows.schema["k"].dataType.simpleString()
    if stored is None:
        rows = rows.withColumn("s", F.lit(None).cast("bigint"))
    else:
        before = stored.select(F.col(key).alias("k"), F.unix_micros("stored").alias("s"))
        rows = rows.join(before, "k", "left")
    late = F.coalesce(F.col("t") < F.col("s"), F.lit(False))
    # stored: joined twice, and what it is made from may be costly
    times = materialize(rows.where(~late & F.col("k").isNotNull()).select("k", "s", "t").distinct().withColumn("block", F.floor(F.col("t") / width)), "times")

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        block = int(pdf["block"].iloc[0])
        edge = block * width + life  # an entry expiry is never later than this
        m = int(np.searchsorted(t, edge, "left"))
        first = np.arange(min(m + 1, len(t)))
        jump, at_ = _jumps(t, life), first.copy()
        while True:
            nxt = jump[at_]
            go = nxt < len(t)
            if not go.any():
                break
            at_[go] = nxt[go]
        leave = t[at_] + life
        upto = t[first].copy()
        if m < len(t):
            upto[-1] = edge
        last = np.append(leave[1:] != leave[:-1], True)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "s": pdf["s"].iloc[0], "block": block, "upto": upto[last], "leave": leave[last]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["s"].iloc[0]
        out, expiry = [], _NEVER if pd.isna(first) else int(first) + life
        for block, part in pdf.sort_values(["block", "upto"]).groupby("block", sort=True):
            out.append((pdf["k"].iloc[0], block, expiry))
            i = int(np.searchsorted(part["upto"].to_numpy(), expiry, "left"))
            if i < len(part):
                expiry = int(part["leave"].iloc[i])
        return pd.DataFrame(out, columns=["k", "block", "entry"])

    def misses(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        out = []
        i = int(np.searchsorted(t, int(pdf["entry"].iloc[0]), "left"))
        while i < len(t):
            out.append(t[i])
            i = int(np.searchsorted(t, t[i] + life, "left"))
        return pd.DataFrame({"k": pdf["k"].iloc[0], "t": np.array(out, np.int64)})

    tables = times.groupBy("k", "block").applyInPandas(table, f"k {key_type}, s bigint, block bigint, upto bigint, leave bigint")
    entries = tables.groupBy("k").applyInPandas(chain, f"k {key_type}, block bigint, entry bigint")
    found = times.join(entries, ["k", "block"]).groupBy("k", "block").applyInPandas(misses, f"k {key_type}, t bigint")
    first = rows.join(found, ["k", "t"]).groupBy("k", "t").agg(F.min("id").alias("id")).withColumn("_miss", F.lit(True))
    flagged = rows.join(first, ["k", "t", "id"], "left")
    hit = F.col("_miss").isNull() & ~late & F.col("k").isNotNull()
    return flagged.select(F.col("k").alias(key), F.col("id").alias(ident), F.timestamp_micros("t").alias(ts), hit.alias("is_hit"))
