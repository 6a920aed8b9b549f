"""Metrics over the whole event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery import constants as k
from loomery.operators import metrics as mt
from loomery.plans import bindings as b
from loomery.plans.registry import query


def text_ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def sql_ts(x: str, name: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') as {name}"


@query("counters", "select user_id, event_type, count(*)::bigint as count, round(sum(value), 4) as sum from events group by all")
def counters(spark, sf_dir):
    return mt.counters(b.events(spark, sf_dir), ["user_id", "event_type"], "value").withColumn("sum", F.round("sum", 4))


@query("counters_rollup", """select coalesce(event_type, 'all') as event_type, coalesce(day, 'all') as day, count(*)::bigint as count from (
  select event_type, ts::date::varchar as day from events) group by rollup (event_type, day)""")
def counters_rollup(spark, sf_dir):
    ev = b.events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    out = mt.counters(ev, ["event_type", "day"], subtotals=True)
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit("all")).alias("day"), "count")


def _histogram_sql(bounds, scale=""):
    return f"""select event_type, le::varchar as le, count(*) filter (value{scale} <= le)::bigint as bucket, round(sum(value{scale}), 4) as sum, count(*)::bigint as count
      from events cross join (select unnest({[float(x) for x in bounds]}) as le union all select 'inf'::double) group by event_type, le"""


def _histogram(df, bounds):
    out = mt.histogram(df, ["event_type"], "value", bounds)
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return out.select("event_type", le.alias("le"), "bucket", F.round("sum", 4).alias("sum"), "count")


@query("latency_histogram", _histogram_sql(k.QUERY_LATENCY_BUCKETS))
def latency_histogram(spark, sf_dir):
    return _histogram(b.events(spark, sf_dir), k.QUERY_LATENCY_BUCKETS)


@query("retriever_latency_histogram", _histogram_sql(k.RETRIEVER_LATENCY_BUCKETS))
def retriever_latency_histogram(spark, sf_dir):
    return _histogram(b.events(spark, sf_dir), k.RETRIEVER_LATENCY_BUCKETS)


@query("request_seconds_histogram", _histogram_sql(k.REQUEST_SECONDS_BUCKETS, " / 100"))
def request_seconds_histogram(spark, sf_dir):
    return _histogram(b.events(spark, sf_dir).withColumn("value", F.col("value") / 100), k.REQUEST_SECONDS_BUCKETS)


@query("gauges", f"select user_id, event_type, arg_max(value, (ts, value)) as value, {sql_ts('max(ts)', 'at')} from events group by all")
def gauges(spark, sf_dir):
    return mt.gauges(b.events(spark, sf_dir), ["user_id", "event_type"], "value").select("user_id", "event_type", "value", text_ts("at"))


RATE_SQL = f"select {sql_ts('start', 'start')}, event_type, count, round(count / 60, 6) as rate from (select date_trunc('minute', ts) as start, event_type, count(*)::bigint as count from events group by all)"


@query("request_rate_1m", RATE_SQL)
def request_rate_1m(spark, sf_dir):
    return mt.request_rate(b.events(spark, sf_dir), ["event_type"]).select(text_ts("start"), "event_type", "count", F.round("rate", 6).alias("rate"))


def _quantile_sql(q):
    bounds = [float(x) for x in k.QUERY_LATENCY_BUCKETS]
    arms = " ".join(
        f"when b{i} >= total * {q} then {bounds[i - 1] if i else 0.0} + {hi - (bounds[i - 1] if i else 0.0)} * coalesce((total * {q} - {f'b{i - 1}' if i else 0}) / nullif(b{i} - {f'b{i - 1}' if i else 0}, 0), 0)"
        for i, hi in enumerate(bounds)
    )
    return f"round(case {arms} else {bounds[-1]} end, 6)::double"


QUANTILE_SQL = f"""select event_type, {sql_ts('start', 'start')}, total::bigint as count, {_quantile_sql('0.5::double')} as p50, {_quantile_sql('0.95::double')} as p95 from (
  select event_type, start, count(*) as total, {', '.join(f'count(*) filter (value <= {x}) as b{i}' for i, x in enumerate(k.QUERY_LATENCY_BUCKETS))} from (
    select event_type, value, unnest([date_trunc('minute', ts) - to_minutes(n) for n in [0, 1, 2, 3, 4]]) as start from events) group by all)"""


@query("latency_quantiles", QUANTILE_SQL)
def latency_quantiles(spark, sf_dir):
    out = mt.window_quantiles(b.events(spark, sf_dir), ["event_type"], "value", k.QUERY_LATENCY_BUCKETS, {"p50": 0.5, "p95": 0.95})
    return out.select("event_type", text_ts("start"), "count", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("alert_islands", f"""select event_type, {sql_ts('min(h)', 'start')}, count(*)::bigint as length, max(peak) as peak from (
  select *, h - to_hours(row_number() over (partition by event_type order by h)) as run from (
    select event_type, date_trunc('hour', ts) as h, max(value) as peak from events group by all having max(value) > 50)) group by event_type, run having count(*) >= 5""")
def alert_islands(spark, sf_dir):
    return mt.sustained(b.events(spark, sf_dir), ["event_type"], "value", 50.0, "hour", 5).select("event_type", text_ts("start"), "length", "peak")


@query("alert_silences", f"""select user_id, {sql_ts('before + to_hours(1)', 'start')}, (date_diff('hour', before, h) - 1)::bigint as length from (
  select user_id, h, lag(h) over (partition by user_id order by h) as before from (select distinct user_id, date_trunc('hour', ts) as h from events)) where date_diff('hour', before, h) - 1 >= 12""")
def alert_silences(spark, sf_dir):
    return mt.silences(b.events(spark, sf_dir), ["user_id"], "hour", 12).select("user_id", text_ts("start"), "length")


@query("cache_hit_rate", """select user_id, hits, misses, coalesce(round(hits / nullif(hits + misses, 0), 6), 0) as hit_rate from (select user_id, count(*) filter (event_type = 'view')::bigint as hits,
  count(*) filter (event_type = 'click')::bigint as misses from events group by user_id)""")
def cache_hit_rate(spark, sf_dir):
    out = mt.hit_rate(b.events(spark, sf_dir), ["user_id"], F.col("event_type") == "view", F.col("event_type") == "click")
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


# A task is one user's day; its events are the attempts, errors the failures.
TASKS_SQL = """select user_id * 100 + day(ts) as task_id, 'task' || (user_id % 4) as task, row_number() over (partition by user_id, day(ts) order by ts, event_id) as attempt,
  case when event_type = 'error' then 'failure' when event_type = 'click' then 'retry' else 'success' end as status, props as error from events"""


def tasks(spark, sf_dir):
    from pyspark.sql import Window

    status = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "retry").otherwise("success")
    w = Window.partitionBy("user_id", F.dayofmonth("ts")).orderBy("ts", "event_id")
    return b.events(spark, sf_dir).select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("task_id"), F.concat(F.lit("task"), (F.col("user_id") % 4).cast("string")).alias("task"),
        F.row_number().over(w).alias("attempt"), status.alias("status"), F.col("props").alias("error"),
    )


@query("task_outcomes", f"select task, status, count(*)::bigint as count from ({TASKS_SQL}) group by all")
def task_outcomes(spark, sf_dir):
    return mt.task_outcomes(tasks(spark, sf_dir), ["task"])[0]


@query("task_dead_letters", f"""select task_id::bigint as task_id, task, attempts::bigint as attempts, error from (select task_id, task, max(attempt) as attempts, arg_max(status, attempt) as status,
  arg_max(error, attempt) as error from ({TASKS_SQL}) group by all) where status = 'failure' and attempts > 3""")
def task_dead_letters(spark, sf_dir):
    return mt.task_outcomes(tasks(spark, sf_dir), ["task"])[1].select("task_id", "task", F.col("attempts").cast("bigint"), "error")


@query("latency_by_route", f"""select {sql_ts("ts::date::timestamp", 'start')}, event_type, round(avg(value), 6) as mean, count(*)::bigint as count,
  arg_min(value, value) as least from events group by ts::date, event_type""")
def latency_by_route(spark, sf_dir):
    ev = b.events(spark, sf_dir)
    out = mt.by_route(ev, "event_type", "value", "1 day")
    least = ev.groupBy(F.window("ts", "1 day")["start"].alias("start"), "event_type").agg(F.min("value").alias("least"))
    return out.join(least, ["start", "event_type"]).select(text_ts("start"), "event_type", F.round("mean", 6).alias("mean"), "count", "least")


@query("latency_quantiles_approx")
def latency_quantiles_approx(spark, sf_dir):
    return mt.by_route(b.events(spark, sf_dir), "event_type", "value", "1 hour")


@query(
    "latency_quantile_ranks",
    f"""select {sql_ts("ts::date::timestamp", 'start')}, event_type, count(*)::bigint as count, true as p50_holds, true as p95_holds from events group by ts::date, event_type""",
)
def latency_quantile_ranks(spark, sf_dir):
    """The approximate quantiles by route against the true ranks of what they return: within a thousandth of the count, and one row."""
    ev = b.events(spark, sf_dir)
    found = mt.by_route(ev, "event_type", "value", "1 day").select("start", "event_type", "p50", "p95")
    day = ev.select(F.window("ts", "1 day")["start"].alias("start"), "event_type", "value").join(F.broadcast(found), ["start", "event_type"])  # a row per day and type
    ranks = [F.count_if(F.col("value") < F.col(q)).alias(f"below_{q}") for q in ("p50", "p95")] + [F.count_if(F.col("value") <= F.col(q)).alias(f"upto_{q}") for q in ("p50", "p95")]
    counted = day.groupBy("start", "event_type").agg(F.count("*").alias("count"), *ranks)

    def holds(q, share):
        slack = F.col("count") / 1000 + 1
        return ((F.col(f"below_{q}") <= share * F.col("count") + slack) & (F.col(f"upto_{q}") >= share * F.col("count") - slack)).alias(f"{q}_holds")

    return counted.select(text_ts("start"), "event_type", "count", holds("p50", 0.5), holds("p95", 0.95))


STATUS_OF = {"signup": "pending", "view": "processing", "click": "indexing", "purchase": "completed", "error": "failed"}
STATUS_CASE = "case event_type " + " ".join(f"when '{e}' then '{s}'" for e, s in STATUS_OF.items()) + " end"
STATUS_SQL = f"""select document_id, status, error, coalesce({{started}}, '') as started_at, coalesce({{completed}}, '') as completed_at from (
  select user_id as document_id, arg_max({STATUS_CASE}, (ts, event_id)) as status, arg_max(case when event_type = 'error' then props else '' end, (ts, event_id)) as error,
  min(ts) filter (event_type = 'view') as s, max(ts) filter (event_type = 'purchase') as c from events group by user_id)""".format(
    started="strftime(s, '%Y-%m-%d %H:%M:%S.%f')", completed="strftime(c, '%Y-%m-%d %H:%M:%S.%f')"
)


def status_log(ev):
    marks = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    return ev.select(
        F.col("user_id").alias("document_id"), "ts", "event_id", F.try_element_at(marks, F.col("event_type")).alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).otherwise("").alias("error"),
    )


def status_out(df):
    return df.select("document_id", "status", "error", *[F.coalesce(text_ts(c), F.lit("")).alias(c) for c in ("started_at", "completed_at")])


@query("status_latest", STATUS_SQL)
def status_latest(spark, sf_dir):
    return status_out(mt.status_latest(status_log(b.events(spark, sf_dir))))


STAGES = {"signup": "parse", "view": "clean", "click": "chunk", "purchase": "embed", "error": "index"}


@query("stage_progress", """select document_id, case max(p) when 1 then 'parse' when 3 then 'clean' when 5 then 'chunk' when 7 then 'embed' else 'index' end as stage, max(p) / 10.0::double as progress, count(distinct p)::bigint as stages_done
  from (select user_id * 31 + day(ts) as document_id, case event_type when 'signup' then 1 when 'view' then 3 when 'click' then 5 when 'purchase' then 7 else 9 end as p from events) group by document_id""")
def stage_progress(spark, sf_dir):
    marks = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    log = b.events(spark, sf_dir).select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("document_id"), F.try_element_at(marks, F.col("event_type")).alias("stage"))
    return mt.stage_progress(log)


def sessions_sql(gap_hours: int = 1) -> str:
    return f"""select user_id, {sql_ts('min(ts)', 'session_start')}, {sql_ts(f'max(ts) + to_hours({gap_hours})', 'session_end')}, count(*)::bigint as events from (
      select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (
        select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= to_hours({gap_hours}) then 0 else 1 end as fresh from events)) group by user_id, s"""


@query("session_activity", sessions_sql())
def session_activity(spark, sf_dir):
    return mt.sessions(b.events(spark, sf_dir), "user_id").select("user_id", text_ts("session_start"), text_ts("session_end"), "events")


CACHE_SQL = """with recursive e as materialized (select event_type, event_id, ts, row_number() over (partition by event_type order by ts, event_id) as i from events),
  f as (select event_type, event_id, i, ts as stored, false as is_hit from e where i = 1
    union all select e.event_type, e.event_id, e.i, case when e.ts - f.stored < interval 1800 seconds then f.stored else e.ts end, e.ts - f.stored < interval 1800 seconds
    from f join e on e.event_type = f.event_type and e.i = f.i + 1)
  select event_type, event_id, is_hit from f"""


@query("cache_dedup", CACHE_SQL)
def cache_dedup(spark, sf_dir):
    return mt.cache_flags(b.events(spark, sf_dir), "event_type", "event_id", k.VECTOR_TTL).select("event_type", "event_id", "is_hit")
