"""Contradictions between the top candidates of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import KEYWORD, let

TOP = 5
NUMBER = r"\d+\.?\d*"
DATE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"

# Substrings that count as negation.
NEGATIONS = ["不", "没有", "否", "不是", "no", "not", "never"]

# Claims and resolutions by conflict type.
NUMERIC_CLAIM = "数值差异: {} vs {}"
TEMPORAL_CLAIM = "时间差异: {} vs {}"
FACTUAL_CLAIM = "可能的陈述冲突"
RESOLUTIONS = {
    "numeric": "数值存在差异，建议核对原始文档",
    "temporal": "时间记载存在差异，建议参考最新版本",
    "factual": "陈述存在冲突，建议综合多方来源判断",
}


def _evidence(content: Column) -> Column:
    """What the checks need of one candidate, computed once per candidate."""
    low = F.lower(content)
    numbers = F.transform(F.regexp_extract_all(content, F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))
    large = F.filter(numbers, lambda x: x > 10)
    return F.struct(
        let(large, lambda n: F.struct(n.alias("all"), F.array_min(n).alias("lo"), F.array_max(n).alias("hi"))).alias("numbers"),
        F.regexp_extract(content, DATE, 0).alias("date"),
        F.rlike(low, F.lit("|".join(NEGATIONS))).alias("negated"),
        F.array_distinct(F.regexp_extract_all(low, F.lit(KEYWORD), F.lit(0))).alias("words"),
    )


def _claim(pattern: str, a: Column, b: Column) -> Column:
    head, mid, tail = pattern.split("{}")
    return F.concat(F.lit(head), a, F.lit(mid), b, F.lit(tail))


def _number_text(x: Column) -> Column:
    """Plain decimal text with at least one decimal place."""
    whole = F.concat(x.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when((x == F.floor(x)) & (x < 1e16), whole).when(x < 1e7, x.cast("string")).otherwise(
        F.rtrim(x.cast("decimal(38,6)").cast("string"), F.lit("0"))
    )


def pair_conflict(a: Column, b: Column) -> Column:
    """struct(type, claim, confidence) of the first check that fires, else null.

    ``a`` and ``b`` are evidence structs. Numbers conflict when they differ by
    more than half of the larger; the first such pair in text order is claimed.
    """

    def apart(x, y):
        return F.abs(x - y) > 0.5 * F.greatest(x, y)

    mine, theirs = a["numbers"], b["numbers"]

    # a number of ``a`` has a far partner exactly when the least or largest of ``b`` is far
    first = F.get(F.filter(mine["all"], lambda x: apart(x, theirs["lo"]) | apart(x, theirs["hi"])), F.lit(0))

    def numeric(x):
        y = F.get(F.filter(theirs["all"], lambda v: apart(x, v)), F.lit(0))
        return F.when(x.isNotNull(), _result("numeric", _claim(NUMERIC_CLAIM, _number_text(x), _number_text(y)), 0.6))

    dated = (a["date"] != "") & (b["date"] != "") & (a["date"] != b["date"])
    factual = (a["negated"] != b["negated"]) & (F.size(F.array_intersect(a["words"], b["words"])) > 3)
    return F.coalesce(
        let(first, numeric),
        F.when(dated, _result("temporal", _claim(TEMPORAL_CLAIM, a["date"], b["date"]), 0.5)),
        F.when(factual, _result("factual", F.lit(FACTUAL_CLAIM), 0.4)),
    )


def _result(kind: str, claim: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("type"), claim.alias("claim"), F.lit(confidence).alias("confidence"))


def resolution(kind: Column) -> Column:
    out = None
    for name, text in RESOLUTIONS.items():
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out


def detect_conflicts(candidates: DataFrame, order: str = "final_rank", top: int = TOP) -> DataFrame:
    """One row per conflicting pair among the first ``top`` candidates of a query.

    The few top rows of a query are gathered once (at most ``top`` of them) and
    paired inside that row.
    """
    best = candidates.where(F.col(order) <= top).select(
        "query_id", F.struct(F.col(order).alias("place"), "chunk_id", _evidence(F.coalesce("content", F.lit(""))).alias("e")).alias("c")
    )
    rows = best.groupBy("query_id").agg(F.array_sort(F.collect_list("c"), lambda x, y: x["place"] - y["place"]).alias("cs"))

    def against(x, i):
        later = F.slice("cs", i + 2, F.lit(top))
        return F.transform(
            later,
            lambda y: F.struct(
                x["chunk_id"].cast("string").alias("supporting"), y["chunk_id"].cast("string").alias("contradicting"), pair_conflict(x["e"], y["e"]).alias("r")
            ),
        )

    pairs = F.flatten(F.transform("cs", against))
    out = rows.select("query_id", F.explode(F.filter(pairs, lambda p: p["r"].isNotNull())).alias("p"))
    return out.select(
        "query_id", "p.r.type", "p.r.claim", "p.supporting", "p.contradicting", "p.r.confidence", resolution(F.col("p.r.type")).alias("resolution")
    )
