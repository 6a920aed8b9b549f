"""Reuse stores, compaction by bytes, observed stages and the chunk table function."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomery.operators import chunk_table
from loomery.operators.chunking import chunk_text
from loomery.operators.progress import Stage, run_stages
from loomery.plans import chunk_plans
from loomery.session import scratch_dir
from loomery.sources import compaction
from loomery.sources.reuse import ReuseStore


def _asked(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, key string, text string")


def _upper(missing):
    return missing.withColumn("value", F.upper("text"))


def _values(df):
    return {(r["tenant_id"], r["key"]): (r["value"], r["stored_at"]) for r in df.collect()}


def test_second_run_computes_nothing(spark):
    store = ReuseStore(spark, scratch_dir(spark, "reuse"), StringType(), buckets=2)
    rows = [("a", "k1", "x"), ("a", "k1", "x"), ("b", "k1", "y"), ("a", "k2", "z"), ("a", None, "n"), (None, "k1", "n")]
    out, n = store.fill(_asked(spark, rows), _upper, 5)
    assert n == 3 and out.count() == len(rows)
    assert _values(out.where("key is not null and tenant_id is not null")) == {("a", "k1"): ("X", 5), ("b", "k1"): ("Y", 5), ("a", "k2"): ("Z", 5)}
    assert out.where("key is null or tenant_id is null").where("value is not null").count() == 0
    before = store.table.manifest().count()
    again, n = store.fill(_asked(spark, rows[:4] + [("a", "k3", "w")]), _upper, 9)
    assert n == 1 and _values(again)[("a", "k1")] == ("X", 5) and _values(again)[("a", "k3")] == ("W", 9)
    assert store.table.manifest().count() == before + 1  # nothing that was there is written again
    same, n = store.fill(_asked(spark, rows[:4]), _upper, 10)
    assert n == 0 and _values(same)[("b", "k1")] == ("Y", 5)
    empty, n = store.fill(_asked(spark, []), _upper, 10)
    assert n == 0 and empty.count() == 0


def test_old_results_are_computed_again(spark):
    store = ReuseStore(spark, scratch_dir(spark, "reuse"), StringType(), max_age=10, buckets=1)
    asked = _asked(spark, [("a", "k", "old")])
    store.fill(asked, _upper, 0)
    assert store.fill(asked, _upper, 9)[1] == 0
    out, n = store.fill(_asked(spark, [("a", "k", "new")]), _upper, 10)
    assert n == 1 and _values(out) == {("a", "k"): ("NEW", 10)}
    assert store.table.rows().count() == 2
    # the commits of a cell become one by a change that keeps its rows
    store.table.change(store.table.rows(), lambda old: old)
    assert store.table.manifest().count() == 1 and store.table.rows().count() == 2
    store.table.vacuum()
    assert _values(store.fresh(12)) == {("a", "k"): ("NEW", 10)}


@pytest.mark.parametrize("seed", range(3))
def test_groups_hold_half_to_twice_the_target(spark, seed):
    rnd, target = random.Random(seed), 1000
    sizes = [rnd.choice([rnd.randint(1, 499), rnd.randint(1, 60), rnd.randint(500, 2000), rnd.randint(2001, 9000)]) for _ in range(300)]
    files = [(f"/t/d{i % 3}/f{i}", s) for i, s in enumerate(sizes)] + [("/t/alone/f", 7)]
    planned = compaction.plan(spark.createDataFrame(files, "path string, length bigint"), target).collect()
    assert sorted((r["path"], r["length"]) for r in planned) == sorted(files)
    groups = defaultdict(list)
    for r in planned:
        if r["group"] is None:
            assert 500 <= r["length"] <= 2000 or r["path"] == "/t/alone/f"
        else:
            groups[r["group"]].append(r)
    for members in groups.values():
        if members[0]["pieces"] > 1:
            assert len(members) == 1 and 500 <= members[0]["length"] / members[0]["pieces"] <= 1000
        else:
            assert len({r["folder"] for r in members}) == 1 and 500 <= sum(r["length"] for r in members) <= 2000


def test_right_files_are_not_rewritten(spark):
    path, out = scratch_dir(spark, "files"), scratch_dir(spark, "packed")
    random_text = F.sha2(F.col("id").cast("string"), 512)  # does not compress, so bytes follow rows
    spark.range(0, 4000).select("id", random_text.alias("t")).repartition(40).write.parquet(path)
    spark.range(4000, 8000).select("id", random_text.alias("t")).coalesce(1).write.mode("append").parquet(path)
    spark.range(8000, 24000).select("id", random_text.alias("t")).coalesce(1).write.mode("append").parquet(path)
    sizes = {r["path"]: r["length"] for r in compaction.file_sizes(spark, path).collect()}
    target = sorted(sizes.values())[-2]  # the file of 4000 rows is right
    right = [p for p, s in sizes.items() if s == target]
    paths, planned = compaction.compact(spark, [path], out, target)
    assert right[0] in paths and planned.where("group is null").count() == 1
    assert sorted(r["id"] for r in spark.read.parquet(*paths).select("id").collect()) == list(range(24000))
    assert len(paths) < 8 and all(target / 2 <= r["length"] <= 2 * target for r in compaction.file_sizes(spark, *paths).collect())
    # compacted files are left as they are
    assert compaction.compact(spark, paths, scratch_dir(spark, "packed"), target)[1].where("group is not null").count() == 0


def test_packing_sorts_numbers_and_keeps_rows_in_order(spark, monkeypatch):
    path, out = scratch_dir(spark, "small"), scratch_dir(spark, "packed")
    spark.range(0, 3000).repartition(12).write.parquet(path)
    before = {f: [r["id"] for r in spark.read.parquet(f).collect()] for f in (r["path"] for r in compaction.file_sizes(spark, path).collect())}
    sorted_, by = [], type(spark.range(1)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", lambda df, *c: sorted_.append(dict(df.dtypes)) or by(df, *c))
    paths, _ = compaction.compact(spark, [path], out, 1 << 30)
    assert sorted_ and set(sorted_[0].values()) == {"bigint"}
    assert len(paths) == 1
    place = {x: n for n, x in enumerate(r["id"] for r in spark.read.parquet(*paths).collect())}
    assert sorted(place) == list(range(3000))
    for ids in before.values():
        at = [place[i] for i in ids]
        assert at == list(range(at[0], at[0] + len(at)))


def test_table_function_follows_the_fold(spark):
    rnd = random.Random(1)
    texts = ["", None, "  ", "one", "a\n\nb", "été naïve 12 ab1 你好 x_y", " pad \n\n　end "]
    texts += ["\n\n".join(" ".join(rnd.choice(["word", "你好世界", "x", "Zahl 17"]) for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunk_table.register(spark)
    for limits in ({}, {"min_tokens": 20, "max_tokens": 90, "min_overlap": 5, "max_overlap": 60}, {"min_tokens": 1, "max_tokens": 30, "min_overlap": 10**9}):
        args = "".join(f", {n} => {v}" for n, v in limits.items())
        got = spark.sql("select d.doc_id, c.* from {docs} d, lateral chunk_text(d.text" + args + ") c", docs=docs)
        want = chunk_text(docs, **limits).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stages_are_counted_while_stored(spark):
    stages = [
        Stage("halve", lambda d: d.where("id % 2 = 0"), {"rows": F.count("*"), "sum": F.sum("id")}),
        Stage("none", lambda d: d.where("id < 0"), {"rows": F.count("*"), "sum": F.sum("id")}),
    ]
    rows, counts = run_stages(spark.range(0, 100, 1, 7), stages)
    assert rows.count() == 0
    assert [tuple(r) for r in counts.orderBy("stage_no", "metric").collect()] == [(1, "halve", "rows", 50), (1, "halve", "sum", 2450), (2, "none", "rows", 0), (2, "none", "sum", 0)]


def test_a_text_without_words_has_no_vector_in_any_language(spark):
    root = scratch_dir(spark, "wordless")
    rows = [(1, "a ! ?", "en", "s"), (2, "two words", "en", "s"), (3, "- -", "de", "s"), (4, "zwei Worte", "de", "s"), (5, "two words", "en", "t"), (6, "zwei Worte", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{root}/documents.parquet")
    got = {r["doc_id"]: (r["was_pending"], r["has_vector"]) for r in chunk_plans.embed_pending(spark, root).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (True, False), 4: (True, True), 5: (False, True), 6: (None, True)}
