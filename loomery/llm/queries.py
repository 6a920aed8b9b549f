"""The operators of this package over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import (
    decontamination,
    importance_resampling,
    language_id,
    lm_scoring,
    minhash_dedup,
    packing,
    quality,
    substring_dedup,
    token_counts,
    topk_search,
    toxicity,
    warc_fixity,
    whitening,
)
from loomery.llm.common import fold
from loomery.llm.registry import documents, query

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.ambiguous").alias("ambiguous"),
    )


@query("op6_vector_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


def _labelled(spark: SparkSession, sf_dir: str, label: str, folds: int, held: int) -> tuple[DataFrame, DataFrame]:
    """(documents, training rows with the label)."""
    docs = documents(spark, sf_dir, "doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("label")).where(fold("doc_id", folds) != held)
    return docs, docs.join(labels, "doc_id")


@query("op8_quality_factorisation_machine")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labelled = _labelled(spark, sf_dir, "quality", 5, 0)
    machine = quality.train(labelled)
    return quality.score(docs, machine).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op10_toxicity_multiple_instance")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labelled = _labelled(spark, sf_dir, "toxic", 3, 1)
    model = toxicity.train(labelled)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"),
        F.col("toxicity.sentences").alias("n_sentences"),
        F.col("toxicity.offending").alias("offending"),
    )


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op5_minhash_bayes_dedup",
    f"""
with recursive words as (select doc_id, {_WORDS.format(_LOWERED)} as ws from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(ws) > 1
    then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) as g from words)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as label from documents union select e.b, r.label from r join e on e.a = r.node),
c as (select node, min(label) as component_id from r group by node)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join c on c.node = d.doc_id left join n on n.doc_id = d.doc_id
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=2, percent=80)


@query(
    "op4_substring_automata",
    r"""
with t as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, generate_subscripts(ws, 1) as i, unnest(ws) as w from t),
v as (select doc_id, i, w, case when lead(i, 12) over (partition by doc_id order by i) is not null
    then string_agg(w, ' ') over (partition by doc_id order by i rows between current row and 12 following) end as g from w),
f as (select g, min(doc_id) as first_doc from v where g is not null group by g),
h as (select v.doc_id, v.i, v.w, coalesce(max((f.first_doc < v.doc_id)::int)
    over (partition by v.doc_id order by v.i rows between 12 preceding and current row), 0) as gone from v left join f on f.g = v.g),
k as (select doc_id, sum(gone) as n_removed, string_agg(w, ' ' order by i) filter (where gone = 0) as kept from h group by doc_id)
select t.doc_id, coalesce(len(ws), 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from t left join k on k.doc_id = t.doc_id
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut(documents(spark, sf_dir, "doc_id", "text"), window=13).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


@query("op3_decontamination_alignment")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.leaks(documents(spark, sf_dir, "doc_id", "text"), items)


@query("op9_lm_context_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model, vocabulary, totals = lm_scoring.train(docs.where(fold("doc_id", 10) != 0))
    scored = lm_scoring.score(docs, model, vocabulary, totals)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


_TERMS = "regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op2_bm25_block_max",
    f"""
with d as (select doc_id, unnest({_TERMS}) as w from documents where text is not null and doc_id is not null),
tf as (select doc_id, w, count(*) as c from d group by all),
size as (select doc_id, coalesce(len({_TERMS}), 0) as n from documents where doc_id is not null),
whole as (select count(*) as n, avg(n) as mean from size),
df as (select w, count(*) as n from tf group by w),
q as (select doc_id as item_id, w, c from tf where doc_id % 20 = 0),
scored as (
  select q.item_id, tf.doc_id, round(sum(q.c * ln(1 + (whole.n - df.n + 0.5) / (df.n + 0.5)) * tf.c * 2.2
      / (tf.c + 1.2 * (0.25 + 0.75 * size.n / whole.mean))), 6) as score
  from q join tf using (w) join df using (w) join size using (doc_id), whole group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored)
select item_id as query_id, rank::int as rank, doc_id, score from ranked where rank <= 10 and score > 0
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 as a query, against all documents."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return topk_search.search(topk_search.build_index(docs), asked, k=10)


PAGES_PER_FILE = 1000


def _archive(pages: DataFrame) -> DataFrame:
    """number and bytes of pages as records of files of PAGES_PER_FILE."""
    number = F.floor(F.col("page_id") / PAGES_PER_FILE) * warc_fixity.PER_FILE + F.col("page_id") % PAGES_PER_FILE
    return pages.select(number.cast("long").alias("number"), warc_fixity.record(F.col("url"), F.col("html"), F.col("page_id")).alias("bytes"))


@query(
    "op7_warc_merkle_fixity",
    f"""
with r as (
  select page_id, html, page_id // {PAGES_PER_FILE} as file, (page_id // {PAGES_PER_FILE}) * {warc_fixity.PER_FILE} + page_id % {PAGES_PER_FILE} as number,
    59 + length(page_id::varchar) + 20 + strlen(coalesce(url, '')) + 18 + length(strlen(coalesce(html, ''))::varchar) + 4 + strlen(coalesce(html, '')) + 4 as size
  from pages),
o as (select *, coalesce(sum(size) over (partition by file order by number rows between unbounded preceding and 1 preceding), 0) as "offset" from r),
f as (
  select *, case when page_id % 211 = 7 then 'missing' when page_id % 97 = 13 and translate(html, 'aeiou', 'eioua') <> html then 'altered'
      when page_id % 307 = 11 then 'resized' end as fault from o)
select file::bigint as file, number::bigint as number, "offset"::bigint as "offset", size::bigint as length_a,
  case fault when 'missing' then null when 'altered' then size else size + 1
    + length((strlen(coalesce(html, '')) + 1)::varchar) - length(strlen(coalesce(html, ''))::varchar) end::bigint as length_b, fault
from f where fault is not null
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, against a replica of them in which some records rotted."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rotten = pages.where(F.coalesce(F.col("page_id") % 211 != 7, F.lit(True))).withColumn(
        "html",
        F.when(F.col("page_id") % 97 == 13, F.translate("html", "aeiou", "eioua"))
        .when(F.col("page_id") % 307 == 11, F.concat(F.coalesce("html", F.lit("")), F.lit(" ")))
        .otherwise(F.col("html")),
    )
    return warc_fixity.audit(_archive(pages), _archive(rotten))


@query("op11_whitening_qdwh")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)


@query("op12_token_counts_rank_synchronous")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return token_counts.with_token_counts(docs, public_tokenizers.path(PIECES), TOKEN_LIMIT).select("doc_id", "tokens.n_bytes", "tokens.n_tokens", "tokens.over_limit")


# crc32 of each distinct word by its bytes, with a table from the polynomial
_CRC_BYTES = "list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::bigint)"


@query(
    "op13_importance_resampling",
    f"""
with rule as (select list(c order by n) as t from (select n, list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from range(256) r(n))),
dw as (select doc_id, unnest({_TERMS.replace("lower(text)", _LOWERED)}) as w from documents),
tw as (select unnest({_TERMS.replace("lower(text)", _LOWERED)}) as w from benchmark),
words as (select w, xor(4294967295, list_reduce(list_prepend(4294967295, {_CRC_BYTES}),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 as bucket from (select w from dw union select w from tw), rule),
s as (select bucket, count(*) as n from dw join words using (w) group by bucket),
t as (select bucket, count(*) as n from tw join words using (w) group by bucket),
whole as (select coalesce((select sum(n) from s), 0) as s_all, coalesce((select sum(n) from t), 0) as t_all),
gains as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * (s_all + 10000) / ((coalesce(s.n, 0) + 1.0::double) * (t_all + 10000))))::bigint as gain
  from s full join t using (bucket), whole),
sums as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from dw join words using (w) join gains using (bucket) group by doc_id),
noise as (select doc_id, floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as noise from documents),
scored as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, (coalesce(weight, 0) + noise)::bigint as score
  from noise left join sums using (doc_id)),
able as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20)
select scored.*, case when rank <= n * 10 // 100 then rank end as rank from scored left join able using (doc_id)
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    drawn = importance_resampling.resample(documents(spark, sf_dir, "doc_id", "text"), target, runs=1, buckets=10_000, seed=2024, least_words=20, percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
