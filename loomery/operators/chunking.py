"""Sections -> chunks, folded inside the document row.

A chunk is always a contiguous run of sections (overlap only moves its start
back), so the fold carries section numbers and token sums, never texts; the
texts are sliced out once at the end. No shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import constants as k
from loomery.functions.text import (
    chunk_id,
    clean_content,
    content_hash,
    estimate_tokens,
    header_footer_flags,
    let,
    strip,
)
from loomery.session import materialize
from loomery.sources.sections import PARAGRAPH_BREAK, text_sections

_RUN = "struct<first:int,last:int,kind:string,page:int,head:int>"


def clean_sections(sections: Column, keep_unicode: bool = False) -> Column:
    """Drop short page furniture, clean the rest, drop what became empty.

    Adds the flags ``was_header`` and ``was_footer``.
    """

    def one(s: Column) -> Column:
        header, footer = header_footer_flags(s["content"], s["top_y"], s["page_height"])
        cleaned = clean_content(s["content"], s["section_type"], keep_unicode)
        short = (header | footer) & (F.length(strip(s["content"])) < 50)
        return F.struct(
            F.when(~short, cleaned).alias("content"),
            *[s[f].alias(f) for f in ("page_number", "section_type", "heading_level", "heading_text", "top_y", "page_height")],
            header.alias("was_header"),
            footer.alias("was_footer"),
        )

    return F.filter(F.transform(sections, one), lambda s: F.coalesce(s["content"], F.lit("")) != "")


def fold_runs(
    sections: Column,
    boundaries: Column | None = None,
    min_tokens: int = k.CHUNK_MIN_TOKENS,
    max_tokens: int = k.CHUNK_MAX_TOKENS,
    min_overlap: int = k.OVERLAP_MIN_TOKENS,
    max_overlap: int = k.OVERLAP_MAX_TOKENS,
) -> Column:
    """Array of runs ``(first, last, kind, page, head)``; ``head`` is the section
    that gives the heading text, 0 for none.

    ``boundaries``: ``array<boolean>``, true where a section breaks off from the
    one before it; None switches the semantic test off.
    """

    def run(first, last, kind, page, head):
        return F.array(
            F.struct(
                first.alias("first"), last.alias("last"), kind.alias("kind"), page.cast("int").alias("page"), head.cast("int").alias("head")
            )
        )

    none = F.array().cast(f"array<{_RUN}>")

    def state(start, n, tokens, page, head, out):
        return F.struct(
            start.cast("int").alias("start"), n.cast("int").alias("n"), tokens.cast("int").alias("tokens"),
            page.cast("int").alias("page"), head.cast("int").alias("head"), out.alias("out"),
        )

    def flushed(acc, last):
        return F.when(
            acc["n"] > 0, F.concat(acc["out"], run(acc["start"], last, F.lit("text"), acc["page"], acc["head"]))
        ).otherwise(acc["out"])

    def atomic(acc, x):
        own = run(x["i"], x["i"], x["kind"], x["page"], x["i"])
        return state(x["i"], F.lit(0), F.lit(0), acc["page"], acc["head"], F.concat(flushed(acc, x["i"] - 1), own))

    def heading(acc, x):
        return state(x["i"], F.lit(1), x["t"], x["page"], x["i"], flushed(acc, x["i"] - 1))

    def text(acc, x):
        over = acc["tokens"] + x["t"] > max_tokens
        cut = (acc["n"] > 0) & ((x["edge"]) | (over & (acc["tokens"] >= min_tokens)))
        parts = sum(
            ((acc["n"] >= j) & (x[f"c{j}"] <= max_overlap)).cast("int") for j in range(1, k.OVERLAP_MAX_PARTS + 1)
        )
        kept = F.when(parts == 3, x["c3"]).when(parts == 2, x["c2"]).when(parts == 1, x["c1"]).otherwise(0)
        page = F.coalesce(acc["page"], F.when(x["page"] != 0, x["page"]))

        def step(d):
            start = F.when(d["cut"], x["i"] - d["m"]).when(acc["n"] == 0, x["i"]).otherwise(acc["start"])
            n = F.when(d["cut"], d["m"] + 1).otherwise(acc["n"] + 1)
            tokens = F.when(d["cut"], d["kept"]).otherwise(acc["tokens"]) + x["t"]
            out = F.when(d["cut"], flushed(acc, x["i"] - 1)).otherwise(acc["out"])
            return state(start, n, tokens, page, acc["head"], out)

        use = kept >= min_overlap
        decision = F.struct(
            cut.alias("cut"), F.when(use, parts).otherwise(0).alias("m"), F.when(use, kept).otherwise(0).alias("kept")
        )
        return let(decision, step)

    def merge(acc, x):
        return F.when(x["kind"].isin("table", "formula"), atomic(acc, x)).when(x["kind"] == "heading", heading(acc, x)).otherwise(text(acc, x))

    def finish(total):
        return lambda acc: flushed(acc, total)

    def folded(tok: Column) -> Column:
        def back(i, j):  # tokens of the j sections before section i (0-based)
            return F.aggregate(
                F.slice(tok, F.greatest(i - j + 1, F.lit(1)), F.least(i, F.lit(j))), F.lit(0), lambda a, t: a + t
            )

        def item(s, i):
            kind = (
                F.when(s["section_type"].isin("table", "formula"), s["section_type"])
                .when((s["section_type"] == "heading") & (F.coalesce(s["heading_level"], F.lit(0)) != 0), "heading")
                .otherwise("text")
            )
            edge = F.coalesce(F.get(boundaries, i), F.lit(False)) if boundaries is not None else F.lit(False)
            return F.struct(
                (i + 1).alias("i"), kind.alias("kind"), F.element_at(tok, i + 1).alias("t"), s["page_number"].alias("page"),
                edge.alias("edge"), *[back(i, j).alias(f"c{j}") for j in (1, 2, 3)],
            )

        zero = state(F.lit(1), F.lit(0), F.lit(0), F.lit(None), F.lit(0), none)
        return F.aggregate(F.transform(sections, item), zero, merge, finish(F.size(sections)))

    return let(F.transform(sections, lambda s: estimate_tokens(s["content"])), folded)


def chunk_sections(
    df: DataFrame,
    sections: str = "sections",
    boundaries: str | None = None,
    document_id: str = "doc_id",
    **limits,
) -> DataFrame:
    """One row per chunk. ``df`` keeps its other columns (drop texts first)."""
    keep = [c for c in df.columns if c not in (sections, boundaries)]
    s = F.col(sections)
    runs = fold_runs(s, F.col(boundaries) if boundaries else None, **limits)

    def chunk(r, i):
        parts = F.transform(F.slice(s, r["first"], r["last"] - r["first"] + 1), lambda p: p["content"])
        return F.struct(
            i.alias("chunk_index"),
            r["page"].alias("page_number"),
            r["kind"].alias("chunk_type"),
            F.when(r["head"] > 0, F.get(s, r["head"] - 1)["heading_text"]).alias("heading_text"),
            strip(F.array_join(parts, "\n\n")).alias("content"),
        )

    out = df.withColumn("_runs", runs).select(*keep, F.explode(F.transform("_runs", chunk)).alias("_c")).select(*keep, "_c.*")
    return out.withColumns(
        {
            "chunk_id": chunk_id(F.col(document_id), F.col("chunk_index")),
            "token_count": estimate_tokens(F.col("content")),
            "content_hash": content_hash(F.col("content")),
        }
    )


def chunk_text(
    df: DataFrame, text: str = "text", separator: str = PARAGRAPH_BREAK, document_id: str = "doc_id", clean: bool = False,
    encoder=None, threshold: float = k.BOUNDARY_THRESHOLD, **limits,
) -> DataFrame:
    """Plain text -> chunks; ``encoder`` switches semantic boundaries on."""
    sections = text_sections(F.col(text), separator)
    if clean:
        sections = clean_sections(sections)
    out = df.withColumn("sections", sections).drop(text)
    if encoder is None:
        return chunk_sections(out, document_id=document_id, **limits)
    from loomery.operators.embedding import adjacent_similarity

    contents = F.transform("sections", lambda s: s["content"])
    out = out.withColumn("_edges", detect_boundaries(adjacent_similarity(encoder)(contents), threshold))
    return chunk_sections(out, boundaries="_edges", document_id=document_id, **limits)


def detect_boundaries(similarities: Column, threshold: float = k.BOUNDARY_THRESHOLD) -> Column:
    """``array<double>`` of similarities to the section before -> ``array<boolean>``."""
    return F.transform(similarities, lambda v: F.coalesce(v < threshold, F.lit(False)))


def dedup_chunks(chunks: DataFrame, keys=("tenant_id", "content_hash"), order: str = "chunk_id") -> DataFrame:
    """Keep the chunk with the least id of every group of copies.

    Only ids and keys are aggregated (combined map-side, so a huge group of
    copies is no hot key); the survivors come back by a join on the unique id.
    """
    chunks = materialize(chunks, "chunks")  # folded and hashed once, read twice
    first = chunks.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return chunks.join(first, order, "left_semi")


def preprocess_rollup(chunks: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Per document: pages, chunks and tokens."""
    return chunks.groupBy(*keys).agg(
        F.max("page_number").cast("bigint").alias("total_pages"),
        F.count("*").alias("total_chunks"),
        F.sum("token_count").cast("bigint").alias("total_tokens"),
    )
