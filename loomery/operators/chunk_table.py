"""Chunking as a table function, to be called from SQL.

``register(spark)`` makes ``chunk_text`` known to the session:

    select d.doc_id, c.* from documents d, lateral chunk_text(d.text, separator => '\n') c

``separator`` is a pattern, its classes are Unicode's. It follows the rules of :func:`loomery.operators.chunking.chunk_text` for plain text. A
call sees one document; Spark deals the rows to tasks and sends them in Arrow batches.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomery import constants as k
from loomery.sources.sections import PARAGRAPH_BREAK

_WORD = regex.compile(r"(?<![\w\p{M}\p{Pc}\u200c\u200d])[a-zA-Z]+(?![\w\p{M}\p{Pc}\u200c\u200d])")
_WIDE = regex.compile(r"[^\x00-\xff]+")
_EDGES = regex.compile(r"\A\p{White_Space}+|(?<!\p{White_Space})\p{White_Space}+\Z")
RETURNS = "chunk_index int, content string, token_count int, content_hash string"


def estimate(text: str) -> int:
    narrow = len(_WIDE.sub("", text))
    return len(text) + len(_WORD.findall(text)) - (narrow * 3 + 3) // 4


def runs(tokens: list[int], min_tokens: int, max_tokens: int, min_overlap: int, max_overlap: int) -> list[tuple[int, int]]:
    """Sections as runs (first, end): a run ends before the section that takes it over
    ``max_tokens``, and the next begins with up to three of its sections."""
    out, first, held = [], 0, 0
    for i, t in enumerate(tokens):
        if i > first and held >= min_tokens and held + t > max_tokens:
            out.append((first, i))
            back, kept = 0, 0
            while back < min(k.OVERLAP_MAX_PARTS, i - first) and kept + tokens[i - back - 1] <= max_overlap:
                back += 1
                kept += tokens[i - back]
            if kept < min_overlap:
                back, kept = 0, 0
            first, held = i - back, kept
        held += t
    return out + [(first, len(tokens))] if tokens else out


class ChunkText:
    def eval(
        self,
        text: str,
        separator: str = PARAGRAPH_BREAK,
        min_tokens: int = k.CHUNK_MIN_TOKENS,
        max_tokens: int = k.CHUNK_MAX_TOKENS,
        min_overlap: int = k.OVERLAP_MIN_TOKENS,
        max_overlap: int = k.OVERLAP_MAX_TOKENS,
    ):
        parts = [p for p in (_EDGES.sub("", x) for x in regex.split(separator.replace("(?U)", ""), text or "")) if p]
        for no, (first, end) in enumerate(runs([estimate(p) for p in parts], min_tokens, max_tokens, min_overlap, max_overlap)):
            content = _EDGES.sub("", "\n\n".join(parts[first:end]))
            yield no, content, estimate(content), hashlib.sha256(content.encode()).hexdigest()


def register(spark: SparkSession, name: str = "chunk_text") -> None:
    spark.udtf.register(name, udtf(ChunkText, returnType=RETURNS, useArrow=True))
