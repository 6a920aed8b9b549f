"""Text cleaning, token counting and hashing as Column expressions.

Everything stays in the JVM. ``(?U)`` gives the word, space and digit classes
their Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that count as page headers or footers.
HEADER_LINE_WHOLE = [r"Page \d+", r"第\s*\d+\s*页", r"\d+\s*/\s*\d+"]
HEADER_LINE_PREFIX = [r"\d{4}-\d{2}-\d{2}", r"Copyright", r"版权"]

# Markers removed by the optional noise pass.
NOISE_PATTERNS = [r"\[\d+\]", r"\(见图\s*\d+\)", r"\(见表\s*\d+\)"]

# One or more capitalised words. The repetition is possessive (each word ends at
# a boundary of its own), so a run of any length is matched without recursion.
CAPS_RUN = r"(?U)\b[A-Z][a-z]+\b(?:\s+[A-Z][a-z]+\b)*+"
QUOTED = r'"([^"]+)"'
LONG_NUMBER = r"(?U)\b\d{3,}\b"
CJK_RUN = r"[一-鿿]{2,4}"
WORD = r"[a-z0-9_\p{L}\p{N}]{2,}"  # what is frequent is tried first
KEYWORD = r"[\p{L}\p{N}_]{3,}"

_INLINE = r"[^\S\n]*"


def _on_line(pattern: str) -> str:
    """Keep a line pattern from running over the end of its line."""
    return pattern.replace(r"\s*", _INLINE)


_HEADER_LINE = (
    _INLINE
    + "(?:(?:"
    + "|".join(_on_line(p) for p in HEADER_LINE_WHOLE)
    + f"){_INLINE}|(?:"
    + "|".join(HEADER_LINE_PREFIX)
    + r")[^\n]*)"
)
_HEADER_CONTENT = "(?Ui)^(?:(?:" + "|".join(HEADER_LINE_WHOLE) + ")$|" + "|".join(HEADER_LINE_PREFIX) + ")"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind.

    The look-behind (here and below) lets a match start only where a run of
    white space starts: one pass over runs of any length.
    """
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+\z", "")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(c, r"(?U)(?<![^\S\n])[^\S\n]+(\n|\z)", "$1")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def strip_header_footer_lines(c: Column) -> Column:
    """Blank the first and the last line when they look like page furniture."""
    c = F.regexp_replace(c, r"(?Ui)\A" + _HEADER_LINE + r"(?=\n|\z)", "")
    return F.regexp_replace(c, r"(?Ui)(\A|\n)" + _HEADER_LINE + r"\z", "$1")


def strip_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\n\s*\d+\s*\n", "\n")


def space_punctuation(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)(?<!\s)\s+([.,;:!?])", "$1")
    return F.regexp_replace(c, r"(?U)([.,;:!?])([^\s\d])", "$1 $2")


def strip_charset(c: Column) -> Column:
    """Keep printable ASCII, line ends and CJK; accented letters go too.

    Most characters end at the first class; one class of all three costs ten times as much.
    """
    return F.regexp_replace(c, r"[^\x20-\x7E](?<![\n\r一-鿿])", "")


def strip_noise(c: Column) -> Column:
    return F.regexp_replace(c, "|".join(NOISE_PATTERNS), "")


def clean_text(c: Column, keep_unicode: bool = False, drop_noise: bool = False) -> Column:
    for step in (normalize_whitespace, collapse_newlines, strip_header_footer_lines, strip_page_numbers, space_punctuation):
        c = step(c)
    if drop_noise:
        c = strip_noise(c)
    if not keep_unicode:
        c = strip_charset(c)
    return strip(c)


def clean_table(c: Column) -> Column:
    c = F.regexp_replace(c, r"\|+", "|")
    c = F.regexp_replace(c, r"(?U)\|\s*\|", "|")
    lines = F.filter(F.split(c, "\n"), lambda line: F.contains(line, F.lit("|")))
    return F.array_join(F.transform(lines, lambda line: pipe_row(_cells(line))), "\n")


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")


def pipe_row(cells: Column) -> Column:
    """``array<string>`` of cells -> ``| a | b |``."""
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def pipe_table(rows: Column) -> Column:
    """``array<array<string>>`` -> one pipe row per line, cells trimmed."""
    return F.array_join(F.transform(rows, lambda r: pipe_row(F.transform(r, strip))), "\n")


def dash_list(items: Column) -> Column:
    """``array<string>`` -> one ``- item`` per line, empty items dropped."""
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")


def clean_formula(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_content(c: Column, section_type: Column, keep_unicode: bool = False) -> Column:
    return (
        F.when(section_type == "table", clean_table(c))
        .when(section_type == "formula", clean_formula(c))
        .otherwise(clean_text(c, keep_unicode))
    )


def is_header_content(c: Column) -> Column:
    return F.rlike(strip(c), F.lit(_HEADER_CONTENT))


def header_footer_flags(content: Column, top_y: Column, page_height: Column) -> tuple[Column, Column]:
    """(is_header, is_footer). Without a position both are false."""
    placed = top_y.isNotNull() & (F.coalesce(page_height, F.lit(0.0)) != 0)
    by_text = is_header_content(content)
    header = placed & ((top_y < page_height * 0.15) | by_text)
    footer = placed & ((top_y > page_height * 0.85) | by_text)
    return header, footer


def estimate_tokens(c: Column) -> Column:
    """Wide characters + ASCII words + a quarter of the narrow characters."""
    # wide + narrow // 4 == length - ceil(3 * narrow / 4): one pass for each pattern, none
    # for a text of single bytes
    narrow = F.when(F.length(c) == F.octet_length(c), F.length(c)).otherwise(F.length(F.regexp_replace(c, r"[^\x00-\xff]+", "")))
    words = F.regexp_count(c, F.lit(r"(?U)\b[a-zA-Z]++\b"))
    return (F.length(c) + words - F.floor((narrow * 3 + 3) / 4)).cast("int")


def count_tokens(c: Column) -> Column:
    """Model-side token count: two CJK or four other characters per token."""
    n = F.length(c)
    cjk = n - F.length(F.regexp_replace(c, "[一-鿿]", ""))
    return F.greatest(F.lit(1), F.floor(cjk / 2) + F.floor((n - cjk) / 4)).cast("int")


def tokens(c: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))  # possessive: no steps are kept to go back


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.concat_ws("_", document_id.cast("string"), chunk_index.cast("string"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(words: Column) -> Column:
    """``array<string>`` -> ``array<struct<term, tf>>`` without leaving the row.

    Sort, then take the distance between the places where the word changes.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1))))
        )
        return let(
            F.concat(starts, F.array(n + 1)),
            lambda b: F.transform(
                F.slice(b, F.lit(1), F.size(b) - 1),
                lambda p, j: F.struct(F.element_at(s, p).alias("term"), (F.element_at(b, j + 2) - p).alias("tf")),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(words) == 0, empty).otherwise(let(F.sort_array(words), runs))


def entity_set(c: Column) -> Column:
    """Distinct capitalised runs, long numbers and CJK runs."""
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(c, F.lit(CAPS_RUN), F.lit(0)),
            F.regexp_extract_all(c, F.lit(LONG_NUMBER), F.lit(0)),
            F.regexp_extract_all(c, F.lit(CJK_RUN), F.lit(0)),
        )
    )
