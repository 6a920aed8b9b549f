"""Splitting, cleaning and counting of texts over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.plans import bindings as b
from loomery.plans.registry import query
from loomery.session import spread, table
from loomery.sources import sections as sx

STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+\z', '')"


def sql_strip(x: str) -> str:
    return STRIP.format(x)


def sql_clean(x: str) -> str:
    """The cleaning chain in SQL; first and last line by list position."""
    header = r"(?i)^(Page \d+$|第\s*\d+\s*页$|\d+\s*/\s*\d+$|\d{4}-\d{2}-\d{2}|Copyright|版权)"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '[^\S\n]+(\n|\z)', '\1', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', E'\n\n', 'g')"
    x = rf"""(select array_to_string(list_transform(l, lambda s, i: case when (i = 1 or i = len(l))
        and regexp_matches({sql_strip('s')}, '{header}') then '' else s end), chr(10)) from (select string_split({x}, chr(10)) as l))"""
    x = rf"regexp_replace({x}, '\n\s*\d+\s*\n', E'\n', 'g')"
    x = rf"regexp_replace({x}, '\s+([.,;:!?])', '\1', 'g')"
    x = rf"regexp_replace({x}, '([.,;:!?])([^\s\d])', '\1 \2', 'g')"
    x = rf"regexp_replace({x}, '[^\x20-\x7E\n\r一-鿿]', '', 'g')"
    return sql_strip(x)


# Non-ASCII letters become word characters that no ASCII pattern matches, so
# ASCII word boundaries fall where Unicode ones do.
def sql_ascii_words(x: str) -> str:
    return rf"regexp_replace({x}, '[^\x00-\x7F\P{{L}}]', '_', 'g')"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def sql_estimate(x: str) -> str:
    wide = rf"(length({x}) - length(regexp_replace({x}, '[^\x00-\x{{ff}}]', '', 'g')))"
    words = rf"len(regexp_extract_all({sql_ascii_words(x)}, '\b[a-zA-Z]+\b'))"
    return f"({wide} + {words} + (length({x}) - {wide}) // 4)"


SECTIONS_SQL = rf"""
select tenant_id, doc_id, (row_number() over (partition by doc_id order by i) - 1)::bigint as section_index, content,
  case when ends_with(content, ':') and length(content) < 100 then 2
       when regexp_matches(content, '\p{{Lu}}') and not regexp_matches(content, '[\p{{Ll}}\p{{Lt}}]') and length(content) < 50 then 1
  end as heading_level
from (select source as tenant_id, doc_id, {sql_strip('p')} as content, i
      from (select source, doc_id, unnest(string_split(text, chr(10))) as p,
              generate_subscripts(string_split(text, chr(10)), 1) as i from documents))
where content <> ''
"""


def _level():
    return F.coalesce("heading_level", F.lit(0)).cast("bigint").alias("heading_level")


@query("sections_txt", f"select tenant_id, doc_id, section_index, content, coalesce(heading_level, 0)::bigint as heading_level, 1::bigint as page_number from ({SECTIONS_SQL})")
def sections_txt(spark, sf_dir):
    docs = b.documents(spark, sf_dir).select("tenant_id", "doc_id", sx.text_sections(F.col("text"), "\n").alias("sections"))
    return sx.explode_sections(docs).select(
        "tenant_id", "doc_id", F.col("section_index").cast("bigint"), "content",
        _level(), F.col("page_number").cast("bigint"),
    )


@query("html_sections")
def html_sections(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", sx.parse_html("html").alias("h"))
    return sx.explode_sections(pages.select("page_id", "h.title", "h.sections")).select(
        "page_id", "title", "section_index", "section_type", "heading_level", "heading_text", "content"
    )


@query(
    "table_pipe_text",
    f"""select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda r: '| ' || array_to_string(
      list_transform(string_split(r, ','), lambda c: {sql_strip('c')}), ' | ') || ' |'), chr(10)) as content from documents""",
)
def table_pipe_text(spark, sf_dir):
    rows = F.transform(F.split("text", "\n"), lambda r: F.split(r, ","))
    return b.documents(spark, sf_dir).select("doc_id", tx.pipe_table(rows).alias("content"))


@query(
    "list_dash_text",
    f"""select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, '.'), lambda s: {sql_strip('s')}),
      lambda s: s <> ''), lambda s: '- ' || s), chr(10)) as content from documents""",
)
def list_dash_text(spark, sf_dir):
    return b.documents(spark, sf_dir).select("doc_id", tx.dash_list(F.split("text", r"\.")).alias("content"))


@query(
    "layout_sections",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
    s as (select doc_id, i, {sql_strip("line")} as content, 9 + (doc_id + i) % 8 as size, (i % 10) * 100 as top_y, i // 10 + 1 as page from l)
    select doc_id, page::bigint as page_number, content, (case when size > 14 then 1 when size > 12 then 2 else 0 end)::bigint as heading_level,
      case when size > 14 then content end as heading_text, top_y::double as top_y from s where content <> ''""",
)
def layout_sections(spark, sf_dir):
    """Each line as a one-line block, ten blocks a page, font size by position."""

    def block(line, i):
        size = (F.col("doc_id") + i) % 8 + 9
        spans = F.array(
            F.struct(F.substring(line, 1, 20).alias("text"), size.alias("size")),
            F.struct(F.substring(line, F.lit(21), F.length(line)).alias("text"), F.lit(8).cast("bigint").alias("size")),
        )
        return F.struct(
            F.floor(i / 10).cast("int").alias("page"), F.lit(1000.0).alias("page_height"),
            ((i % 10) * 100).cast("double").alias("top_y"), F.array(spans).alias("lines"),
        )

    blocks = F.transform(F.split("text", "\n"), block)
    docs = b.documents(spark, sf_dir).select("doc_id", blocks.alias("blocks")).select("doc_id", sx.layout_sections(F.col("blocks")).alias("sections"))
    return sx.explode_sections(docs).select(
        "doc_id", F.col("page_number").cast("bigint"), "content", _level(), "heading_text", "top_y"
    )


STYLES = ["Title", "Heading 1", "Normal", "Heading 3", "List Paragraph", "Body Text 2"]


@query(
    "styled_sections",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
    s as (select doc_id, i, {sql_strip("line")} as content, {STYLES!r}[(i % 6)::int + 1] as style from l),
    k as (select *, case when style = 'Title' then 1 when starts_with(style, 'Heading') then regexp_extract(style, '([0-9]+)$', 1)::int end as lvl
          from s where content <> '')
    select doc_id, content, coalesce(lvl, 0)::bigint as heading_level, case when lvl is null then 'paragraph' else 'heading' end as section_type from k
    union all select doc_id, '| ' || doc_id || ' | ' || source || ' |', 0, 'table' from documents""",
)
def styled_sections(spark, sf_dir):
    styles = F.array(*[F.lit(s) for s in STYLES])
    paragraphs = F.transform(
        F.split("text", "\n"), lambda line, i: F.struct(line.alias("text"), F.get(styles, i % 6).alias("style"))
    )
    tables = F.array(F.array(F.array(F.col("doc_id").cast("string"), F.col("tenant_id"))))
    docs = b.documents(spark, sf_dir).select("doc_id", sx.styled_sections(paragraphs, tables).alias("sections"))
    return sx.explode_sections(docs).select("doc_id", "content", _level(), "section_type")


@query(
    "file_routing",
    f"""select doc_id, file_type, case file_type when 'pdf' then 'layout' when 'docx' then 'styled' when 'txt' then 'text'
      when 'html' then 'html' when 'md' then 'html' end as parser,
      case when file_type = 'doc' then 'no parser' when file_type in ('exe','csv') then 'unsupported type' end as reject_reason
      from ({b.UPLOADS_SQL})""",
)
def file_routing(spark, sf_dir):
    return sx.route_files(b.uploads(spark, sf_dir)).select("doc_id", "file_type", "parser", "reject_reason")


@query(
    "upload_validation",
    f"""select doc_id, u.tenant_id, concat_ws(', ', case when file_type in ('exe','csv') then 'file type' end,
      case when file_size > 104857600 then 'file size' end, case when current_documents >= max_documents then 'quota' end) as reject_reasons
      from ({b.UPLOADS_SQL}) u left join ({b.TENANTS_SQL}) t on u.tenant_id = t.tenant_id""",
)
def upload_validation(spark, sf_dir):
    out = sx.validate_uploads(b.uploads(spark, sf_dir), b.tenants(spark, sf_dir))
    return out.select("doc_id", "tenant_id", F.array_join("reject_reasons", ", ").alias("reject_reasons"))


@query(
    "parsed_summary",
    f"select doc_id, count(*)::bigint as total_sections, sum(length(content))::bigint as total_chars from ({SECTIONS_SQL}) group by doc_id",
)
def parsed_summary(spark, sf_dir):
    docs = b.documents(spark, sf_dir).select("doc_id", sx.text_sections(F.col("text"), "\n").alias("sections"))
    return sx.parsed_summary(docs)


@query("normalize_whitespace", r"""select doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '[^\S\n]+(\n|\z)', '\1', 'g') as content,
  regexp_replace(text, '\n{3,}', E'\n\n', 'g') as collapsed from documents""")
def normalize_whitespace(spark, sf_dir):
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.normalize_whitespace(F.col("text")).alias("content"), tx.collapse_newlines(F.col("text")).alias("collapsed")
    )


@query("punctuation_and_charset", r"""select doc_id, regexp_replace(regexp_replace(text, '\s+([.,;:!?])', '\1', 'g'), '([.,;:!?])([^\s\d])', '\1 \2', 'g') as spaced,
  regexp_replace(text, '[^\x20-\x7E\n\r一-鿿]', '', 'g') as kept, regexp_replace(text, '\n\s*\d+\s*\n', E'\n', 'g') as unnumbered from documents""")
def punctuation_and_charset(spark, sf_dir):
    c = F.col("text")
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.space_punctuation(c).alias("spaced"), tx.strip_charset(c).alias("kept"), tx.strip_page_numbers(c).alias("unnumbered")
    )


FRAMED = "case doc_id % 3 when 0 then 'Page ' || doc_id else 'COPYRIGHT ' || doc_id end || chr(10) || text || chr(10) || case doc_id % 3 when 1 then doc_id || ' / 99' else '2024-01-05 end' end"


@query(
    "header_footer_lines",
    rf"""select doc_id, array_to_string(list_transform(l, lambda s, i: case when (i = 1 or i = len(l)) and regexp_matches(trim(s),
      '(?i)^(Page \d+$|\d+\s*/\s*\d+$|\d{{4}}-\d{{2}}-\d{{2}}|Copyright)') then '' else s end), chr(10)) as content
      from (select doc_id, string_split({FRAMED}, chr(10)) as l from documents)""",
)
def header_footer_lines(spark, sf_dir):
    """Every text framed by a page header and a footer line, then stripped of both."""
    doc = F.col("doc_id").cast("string")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Page "), doc)).otherwise(F.concat(F.lit("COPYRIGHT "), doc))
    foot = F.when(F.col("doc_id") % 3 == 1, F.concat(doc, F.lit(" / 99"))).otherwise("2024-01-05 end")
    framed = F.concat_ws("\n", head, F.col("text"), foot)
    return b.documents(spark, sf_dir).select("doc_id", tx.strip_header_footer_lines(framed).alias("content"))


@query("clean_text", f"select doc_id, {sql_clean('text')} as content from documents")
def clean_text(spark, sf_dir):
    return b.documents(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("content"))


@query(
    "clean_table",
    rf"""select doc_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(replace(text, ' ', ' | '), '\|+', '|', 'g'),
      '\|\s*\|', '|', 'g'), chr(10)), lambda s: contains(s, '|')), lambda s: '| ' || array_to_string(list_filter(list_transform(
      string_split(s, '|'), lambda c: {sql_strip('c')}), lambda c: c <> ''), ' | ') || ' |'), chr(10)) as content from documents""",
)
def clean_table(spark, sf_dir):
    cells = F.replace(F.col("text"), F.lit(" "), F.lit(" | "))
    return b.documents(spark, sf_dir).select("doc_id", tx.clean_table(cells).alias("content"))


DISPATCH_SQL = rf"""case doc_id % 3 when 0 then array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(text, '\|+', '|', 'g'),
      '\|\s*\|', '|', 'g'), chr(10)), lambda s: contains(s, '|')), lambda s: '| ' || array_to_string(list_filter(list_transform(
      string_split(s, '|'), lambda c: {sql_strip('c')}), lambda c: c <> ''), ' | ') || ' |'), chr(10))
  when 1 then {sql_strip(r"regexp_replace(text, '\s+', ' ', 'g')")} else {sql_clean('text')} end"""


@query("clean_content_dispatch", f"select doc_id, {DISPATCH_SQL} as content from documents")
def clean_content_dispatch(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "table").when(F.col("doc_id") % 3 == 1, "formula").otherwise("text")
    return b.documents(spark, sf_dir).select("doc_id", tx.clean_content(F.col("text"), kind).alias("content"))


POSITIONED_SQL = rf"""
select doc_id, section_index, content, content_h, top_y, case when top_y is null then false else top_y < 150 or by_text end as is_header,
  case when top_y is null then false else top_y > 850 or by_text end as is_footer
from (select *, content as content_h, case when section_index % 4 = 3 then null else ((section_index * 37) % 10) * 100.0 end as top_y,
  regexp_matches(content, '(?i)^(Page \d+$|\d+\s*/\s*\d+$|\d{{4}}-\d{{2}}-\d{{2}}|Copyright)') as by_text from ({SECTIONS_SQL}))
"""


def _positioned(spark, sf_dir):
    """Sections with a position that follows their index; every fourth has none."""

    def place(s, i):
        top = F.when(i % 4 != 3, ((i * 37) % 10) * 100)
        return sx.section(s["content"], s["page_number"], s["section_type"], s["heading_level"], s["heading_text"], top, F.when(i % 4 != 3, 1000.0))

    docs = b.documents(spark, sf_dir).select("tenant_id", "doc_id", sx.text_sections(F.col("text"), "\n").alias("s"))
    return docs.select("tenant_id", "doc_id", F.transform("s", place).alias("sections"))


@query("detect_header_footer", f"select doc_id, section_index, is_header, is_footer from ({POSITIONED_SQL})")
def detect_header_footer(spark, sf_dir):
    s = sx.explode_sections(_positioned(spark, sf_dir))
    header, footer = tx.header_footer_flags(F.col("content"), F.col("top_y"), F.col("page_height"))
    return s.select("doc_id", F.col("section_index").cast("bigint"), header.alias("is_header"), footer.alias("is_footer"))


@query(
    "clean_parsed_document",
    f"""select doc_id, content, was_header, was_footer from (select doc_id, {sql_clean('content')} as content, is_header as was_header,
      is_footer as was_footer from ({POSITIONED_SQL}) where not ((is_header or is_footer) and length(content) < 50)) where content <> ''""",
)
def clean_parsed_document(spark, sf_dir):
    from loomery.operators.chunking import clean_sections

    docs = _positioned(spark, sf_dir).select("doc_id", clean_sections(F.col("sections")).alias("sections"))
    return sx.explode_sections(docs).select("doc_id", "content", "was_header", "was_footer")


@query(
    "token_estimate",
    rf"""select doc_id, {sql_estimate('text')}::bigint as estimated, greatest(1, (length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) // 2
      + length(regexp_replace(text, '[一-鿿]', '', 'g')) // 4)::bigint as counted from documents""",
)
def token_estimate(spark, sf_dir):
    c = F.col("text")
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.estimate_tokens(c).cast("bigint").alias("estimated"), tx.count_tokens(c).cast("bigint").alias("counted")
    )
