"""Request filters: all are plain predicates, so they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.session import BROADCAST_MAX_ROWS, fits

MAX_INLINE_IDS = 1000


def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    return df.where(F.col("tenant_id") == tenant)


def in_documents(df: DataFrame, ids, column: str = "document_id") -> DataFrame:
    """``ids``: a list, or a DataFrame with ``column`` for many ids."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(column).distinct()
        return df.join(F.broadcast(wanted) if fits(wanted, BROADCAST_MAX_ROWS) else wanted, column, "left_semi")
    if len(ids) > MAX_INLINE_IDS:
        return in_documents(df, df.sparkSession.createDataFrame([(i,) for i in ids], [column]), column)
    return df.where(F.col(column).isin(list(ids)))


def term_filters(filters: dict) -> Column:
    """Scalar -> equality, list -> membership, all of them together."""
    parts = [F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v for c, v in filters.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(df: DataFrame, tenant: str | None = None, document_ids=None, terms: dict | None = None, expr: str | None = None,
                  document_column: str = "document_id") -> DataFrame:
    """All request filters, the same for every retrieval route."""
    if tenant is not None:
        df = tenant_scope(df, tenant)
    if document_ids is not None:
        df = in_documents(df, document_ids, document_column)
    if terms:
        df = df.where(term_filters(terms))
    if expr:
        df = df.where(F.expr(expr))
    return df


def min_score(df: DataFrame, column: str, least: float = 0.0) -> DataFrame:
    return df.where(F.col(column) >= least)


def declared_filters(df: DataFrame, date_range=None, file_types=None, metadata: dict | None = None,
                     date_column: str = "created_at", metadata_column: str = "doc_metadata") -> DataFrame:
    """Date range (inclusive), file types, and equality on metadata map entries."""
    if date_range:
        df = df.where(F.col(date_column).between(F.lit(date_range[0]).cast("timestamp"), F.lit(date_range[1]).cast("timestamp")))
    if file_types:
        df = df.where(F.col("file_type").isin(list(file_types)))
    for key, value in (metadata or {}).items():
        df = df.where(F.try_element_at(metadata_column, F.lit(key)) == value)
    return df


def list_documents_filter(df: DataFrame, status: str | None = None, file_type: str | None = None) -> DataFrame:
    df = df.where(~F.col("is_deleted"))
    if status:
        df = df.where(F.col("status") == status)
    return df.where(F.col("file_type") == file_type) if file_type else df


def list_tenants_filter(df: DataFrame, is_active: bool | None = None, search: str | None = None) -> DataFrame:
    df = df.where(~F.col("is_deleted"))
    if is_active is not None:
        df = df.where(F.col("is_active") == is_active)
    return df.where(F.ilike("name", F.lit(f"%{search}%"))) if search else df
