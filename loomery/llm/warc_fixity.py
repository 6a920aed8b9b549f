"""Fixity audit of archive replicas by Merkle trees over ordered records.

A record's leaf is the SHA-256 of its bytes, with their length. Records have a
number; a node of level L stands for 16**L consecutive numbers and hashes its
children's places, lengths and digests in order, so equal nodes mean equal records
at equal offsets within the range. Both replicas' levels are stored as tables;
the audit compares the roots and then reads, level by level, only the children of
nodes that differ, down to the records.

Numbers are file * PER_FILE + place, so a file is a subtree. Only built-in
functions are used, and every grouping has at most 16 children.

Results for odd input: records without a number are ignored; several records of
one number are one leaf (in the order of their digests); null bytes count as
empty; an empty replica reports every record of the other; two empty ones give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import store

FAN_BITS = 4
FILE_BITS = 12
PER_FILE = 1 << FILE_BITS


def record(url: Column, body: Column, number: Column) -> Column:
    """A WARC response record as bytes."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"),
        number.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    ).cast("binary")


def _digest(children: Column) -> Column:
    """SHA-256 over the ordered (place, length, digest) of children."""
    lines = F.transform(F.sort_array(children), lambda c: F.concat_ws(":", c["node"].cast("string"), c["length"].cast("string"), c["digest"]))
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (node, length, digest) from the leaves up; ``records`` has number and bytes."""
    data = F.coalesce(F.col("bytes"), F.lit(b""))
    leaves = (
        records.where("number is not null")
        .select(F.col("number").alias("node"), F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("digest"))
        .groupBy("node")
        .agg(F.sum("length").alias("length"), F.array_join(F.sort_array(F.collect_list("digest")), ",").alias("digest"))
    )
    out = [store(leaves, "fixity-0")]
    for level in range(1, levels + 1):
        up = (
            out[-1]
            .groupBy(F.shiftright("node", FAN_BITS).alias("up"))
            .agg(F.sum("length").alias("length"), _digest(F.collect_list(F.struct("node", "length", "digest"))).alias("digest"))
            .withColumnRenamed("up", "node")
        )
        out.append(store(up, f"fixity-{level}"))
    return out


def levels_for(*replicas: DataFrame) -> int:
    """Levels until one node holds all numbers of all replicas."""
    most = max(r.agg(F.max("number").alias("m")).first()["m"] or 0 for r in replicas)
    level = 0
    while most >> (FAN_BITS * level):
        level += 1
    return max(level, 1)


def differing(ours: DataFrame, theirs: DataFrame, within: DataFrame | None) -> DataFrame:
    """Nodes of one level that differ, among the children of ``within``."""
    if within is not None:
        above = within.select(F.col("node").alias("_above"))
        ours, theirs = (x.join(above, F.shiftright("node", FAN_BITS) == F.col("_above"), "left_semi") for x in (ours, theirs))
    x = ours.select("node", F.col("length").alias("length_a"), F.col("digest").alias("digest_a"))
    y = theirs.select("node", F.col("length").alias("length_b"), F.col("digest").alias("digest_b"))
    return x.join(y, "node", "full_outer").where(~(F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("length_a").eqNullSafe(F.col("length_b"))))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, number, offset, length_a, length_b, fault of every record that differs.

    ``offset`` is the record's place in our file (where it would be, if missing).
    """
    levels = levels_for(ours, theirs)
    a, b = tree(ours, levels), tree(theirs, levels)
    wrong = None
    for level in range(levels, -1, -1):
        wrong = store(differing(a[level], b[level], wrong), f"differing-{level}")
    file = F.shiftright("node", FILE_BITS)
    files = wrong.select(file.alias("_file")).distinct()
    before = Window.partitionBy(file).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    numbers = a[0].select("node", "length").unionByName(wrong.where("digest_a is null").select("node", F.lit(0).cast("long").alias("length")))
    placed = numbers.join(files, file == F.col("_file"), "left_semi").select("node", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("offset"))
    fault = F.when(F.col("digest_a").isNull(), "extra").when(F.col("digest_b").isNull(), "missing").when(F.col("length_a") != F.col("length_b"), "resized").otherwise("altered")
    return wrong.join(placed, "node").select(file.alias("file"), F.col("node").alias("number"), "offset", "length_a", "length_b", fault.alias("fault"))
