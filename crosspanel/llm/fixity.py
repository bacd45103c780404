"""Fixity audit of WARC archives by Merkle trees over offset ranges.

A record's digest is a leaf; the leaves whose records begin in one range of an archive's offsets, in
order, hash to a node; ``FANOUT`` neighbouring ranges hash to the next.  Replicas are compared from the
roots down, and only children of nodes that differ are looked at, to the records themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosspanel.llm.base import written

RANGE_BYTES = 1 << 16
FANOUT = 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A resource record as text; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def layout(pages: DataFrame, per_archive: int = 256) -> DataFrame:
    """(archive, offset, length, digest, page_id): where each page's record lies; ``pages`` has page_id, url, html.

    An archive holds ``per_archive`` consecutive ids (-1: rows without an id), in order of id and digest.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_archive), F.lit(-1)).cast("long").alias("archive"), "page_id",
        F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"),
    )
    before = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ";"), 256)


def leaves(records: DataFrame, range_bytes: int) -> DataFrame:
    """(archive, node, hash) of the offset ranges that hold records."""
    leaf = F.struct("offset", "length", F.coalesce("digest", F.lit("")).alias("digest"))
    held = records.groupBy("archive", F.floor(F.col("offset") / range_bytes).alias("node")).agg(
        F.sort_array(F.collect_list(leaf)).alias("held")
    )
    line = lambda x: F.concat_ws(",", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])
    return held.select("archive", "node", _hash(F.transform("held", line)).alias("hash"))


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    child = F.sort_array(F.collect_list(F.struct("node", "hash")))
    up = nodes.groupBy("archive", F.floor(F.col("node") / fanout).alias("parent")).agg(child.alias("held"))
    line = lambda x: F.concat_ws(",", x["node"].cast("string"), x["hash"])
    return up.select("archive", F.col("parent").alias("node"), _hash(F.transform("held", line)).alias("hash"))


def _differ(one: DataFrame, two: DataFrame) -> DataFrame:
    """(archive, node) of the nodes that one side lacks or that differ."""
    both = one.withColumnRenamed("hash", "one").join(two.withColumnRenamed("hash", "two"), ["archive", "node"], "full")
    return both.where(~F.col("one").eqNullSafe(F.col("two"))).select("archive", "node")


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(archive, offset, length, replica_length, kind) of every record that the replica has otherwise.

    Both inputs have archive, offset, length and digest; more columns are ignored.  ``kind`` is ``changed``,
    ``missing`` (the primary has it, the replica hasn't) or ``extra``.  A null digest is the same as an
    empty one.  Rows without an archive or offset aren't records and are left out; several records at one offset are
    compared as the set that they are.  Two empty inputs give no rows.
    """
    def records(df: DataFrame) -> DataFrame:
        return df.where(F.col("archive").isNotNull() & F.col("offset").isNotNull()).select(
            "archive", F.col("offset").cast("long"), F.col("length").cast("long"), F.coalesce("digest", F.lit("")).alias("digest")
        )

    sides = [written(records(df), "records") for df in (primary, replica)]
    last = max(s.agg(F.max("offset")).first()[0] or 0 for s in sides) // range_bytes
    levels = 0 if last == 0 else math.floor(math.log(last, fanout) + 1e-9) + 1
    trees = [[written(leaves(s, range_bytes), "ranges") for s in sides]]
    for _ in range(levels):
        trees.append([parents(s, fanout) for s in trees[-1]])
    found = _differ(*trees[-1])
    for level in reversed(trees[:-1]):
        below = [
            n.withColumn("parent", F.floor(F.col("node") / fanout)).join(
                found.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi"
            ).drop("parent")
            for n in level
        ]
        found = _differ(*below)
    at = F.floor(F.col("offset") / range_bytes)
    one, two = (
        s.withColumn("node", at).join(found, ["archive", "node"], "left_semi").groupBy("archive", "offset").agg(
            F.sort_array(F.collect_set(F.struct("length", "digest"))).alias(name)
        )
        for s, name in zip(sides, ("one", "two"))
    )
    kind = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("changed")
    return one.join(two, ["archive", "offset"], "full").where(~F.col("one").eqNullSafe(F.col("two"))).select(
        "archive", "offset", F.get("one", F.lit(0))["length"].alias("length"),
        F.get("two", F.lit(0))["length"].alias("replica_length"), kind.alias("kind"),
    )
