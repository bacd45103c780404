"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is small and a document may be long, so their Jaccard similarity says little; what counts is
the share of the item's word shingles that the document holds.  Items are partitioned by the size of their
shingle sets.  In a partition with sets of up to ``u`` shingles an item is sketched by its
``floor((1 - t) u) + 1`` smallest hashes: a document that holds a share of t or more holds one of them.
Only document shingles under the largest sketch hash are looked up, and what is found is verified on the
shingles themselves.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH, PERCENT = 5, 80


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _runs(width: int, make) -> Column:
    """``make`` of each run of ``width`` words of column ``words``; none if there are fewer."""
    last = F.size("words") - width + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: make([F.get("words", i - 1 + k) for k in range(width)]))
    return F.when(last >= 1, each)


def hashes(width: int) -> Column:
    return _runs(width, lambda w: F.xxhash64(*w))


def texts(width: int) -> Column:
    return F.array_distinct(_runs(width, lambda w: F.concat_ws(" ", *w)))


def sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(item_id, n, key) of the smallest hashes of each item; ``items`` has item_id and words."""
    found = items.select("item_id", F.explode(hashes(width)).alias("key")).distinct()
    by_item = Window.partitionBy("item_id")
    sized = found.withColumn("n", F.count(F.lit(1)).over(by_item)).withColumn("rank", F.row_number().over(by_item.orderBy("key")))
    part = F.floor(F.log2(F.col("n") + F.lit(0.5)))
    upper = F.pow(F.lit(2.0), part + 1) - 1
    return sized.where(F.col("rank") <= F.floor((100 - percent) * upper / 100) + 1).select("item_id", "n", "key")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, item_id, shared, n): the items of which a document holds ``percent`` of a hundred shingles or more.

    ``docs`` has doc_id and text, ``items`` item_id and text; more columns are ignored.  ``row`` is a hash of id and
    text: rows that repeat one another are one.  ``shared`` of the item's ``n`` distinct shingles are in the
    document.  A null text, or one of fewer than ``width`` words, has no shingles, holds nothing and is found
    nowhere.  Item texts under one id count as items of their own if they differ, and once if they don't.
    Empty tables give no rows.
    """
    item = F.struct("item_id", F.xxhash64("text").alias("hash")).alias("item_id")
    known = items.select(item, words(F.col("text")).alias("words")).where(F.size("words") >= width).distinct()
    sketch = sketches(known, width, percent)
    ceiling = sketch.agg(F.max("key")).first()[0]
    row = F.xxhash64("doc_id", "text").alias("row")
    split = docs.select(row, "doc_id", words(F.col("text")).alias("words")).where(F.size("words") >= width)
    keys = split.select("row", F.size("words").alias("size"), F.explode(hashes(width)).alias("key"))
    keys = keys.where(F.col("key") <= F.lit(ceiling))
    # A document smaller than the share asked for can't hold it.
    enough = (F.col("size") - width + 1) * 100 >= F.col("n") * percent
    found = keys.join(sketch, "key").where(enough).select("row", "item_id").distinct()
    whole = known.select("item_id", texts(width).alias("item_shingles"))
    pairs = found.join(whole, "item_id").groupBy("row").agg(F.collect_list(F.struct("item_id", "item_shingles")).alias("items"))
    held = split.join(pairs, "row").dropDuplicates(["row"]).select(
        "row", "doc_id", texts(width).alias("shingles"), "items"
    )
    each = held.select("row", "doc_id", "shingles", F.explode("items").alias("item"))
    shared = F.size(F.array_intersect("shingles", "item.item_shingles"))
    out = each.select(
        "row", "doc_id", "item.item_id.item_id", shared.cast("long").alias("shared"),
        F.size("item.item_shingles").cast("long").alias("n"),
    )
    return out.where(F.col("shared") * 100 >= F.col("n") * percent)
