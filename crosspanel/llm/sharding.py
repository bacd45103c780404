"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows get a random 64-bit key; its leading bits name the partition.  How many rows each partition sends
to each shard is drawn exactly: halves of the partitions are split again and again, and at each split
the rows of every shard that fall to the left half follow a multivariate hypergeometric law.  A
partition is permuted by its keys and dealt out by its row of the matrix; a second key permutes each
shard.  Nothing is sorted as a whole, and no group is larger than a partition of a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosspanel.llm.base import keep_columns, written

#: Rows that a partition holds about, and the most levels of halving (65,536 partitions), which bounds
#: the broadcast matrix to a few MB; beyond that partitions grow, and their sort spills.
PARTITION_ROWS = 8192
MOST_LEVELS = 16


def _top_bits(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """The ``u``-quantile of the number of good items in ``draws`` out of ``total`` without replacement.

    The probabilities follow from their ratios, starting 12 standard deviations (and 12 steps) under the
    mean, and are normed by their sum; what lies beyond is under the resolution of a double.
    """
    g, t, n = (c.cast("double") for c in (good, total, draws))
    share = g / F.greatest(t, F.lit(1.0))
    mean = n * share
    sd = F.sqrt(F.greatest(mean * (1 - share) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0)))
    reach = F.ceil(12 * sd) + 12
    low = F.greatest(F.lit(0.0), n - (t - g), F.floor(mean) - reach).cast("long")
    high = F.greatest(low, F.least(n, g, F.floor(mean) + reach + 1).cast("long"))
    values = F.sequence(low, high)

    def ratio(k: Column) -> Column:
        return (g - k) * (n - k) / ((k + 1) * (t - g - n + k + 1))

    def state(aim: Column, p: Column, below: Column, count: Column) -> Column:
        return F.struct(aim.alias("aim"), p.alias("p"), below.alias("below"), count.alias("count"))

    def start(aim: Column) -> Column:
        return state(aim, F.lit(1.0), F.lit(0.0), F.lit(0).cast("long"))

    def step(a: Column, k: Column) -> Column:
        below = a["below"] + a["p"]
        count = a["count"] + F.when(below < a["aim"], 1).otherwise(0).cast("long")
        return state(a["aim"], F.coalesce(a["p"] * ratio(k), F.lit(0.0)), below, count)

    whole = F.aggregate(values, start(F.lit(0.0)), step, lambda a: a["below"])
    steps = F.aggregate(values, start(u * whole), step, lambda a: a["count"])
    return F.least(low + steps, high)


def _split(sizes: Column, draws: Column, node: Column, seed: int, shards: int) -> Column:
    """How many rows of each shard fall among ``draws`` of all rows: multivariate hypergeometric."""
    def step(a: Column, s: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, s), 11) / F.lit(float(1 << 53))
        k = hypergeometric(F.element_at(sizes, s), a["total"], a["left"], u)
        return F.struct(
            F.concat(a["taken"], F.array(k)).alias("taken"),
            (a["total"] - F.element_at(sizes, s)).alias("total"), (a["left"] - k).alias("left"),
        )

    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(
        F.array().cast("array<bigint>").alias("taken"), total.alias("total"), draws.cast("long").alias("left")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda a: a["taken"])


def communication_matrix(counts: DataFrame, levels: int, sizes: list[int], seed: int) -> DataFrame:
    """(part, sent array<bigint>): how many of its rows each of ``2 ** levels`` partitions sends to each shard.

    ``counts`` has (part, n).  Row sums are the counts, column sums are ``sizes``.
    """
    spark = counts.sparkSession
    row = F.array(*[F.lit(s).cast("long") for s in sizes])
    nodes = spark.range(1).select(F.col("id").alias("part"), row.alias("sent"))
    for level in range(levels):
        down = levels - level - 1
        left = counts.groupBy(F.shiftright("part", down).alias("half")).agg(F.sum("n").alias("n"))
        left = left.where(F.col("half") % 2 == 0).select((F.col("half") / 2).cast("long").alias("part"), "n")
        if level == 8:
            nodes = nodes.repartition(256, "part")
        taken = _split(F.col("sent"), F.coalesce("n", F.lit(0)), F.col("part") + (1 << level), seed, len(sizes))
        split = nodes.join(F.broadcast(left), "part", "left").select("part", "sent", taken.alias("taken"))
        rest = F.zip_with("sent", "taken", lambda a, b: a - b)
        nodes = split.select(F.inline(F.array(
            F.struct((F.col("part") * 2).alias("part"), F.col("taken").alias("sent")),
            F.struct((F.col("part") * 2 + 1).alias("part"), rest.alias("sent")),
        )))
    return nodes


def shuffle_to_shards(
    df: DataFrame, shards: int = 8, seed: int = 17, partition_rows: int = PARTITION_ROWS
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard), as (row, shard, slot).

    Every order of the rows is equally likely; shard sizes differ by one at most.  ``row`` is a struct of all
    columns of ``df``, so names can't clash.  Nulls and repeated rows are rows like others: a row's random
    key comes from its place in the input, so copies are spread as well.  An empty input gives no rows.
    The keys are fixed by writing the rows once; from there on a lost task repeats exactly.
    """
    place = F.monotonically_increasing_id()
    rows = written(
        keep_columns(df, "row").withColumn("place", place).withColumn("key", F.xxhash64(F.lit(seed), "place")),
        "rows",
    )
    total = rows.count()
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(1, total) / partition_rows))))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    rows = rows.withColumn("part", _top_bits(F.col("key"), levels))
    counts = written(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "counts")
    matrix = written(communication_matrix(counts, levels, sizes, seed + 1), "matrix")
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda i: F.aggregate(F.slice("sent", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key", "place")) - 1
    dealt = rows.withColumn("rank", rank).join(F.broadcast(matrix.select("part", ends.alias("ends"))), "part")
    second = F.xxhash64(F.lit(seed + 2), "place")
    dealt = dealt.select(
        "row", "place", second.alias("key"),
        F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"),
    ).withColumn("part", _top_bits(F.col("key"), max(0, levels - int(math.log2(shards)))))
    dealt = written(dealt, "dealt")
    sums = written(dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")), "sums")
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    starts = sums.select("shard", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "place")) - 1
    return (
        dealt.withColumn("rank", rank)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("row", "shard", (F.col("before") + F.col("rank")).alias("slot"))
    )
