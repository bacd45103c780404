"""Ranks, cumulative counts and exact quantiles inside groups of any size.

A month (or a feature-month) can hold a third of a very large panel, so an ordered window over the
whole group is used only when the caller has measured the largest group and it fits one task.
Without that measurement the group is cut into value buckets: every bucket is ordered on its own and
offset by the row counts of the buckets below it.  Both ways give the same exact numbers.

The cut points come from a hash sample of the group's own sort keys.  A hash sample is a pure function
of the data, so a recomputed partition sees the same buckets as the partition it replaces.

Groups are months, feature-months or policy-months: their number is bounded by the calendar and the
feature list, so the table of group sizes is small enough to broadcast; so is the table of cuts, with one
value for every ``BUCKET_ROWS`` keys of a group (two million cuts at 1e12 keys).  Rows are never shuffled on a
group key alone, nor on a value that many of them share.

Group keys must not be null (panel keys never are), so every join is a plain equi-join and the bucket
windows and their offsets meet on one partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WINDOW_ROWS = 1_000_000  # largest group ordered in one task
BUCKET_ROWS = 500_000  # wished rows per bucket beyond it
HOT_SHARE = 1000  # values with that share of a group's rows don't enter a shuffled join
SALTS = 4096
TASK_ROWS = 50_000  # wished rows per task of ordered windows; a larger group is one task's
FOLD_ROWS = 400_000  # wished rows per task of folds along entities


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group.  One counting job with map-side combine."""
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def fits_one_task(group_rows: int | None) -> bool:
    return group_rows is not None and group_rows <= WINDOW_ROWS


def deal(df: DataFrame, by: Sequence[str], rows: int, number: Column) -> tuple[DataFrame, list[str]]:
    """Groups dealt out in turn by their running ``number``, ``TASK_ROWS`` rows a task; and the keys to order within.

    Where groups hash to tasks, or small partitions are merged by their bytes, a task gets several months, and every
    ordering of its window chain holds them all.  Dealt in turn, a task of large groups holds one of them.
    """
    tasks = max(1, -(-rows // TASK_ROWS))
    part = F.coalesce(F.pmod(number, F.lit(tasks)), F.lit(0)).cast("int")
    return df.withColumn("__part", part).repartitionById(tasks, "__part"), ["__part", *by]


def by_entity(df: DataFrame, rows: int, times: int = 1) -> DataFrame:
    """Shuffled on the entity before each row turns into ``times`` rows, with the rows of a task measured after that.

    Folds and windows on more keys and the entity then need no shuffle of the multiplied rows.
    """
    return df.repartition(max(1, -(-rows * times // FOLD_ROWS)), "entity")


def month_number(day: str) -> Column:
    return F.year(day) * 12 + F.month(day)


def bucket_by_value(
    df: DataFrame, by: Sequence[str], key: str, rows: str | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``__bucket``: rows of a lower bucket sort before rows of a higher one on ``key``.

    ``rows`` names a multiplicity column; ``key`` values may repeat only when they are meant to share
    a bucket.
    """
    weight = F.col(rows) if rows else F.lit(1)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__keys"))
    buckets = F.ceil(F.col("__keys") / F.lit(bucket_rows))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("__keys") / (buckets * F.lit(8))))
    source = df.select(*by, key)
    sized = source.join(F.broadcast(sizes), by, "left")
    picked = sized.where(F.pmod(F.xxhash64(key), step) == 0)
    sample = F.array_sort(F.collect_set(key))
    cut = picked.groupBy(*by).agg(sample.alias("__sample"), F.max(buckets).alias("__n"))
    # Every (size / n)-th sampled key becomes a cut.
    cut = cut.select(
        *by,
        F.expr(
            "transform(filter(sequence(1, greatest(cast(__n as int) - 1, 1)), i -> __n > 1 and size(__sample) > 0),"
            " i -> __sample[cast(least(size(__sample) - 1, floor(i * size(__sample) / __n)) as int)])"
        ).alias("__cuts"),
    )
    # Two levels of splitters: a row looks at the first cut of every node, then at the cuts of its node alone,
    # so both what it carries and what it compares grow with the root of the cuts.
    fan = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("__cuts"))).cast("int"))
    nodes = F.ceil(F.size("__cuts") / F.col("__fan")).cast("int")
    tree = cut.withColumn("__fan", fan).withColumn("__nodes", F.greatest(F.lit(1), nodes))
    first = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("__nodes") - 1), lambda i: i > 0),
        lambda i: F.col("__cuts")[i * F.col("__fan")],
    )
    leaves = tree.select(*by, "__fan", "__cuts", F.explode(F.sequence(F.lit(0), F.col("__nodes") - 1)).alias("__node")).select(
        *by, "__node", (F.col("__node") * F.col("__fan")).alias("__before"),
        F.slice("__cuts", F.col("__node") * F.col("__fan") + 1, F.col("__fan")).alias("__own"),
    )

    def under(cuts: str) -> Column:
        return F.coalesce(F.size(F.filter(F.col(cuts), lambda c: c <= F.col(key))), F.lit(0))

    out = df.join(F.broadcast(tree.select(*by, first.alias("__first"))), by, "left").withColumn("__node", under("__first"))
    out = out.drop("__first").join(F.broadcast(leaves), [*by, "__node"], "left")
    bucket = F.coalesce("__before", F.lit(0)) + under("__own")
    return out.withColumn("__bucket", bucket).drop("__node", "__before", "__own").withColumn("__w", weight)


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """No group columns means one group that holds every row."""
    return (df, list(by)) if by else (df.withColumn("__all", F.lit(0)), ["__all"])


def _offsets(bucketed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows below each bucket and in the whole group: one row per bucket."""
    counts = bucketed.groupBy(*by, "__bucket").agg(F.sum("__w").alias("__rows"))
    span = W.partitionBy(*by)
    before = span.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *by,
        "__bucket",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
        F.sum("__rows").over(span).alias("__total"),
    )


def cumulative_counts(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    group_rows: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per distinct non-null value of a group: ``n`` rows, ``below`` smaller, ``total`` in all.

    Equal values collapse in the map-side combine before anything is ordered, so a value held by a
    third of the rows is one row here.
    """
    df, by = _grouped(df, by)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    if fits_one_task(group_rows):
        span = W.partitionBy(*by)
        before = span.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return distinct.select(
            *by,
            value,
            "n",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"),
            F.sum("n").over(span).alias("total"),
        )
    bucketed = bucket_by_value(distinct, by, value, rows="n", bucket_rows=bucket_rows)
    inside = W.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = bucketed.withColumn("__local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(_offsets(bucketed, by), [*by, "__bucket"], "left").select(
        *by,
        value,
        "n",
        (F.col("__offset") + F.col("__local")).alias("below"),
        F.col("__total").alias("total"),
    )


def with_counts(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    group_rows: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Keep every row and add ``__n``, ``__below``, ``__total`` of its value (null for a null value)."""
    df, by = _grouped(df, by)
    if fits_one_task(group_rows):
        # One ordered window: rows at or under the value, and its first place among them.
        span = W.partitionBy(*by)
        order = span.orderBy(F.col(value).asc_nulls_last())
        present = F.col(value).isNotNull()
        upto = F.count(value).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
        return (
            df.withColumns({"__r": F.rank().over(order), "__upto": upto, "__total": F.count(value).over(span)})
            .withColumns(
                {
                    "__n": F.when(present, F.col("__upto") - F.col("__r") + 1),
                    "__below": F.when(present, F.col("__r") - 1),
                    "__total": F.when(present, F.col("__total")),
                }
            )
            .drop("__r", "__upto")
        )
    counts = cumulative_counts(df, by, value, group_rows, bucket_rows).withColumnsRenamed(
        {"n": "__n", "below": "__below", "total": "__total"}
    )
    return join_counts(df, counts, by, value, ["__n", "__below", "__total"])


def join_counts(df: DataFrame, counts: DataFrame, by: Sequence[str], value: str, columns: Sequence[str], n: str = "__n", total: str = "__total") -> DataFrame:
    """Put the ``columns`` of a table with one row per (group, value) on every row of ``df``; null values get nulls.

    A value that holds one HOT_SHARE-th of its group or more would be one join key of that many rows.  There are at
    most HOT_SHARE such values in a group, so they are broadcast; rows of hot and null values carry a salt into
    the shuffled join, where they match nothing and are spread evenly.
    """
    hot = F.col(n) * HOT_SHARE >= F.col(total)
    often = counts.where(hot).select(*by, value, F.struct(*columns).alias("__often"))
    # Zero, but not a literal: the optimiser would take that out of the join's keys.
    zero = F.pmod(F.col(n), F.lit(1)).cast("int")
    rare = counts.where(~hot).select(*by, value, F.struct(*columns).alias("__rare"), zero.alias("__salt"))
    out = df.join(F.broadcast(often), [*by, value], "left")
    aside = F.col(value).isNull() | F.col("__often").isNotNull()
    salt = F.when(aside, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(0).cast("int")
    out = out.withColumn("__salt", salt).join(rare, [*by, value, "__salt"], "left").withColumn(
        "__found", F.coalesce("__often", "__rare")
    )
    return out.withColumns({c: F.col("__found")[c] for c in columns}).drop("__often", "__rare", "__salt", "__found")


def percentile_ranks(
    df: DataFrame,
    by: Sequence[str],
    columns: dict[str, str],
    group_rows: int | None = None,
    neutral: float = 0.5,
    **kw,
) -> DataFrame:
    """Percentile ranks of several columns at once: {value column: output column}.

    Groups that fit a task are partitioned once and share one count; only the orderings differ.
    """
    if not fits_one_task(group_rows):
        # Each column's counts come from the input, not from the ranked rows of the column before.
        out = df
        for value, output in columns.items():
            counts = cumulative_counts(df, by, value, group_rows, **kw)
            share = (F.col("below") + (F.col("n") + 1) / F.lit(2.0)) / F.col("total")
            out = join_counts(out, counts.withColumn(output, share), by, value, [output], "n", "total")
            out = out.withColumn(output, F.coalesce(output, F.lit(neutral)))
        return out
    span = W.partitionBy(*by)
    out = df.withColumns({f"__t_{v}": F.count(v).over(span) for v in columns})
    for v in columns:
        order = span.orderBy(F.col(v).asc_nulls_last())
        upto = F.count(v).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
        out = out.withColumns({f"__r_{v}": F.rank().over(order), f"__u_{v}": upto})
    ranked = {}
    for v, output in columns.items():
        middle = (F.col(f"__r_{v}") + F.col(f"__u_{v}")) / F.lit(2.0)
        share = F.when(F.col(v).isNotNull(), middle / F.col(f"__t_{v}"))
        ranked[output] = F.coalesce(share, F.lit(neutral))
    return out.withColumns(ranked).drop(*[f"__{k}_{v}" for v in columns for k in "tru"])


def average_rank(
    df: DataFrame, by: Sequence[str], value: str, output: str, group_rows: int | None = None, **kw
) -> DataFrame:
    """Rank with tied values sharing the mean of their positions; null stays null."""
    ranked = with_counts(df, by, value, group_rows, **kw)
    return ranked.withColumn(output, F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)).drop(
        "__n", "__below", "__total", "__all"
    )


def percentile_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    output: str,
    group_rows: int | None = None,
    neutral: float | None = 0.5,
    **kw,
) -> DataFrame:
    """Average-tie rank over the non-null count; null becomes ``neutral``."""
    ranked = with_counts(df, by, value, group_rows, **kw)
    share = (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)) / F.col("__total")
    if neutral is not None:
        share = F.coalesce(share, F.lit(neutral))
    return ranked.withColumn(output, share).drop("__n", "__below", "__total", "__all")


def average_ranks(
    df: DataFrame, by: Sequence[str], columns: dict[str, str], group_rows: int | None = None, **kw
) -> DataFrame:
    """Average-tie ranks of several columns at once: {value column: output column}; null stays null."""
    out = df
    for value, output in columns.items():
        if fits_one_task(group_rows):
            order = W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
            upto = F.count(value).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
            middle = (F.rank().over(order) + upto) / F.lit(2.0)
            out = out.withColumn(output, F.when(F.col(value).isNotNull(), middle))
        else:
            counts = cumulative_counts(df, by, value, group_rows, **kw)
            middle = F.col("below") + (F.col("n") + 1) / F.lit(2.0)
            out = join_counts(out, counts.withColumn(output, middle), by, value, [output], "n", "total")
    return out


def minimum_rank_descending(
    df: DataFrame, by: Sequence[str], value: str, output: str, group_rows: int | None = None, **kw
) -> DataFrame:
    """Rank 1 is the largest value; ties share the smallest rank."""
    ranked = with_counts(df, by, value, group_rows, **kw)
    rank = F.col("__total") - F.col("__below") - F.col("__n") + 1
    return ranked.withColumn(output, rank).drop("__n", "__below", "__total", "__all")


def ordinal_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    output: str,
    group_rows: int | None = None,
    count: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """1, 2, 3 ... by the ascending ``order`` columns, which must end in a unique key.

    ``count`` adds the rows of the group.
    """
    df, by = _grouped(df, by)
    if fits_one_task(group_rows):
        span = W.partitionBy(*by)
        out = df.withColumn(output, F.row_number().over(span.orderBy(*order)))
        return (out.withColumn(count, F.count(F.lit(1)).over(span)) if count else out).drop("__all")
    keyed = df.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    bucketed = bucket_by_value(keyed, by, "__key", bucket_rows=bucket_rows)
    local = bucketed.withColumn(
        "__local", F.row_number().over(W.partitionBy(*by, "__bucket").orderBy("__key"))
    )
    out = local.join(_offsets(bucketed, by), [*by, "__bucket"], "left").withColumn(
        output, (F.col("__offset") + F.col("__local")).cast("int")
    )
    if count:
        out = out.withColumn(count, F.col("__total"))
    return out.drop("__key", "__bucket", "__w", "__local", "__offset", "__total", "__all")


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    group_rows: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per name in ``probabilities``."""
    by = list(by)
    if fits_one_task(group_rows):
        exprs = [F.percentile(value, F.lit(p)).alias(name) for name, p in probabilities.items()]
        return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
    table = cumulative_counts(df, by, value, group_rows, bucket_rows)
    picks = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("total") - 1)
        low, high = F.floor(position), F.ceil(position)
        for tag, at in (("lo", low), ("hi", high)):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"__{tag}_{name}"))
    picks.append(F.max("total").alias("__total"))
    found = table.groupBy(*by).agg(*picks) if by else table.agg(*picks)
    columns = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("__total") - 1)
        part = position - F.floor(position)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        columns.append((lo + (hi - lo) * part).alias(name))
    result = found.select(*by, *columns)
    if by:  # groups whose values are all null keep a row of nulls
        return df.select(*by).distinct().join(result, by, "left")
    return result


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a calendar-sized table (one row per month, or per month and feature) to panel rows.

    Its size is bounded by the calendar and the feature list, never by the rows of the panel, so it is
    broadcast and the panel is not shuffled on the month.
    """
    return df.join(F.broadcast(stats), list(keys), how)
