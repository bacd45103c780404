"""Aligned joins, horizon and transition joins, comparisons, splits and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.functions import scalars as X


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def assert_unique(df: DataFrame, on: Sequence[str], what: str) -> None:
    """Raise when a key repeats; the check is one combined count and stops at the first hit."""
    if not duplicate_keys(df, on).isEmpty():
        raise ValueError(f"{what}: key {list(on)} is not unique")


def align(left: DataFrame, right: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Left join in which every left row must find exactly one right row."""
    assert_unique(right, on, "right side")
    joined = left.join(right.select(*on, value), list(on), "left")
    if not joined.where(F.col(value).isNull()).isEmpty():
        raise ValueError(f"rows without {value}")
    return joined


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    assert_unique(left, on, "left side")
    assert_unique(right, on, "right side")
    return left.join(right, list(on), "inner")


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    assert_unique(right, on, "right side")
    return left.join(right, list(on), "left")


def horizon_join(df: DataFrame, features: DataFrame, horizons: int, label: str = "ret_exc_lead1m") -> DataFrame:
    """Features at month t with the label at t+h-1, for h = 1..horizons, matched by month number.

    Features and labels are shuffled together on the entity, each row once; a range window over the month numbers
    gives a feature row the labels of its months, and only then are rows multiplied by the horizons.
    """
    extra = [c for c in features.columns if c not in ("entity", "month_index")]
    target = F.struct(F.col("month_index").alias("target_index"), F.col("eom").alias("target_eom"), label)
    labels = df.where(F.col(label).isNotNull()).select("entity", "month_index", target.alias("__target"))
    rows = features.select("entity", "month_index", F.struct(*extra).alias("__row"))
    both = rows.unionByName(labels, allowMissingColumns=True)
    ahead = W.partitionBy("entity").orderBy("month_index").rangeBetween(0, horizons - 1)
    met = both.withColumn("__targets", F.collect_list("__target").over(ahead)).where(F.col("__row").isNotNull())
    out = met.select("entity", "month_index", *[F.col("__row")[c].alias(c) for c in extra], F.inline("__targets"))
    return out.withColumns(
        {"horizon": F.col("target_index") - F.col("month_index") + 1, "return_eom": X.month_end(F.col("target_eom"), 1)}
    )


def transition_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of an entity in month t next to its row in t+1.

    A lead over the entity's months finds the next row and the month numbers decide if it is t+1.
    """
    path = W.partitionBy("entity").orderBy("month_index")
    out = df.withColumns({f"next_{c}": F.lead(c).over(path) for c in [*columns, "eom", "month_index"]})
    return out.where(F.col("next_month_index") == F.col("month_index") + 1).drop("next_month_index")


def overlap_fraction(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs over the smaller of the two months' counts, per transition."""
    counts = df.groupBy("month_index").agg(F.count(F.lit(1)).alias("n"), F.max("eom").alias("eom"))
    path = W.orderBy("month_index")  # one row per month
    both = counts.select(
        "eom", "n", F.lead("n").over(path).alias("next_n"),
        (F.lead("month_index").over(path) - F.col("month_index")).alias("gap"),
    ).where(F.col("gap") == 1)
    found = pairs.groupBy("eom").agg(F.count(F.lit(1)).alias("pairs"))
    return both.join(found, "eom").select(
        "eom", "pairs", (F.col("pairs") / F.least("n", "next_n")).alias("overlap_fraction")
    )


def method_pairs(
    returns: DataFrame, pairs: Sequence[tuple[str, str]], fields: Sequence[str], rounding: float = S.SUM_ROUNDING
) -> DataFrame:
    """Candidate minus benchmark by month for named method pairs (monthly tables).

    Both sides are sums over all names, so a difference under ``rounding`` of the larger side is rounding noise
    whose sign depends on the order of the sum; it is zero, and no month that one of the two won.  With a
    ``rounding`` of zero the difference is taken as it is.
    """
    table = F.array(*[F.struct(F.lit(c).alias("candidate_method"), F.lit(b).alias("benchmark_method")) for c, b in pairs])
    spread = returns.withColumn("__pair", F.explode(table))
    candidate = spread.where(F.col("method") == F.col("__pair.candidate_method")).select(
        "eom", "test_year", "__pair.candidate_method", "__pair.benchmark_method",
        *[F.col(f).alias(f"__c_{f}") for f in fields],
    )
    benchmark = spread.where(F.col("method") == F.col("__pair.benchmark_method")).select(
        "eom", F.col("test_year").alias("__year"), "__pair.candidate_method", "__pair.benchmark_method",
        *[F.col(f).alias(f"__b_{f}") for f in fields],
    )
    joined = candidate.join(benchmark, ["eom", "candidate_method", "benchmark_method"])

    def gap(field: str) -> Column:
        c, b = F.col(f"__c_{field}"), F.col(f"__b_{field}")
        if not rounding:
            return c - b
        noise = F.abs(c - b) <= F.lit(rounding) * F.greatest(F.abs(c), F.abs(b))
        return F.when(noise, F.lit(0.0)).otherwise(c - b)

    return joined.select(
        "eom", "test_year", "candidate_method", "benchmark_method",
        (F.col("test_year") == F.col("__year")).alias("years_agree"),
        *[gap(f).alias(f"delta_{f}") for f in fields],
    )


def extend_panel(df: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add columns to a panel; a name clash or a repeated key is an error and old columns stay as they are."""
    clash = sorted((set(df.columns) & set(new.columns)) - set(on))
    if clash:
        raise ValueError(f"columns already there: {clash}")
    return join_many_to_one(df, new, on)


def changed_rows(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``before`` that ``after`` lacks or holds with another value; ``on`` is unique in both.

    The two meet by key, so whole rows are compared but not sorted or hashed.
    """
    values = [c for c in before.columns if c not in on]
    right = after.select(*on, F.struct(*values).alias("__after"))
    rows = before.join(right, list(on), "left")
    return rows.where(~F.struct(*values).eqNullSafe(F.col("__after"))).select(*before.columns)


def compare_wide(
    left: DataFrame, right: DataFrame, on: Sequence[str], names: tuple[str, str]
) -> DataFrame:
    """Numeric columns of two result sets side by side with their difference."""
    kinds = dict(left.dtypes)
    common = [c for c in left.columns if c in right.columns and c not in on]
    numeric = [c for c in common if kinds[c] in ("double", "float", "int", "bigint")]
    a, b = names
    lhs = left.select(*on, *[F.col(c).alias(f"{c}_{a}") for c in numeric])
    rhs = right.select(*on, *[F.col(c).alias(f"{c}_{b}") for c in numeric])
    joined = lhs.join(rhs, list(on), "inner")
    return joined.withColumns({f"{c}_difference": F.col(f"{c}_{b}") - F.col(f"{c}_{a}") for c in numeric})


def pairwise_deltas(df: DataFrame, spec: str, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every later specification minus every earlier one, on the same keys (result tables)."""
    left = df.select(*on, F.col(spec).alias("from_spec"), *[F.col(v).alias(f"__a_{v}") for v in values])
    right = df.select(*on, F.col(spec).alias("to_spec"), *[F.col(v).alias(f"__b_{v}") for v in values])
    joined = left.join(right, list(on)).where(F.col("from_spec") < F.col("to_spec"))
    return joined.select(
        *on, "from_spec", "to_spec",
        *[(F.col(f"__b_{v}") - F.col(f"__a_{v}")).alias(f"delta_{v}") for v in values],
    )


def symmetric_covariance(df: DataFrame, by: Sequence[str], value: str = "covariance") -> DataFrame:
    """Upper or full long matrix to the full one; pairs that disagree are an error."""
    upper = df.select(
        *by, F.least("factor_1", "factor_2").alias("f1"), F.greatest("factor_1", "factor_2").alias("f2"), value
    )
    merged = upper.groupBy(*by, "f1", "f2").agg(F.max(value).alias(value), F.min(value).alias("__low"))
    checked = merged.withColumn(
        value,
        F.when(F.col(value) == F.col("__low"), F.col(value)).otherwise(
            F.raise_error(F.concat(F.lit("conflicting covariance "), "f1", F.lit(" "), "f2"))
        ),
    )
    cells = F.when(
        F.col("f1") == F.col("f2"),
        F.array(F.struct(F.col("f1").alias("factor_1"), F.col("f2").alias("factor_2"))),
    ).otherwise(
        F.array(
            F.struct(F.col("f1").alias("factor_1"), F.col("f2").alias("factor_2")),
            F.struct(F.col("f2").alias("factor_1"), F.col("f1").alias("factor_2")),
        )
    )
    return checked.select(*by, value, F.inline(cells))


# Splits -----------------------------------------------------------------------------------------


def split_masks(df: DataFrame, split: Mapping[str, tuple[str, str]], day: str = "eom") -> DataFrame:
    return df.withColumns(
        {f"is_{name}": F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date")) for name, (a, b) in split.items()}
    )


def split_counts(df: DataFrame) -> DataFrame:
    a, b, c = F.col("is_train"), F.col("is_validation"), F.col("is_test")
    return df.agg(
        F.count_if(a).alias("train_rows"),
        F.count_if(b).alias("validation_rows"),
        F.count_if(c).alias("test_rows"),
        F.count_if((a & b) | (a & c) | (b & c)).alias("overlap_rows"),
    )


def rolling_splits(years: DataFrame, first_day: str, validation_years: int) -> DataFrame:
    """Train up to Y-V-1, validate Y-V..Y-1, test Y, one row per year and part."""
    y, v = F.col("test_year"), validation_years
    parts = F.array(
        F.struct(F.lit("train").alias("part"), F.lit(first_day).cast("date").alias("start"),
                 F.make_date(y - v - 1, F.lit(12), F.lit(31)).alias("end")),
        F.struct(F.lit("validation").alias("part"), F.make_date(y - v, F.lit(1), F.lit(1)).alias("start"),
                 F.make_date(y - 1, F.lit(12), F.lit(31)).alias("end")),
        F.struct(F.lit("test").alias("part"), F.make_date(y, F.lit(1), F.lit(1)).alias("start"),
                 F.make_date(y, F.lit(12), F.lit(31)).alias("end")),
    )
    return years.select("test_year", F.inline(parts))


def split_rows(df: DataFrame, splits: DataFrame, day: str = "eom") -> DataFrame:
    """Panel rows with each split they belong to; the split table has three rows per year."""
    inside = (F.col(day) >= F.col("start")) & (F.col(day) <= F.col("end"))
    return df.join(F.broadcast(splits), inside)


def training_rows(df: DataFrame, years: DataFrame, day: str = "eom") -> DataFrame:
    """Rows up to 30 November of the year before each test year."""
    cuts = years.select("test_year", F.make_date(F.col("test_year") - 1, F.lit(11), F.lit(30)).alias("__cut"))
    return df.join(F.broadcast(cuts), F.col(day) <= F.col("__cut")).drop("__cut")


def validation_window(months: DataFrame, by: Sequence[str], wanted: int) -> DataFrame:
    """The last ``wanted`` months there are (a calendar-sized table)."""
    back = F.row_number().over(W.partitionBy(*by).orderBy(F.col("eom").desc()))
    return months.withColumn("__back", back).where(F.col("__back") <= wanted).drop("__back")


def adaptive_window(months: DataFrame, by: Sequence[str], wanted: int, least_train: int, least_validation: int) -> DataFrame:
    """Known months of each test year with their ``part``: train or validation (a calendar-sized table).

    The last ``wanted`` months validate, or as many as leave ``least_train``; under ``least_validation`` all train.
    """
    group = W.partitionBy(*by)
    back = F.row_number().over(group.orderBy(F.col("eom").desc()))
    room = F.least(F.lit(wanted), F.count(F.lit(1)).over(group) - least_train)
    inside = (back <= room) & (room >= least_validation)
    return months.withColumn("part", F.when(inside, "validation").otherwise("train"))


def overlapping_periods(periods: DataFrame) -> DataFrame:
    """Pairs of a small period table that share a day."""
    a = periods.select(F.col("name").alias("left_name"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = periods.select(F.col("name").alias("right_name"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    hit = (F.col("left_name") < F.col("right_name")) & (F.greatest("s1", "s2") <= F.least("e1", "e2"))
    return a.join(b, hit).select("left_name", "right_name")


# Limits and sets --------------------------------------------------------------------------------


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Rows k by an order: each partition keeps k before the last merge."""
    return df.orderBy(*order).limit(k)


def first_best(df: DataFrame, by: Sequence[str], score: str, tie: str, keep: Sequence[str] = ()) -> DataFrame:
    """Best row of a group; a null score counts as minus infinity and the smallest ``tie`` wins.

    An aggregate, so it combines on the map side and no group is sorted.
    """
    value = F.coalesce(F.col(score), F.lit(float("-inf")))
    best = F.min_by(F.struct(F.col(tie), *[F.col(c) for c in keep if c != tie]), F.struct(-value, F.col(tie)))
    return df.groupBy(*by).agg(best.alias("__best")).select(*by, "__best.*")


def union_frames(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_semi")
