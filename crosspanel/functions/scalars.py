"""Column expressions: casts, finite guards, calendar buckets, labels, parameters as JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

INFINITY = float("inf")

# Calendar bucket labels.
CRISIS_LABELS = {
    "global_financial_crisis_2008_2009": (2008, 2009),
    "covid_2020": (2020,),
    "inflation_tightening_2022": (2022,),
}


def to_numeric(text: Column) -> Column:
    """Text to double; unreadable text is null."""
    return text.try_cast("double")


def to_date(text: Column) -> Column:
    """Text to date; unreadable text is null."""
    return text.try_cast("date")


def is_finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < INFINITY), F.lit(False))


def finite(value: Column) -> Column:
    return F.when(is_finite(value), value)


def neutral_fill(value: Column, fill: float = 0.5) -> Column:
    return F.coalesce(finite(value), F.lit(fill))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp; a null stays null."""
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def difference(a: Column, b: Column) -> Column:
    """Absolute difference; infinite when exactly one side is null, zero when both are."""
    one_sided = a.isNull() != b.isNull()
    return F.when(one_sided, F.lit(INFINITY)).otherwise(F.coalesce(F.abs(a - b), F.lit(0.0)))


def month_end(day: Column, months: int | Column = 0) -> Column:
    """Month end ``months`` months away."""
    return F.last_day(F.add_months(day, months))


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def date_between(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range on a named date column; an open end is allowed."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def in_years(df: DataFrame, years: Sequence[int], column: str = "eom") -> DataFrame:
    return df.where(F.year(column).isin(list(years)))


def exclude_years(df: DataFrame, years: Sequence[int], column: str = "eom") -> DataFrame:
    return df.where(~F.year(column).isin(list(years)))


def five_year_period(year: Column) -> Column:
    return (
        F.when(year.between(2005, 2009), "2005-2009")
        .when(year.between(2010, 2014), "2010-2014")
        .when(year.between(2015, 2019), "2015-2019")
        .otherwise("2020-2024")
    )


def crisis_label(year: Column, labels: Mapping[str, Sequence[int]] = CRISIS_LABELS) -> Column:
    out = F.lit("non_crisis")
    for label, years in labels.items():
        out = F.when(year.isin(list(years)), label).otherwise(out)
    return out


def parse_params(text: Column, fields: Mapping[str, str]) -> Column:
    """JSON text to a struct with the given fields and types."""
    return F.from_json(text, ", ".join(f"{name} {kind}" for name, kind in fields.items()))


def params_text(fields: Mapping[str, Column]) -> Column:
    """Struct to JSON text with sorted keys."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))


def candidate_id(method: Column, text: Column) -> Column:
    """First 16 hex digits of the content hash of a method and its parameter text."""
    return F.substring(F.sha2(F.concat(method, F.lit("|"), text), 256), 1, 16)


def map_labels(df: DataFrame, column: str, labels: Mapping[str, str], output: str) -> DataFrame:
    """Known values get their label, others keep their own text."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    lookup = F.create_map(*pairs)
    return df.withColumn(output, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def sort_by_label(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Order rows by the place of a label in a list; unknown labels last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)
