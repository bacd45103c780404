"""What a result rests on: importance by year, single rows that carry a rank correlation, evidence gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crosspanel import settings as S
from crosspanel.operators import performance, portfolio_ml, ranks

SCENARIO = ("penalty", "neutralized")


def superposed_positions(
    designed: DataFrame, beta: DataFrame, stats: DataFrame, x: Sequence[str], sets: Mapping[str, Sequence[str]],
    penalties: Sequence[float],
) -> DataFrame:
    """Carried positions of the policy for every penalty, with each set of features neutral in turn.

    A position is linear in its aim, and an aim is a sum over features, so one recursion per name carries the
    part of every (penalty, feature) as a vector; a neutral feature has a design of zero, and a scenario is the sum of
    the parts it keeps.  The panel is shuffled once, by name, before anything is multiplied by the scenarios.

    ``designed`` has eom, entity, test_year, design (one entry per feature of ``x``), speed and the ledger's inputs;
    ``beta`` has test_year, penalty, beta.  A year without coefficients of all penalties has no rows.  The result has
    the columns that ``ledger.evaluate`` reads, for the keys penalty and neutralized; names that leave are
    ``dropped`` rows of a null weight.
    """
    width = len(x)
    grid = F.array(*[F.try_element_at("by_penalty", F.lit(float(p))) for p in penalties])
    years = beta.groupBy("test_year").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("penalty").cast("double"), "beta"))).alias("by_penalty")
    ).select("test_year", grid.alias("coefficients")).where(F.forall("coefficients", lambda c: c.isNotNull()))
    rows = designed.join(F.broadcast(years), "test_year")
    parts = F.flatten(F.transform("coefficients", lambda c: F.zip_with("design", c, lambda d, v: d * v)))
    path = portfolio_ml.loadings(rows.withColumn("design", parts), stats)

    def kept(vector: str, at: int, gone: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for i, name in enumerate(x):
            if name not in gone:
                total = total + F.element_at(vector, at * width + i + 1)
        return F.when(F.col(vector).isNotNull(), total)

    scenarios = F.array(*[
        F.struct(
            F.lit(float(p)).alias("penalty"), F.lit(name).alias("neutralized"),
            kept("b", at, gone).alias("weight"), kept("inherited_b", at, gone).alias("inherited"),
        )
        for at, p in enumerate(penalties) for name, gone in sets.items()
    ])
    out = path.select(
        "eom", "entity", "ret_exc_lead1m", "variance", "dropped",
        F.when(~F.col("dropped"), F.col("lambda_adv")).alias("lambda_adv"),
        F.when(F.col("dropped"), F.col("lambda_adv")).alias("exit_lambda"), F.inline(scenarios),
    )
    out = out.withColumn("trade", F.col("weight") - F.col("inherited"))
    return ranks.attach(out, stats.select("eom", "t", "wealth_growth"), ["eom"], "inner")


def importance_by_year(returns: DataFrame, by: Sequence[str], baseline: str = "none", tag: str = "neutralized") -> DataFrame:
    """Full minus neutralised value of six outcomes, for the whole sample and each year.

    Full rows have a null test_year and the rank of the utility lost (ties share the smallest); year rows have no rank.
    A year that one side doesn't have has no row; an outcome that a side can't have (volatility of one month) is null.
    """
    full = performance.performance(returns, by=[*by, tag]).withColumns({"scope": F.lit("full"), "test_year": F.lit(None).cast("int")})
    year = performance.performance(returns, by=[*by, tag, "test_year"]).withColumn("scope", F.lit("year"))
    metrics = full.unionByName(year).select(*by, tag, "scope", "test_year", *S.IMPORTANCE_OUTCOMES.values())
    key = [*by, "scope", "test_year"]
    base = metrics.where(F.col(tag) == baseline).select(
        *[F.col(k).alias(f"__{k}") for k in key], *[F.col(m).alias(f"full_{m}") for m in S.IMPORTANCE_OUTCOMES.values()]
    )
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = metrics.where(F.col(tag) != baseline).join(F.broadcast(base), same).drop(*[f"__{k}" for k in key])
    rows = rows.withColumns({o: F.col(f"full_{m}") - F.col(m) for o, m in S.IMPORTANCE_OUTCOMES.items()})
    place = F.rank().over(W.partitionBy(*key).orderBy(F.col("delta_utility").desc()))  # one row per set
    return rows.withColumn("place", F.when(F.col("scope") == "full", place)).withColumnsRenamed(
        {m: f"neutralized_{m}" for m in S.IMPORTANCE_OUTCOMES.values()}
    )


def importance_concentration(table: DataFrame, by: Sequence[str], crisis: Sequence[int], value: str = "delta_utility") -> DataFrame:
    """Shares of the best years and of crisis years in the positive yearly differences; the year of the largest.

    Shares are null where no year is positive; of equal years the earliest is named.
    """
    years = table.where(F.col("scope") == "year")
    order = W.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), "test_year")  # one row per year
    gain = F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    rows = years.withColumns({"__rn": F.row_number().over(order), "__gain": gain})
    total = F.sum("__gain")
    share = lambda keep: F.when(total > 0, F.sum(F.when(keep, F.col("__gain")).otherwise(0.0)) / total)
    return rows.groupBy(*by).agg(
        *[share(F.col("__rn") <= k).alias(f"top_{k}_share") for k in (1, 3, 5)],
        share(F.col("test_year").isin(list(crisis))).alias("crisis_share"),
        F.count_if(F.col(value) > 0).alias("years_positive"),
        F.max(F.when(F.col("__rn") == 1, F.col("test_year"))).alias("largest_year"),
        F.max(F.when(F.col("__rn") == 1, F.col(value))).alias("largest_value"),
    )


def spearman_jackknife(df: DataFrame, by: Sequence[str], key: str, x: str, y: str) -> DataFrame:
    """Rank correlation of each group, and of the group without each of its rows in turn.

    Leaving out a row takes one from the rank of every larger value and a half from that of an equal one, so the
    sums of the ranks give every result: no ranking is done again and no pair of rows is shuffled.  Rows with
    a null or NaN value take no part; ties have average ranks; a group whose ranks don't vary, or of one row, has a
    null correlation.  Groups are feature-level: one row per feature.
    """
    known = F.lit(True)
    for c in (x, y):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(known)
    for c, name in ((x, "x"), (y, "y")):
        ties = F.count(F.lit(1)).over(W.partitionBy(*by, c))
        lowest = F.rank().over(W.partitionBy(*by).orderBy(c))  # feature-level: the group is one array below
        rows = rows.withColumns({f"__t{name}": ties, f"__r{name}": lowest + (ties - 1) / 2})
    item = F.struct(
        F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"),
        *[F.col(f"__{k}{n}").cast("double").alias(f"{k}{n}") for k in "rt" for n in "xy"],
    )
    groups = rows.groupBy(*by).agg(F.collect_list(item).alias("items"), F.count(F.lit(1)).cast("double").alias("__n"))
    add = lambda f: F.aggregate("items", F.lit(0.0), lambda acc, j: acc + f(j))
    squares = lambda n: n * (n + 1) * (2 * n + 1) / 6
    cube = lambda t: (t * t * t - t) / 12
    groups = groups.withColumns({
        "__xy": add(lambda j: j["rx"] * j["ry"]),
        **{f"__tie_{c}": add(lambda j, c=c: j[f"t{c}"] * j[f"t{c}"] - 1) / 12 for c in "xy"},
    })

    def correlation(n: Column, cross: Column, ties: Mapping[str, Column]) -> Column:
        mean = n * (n + 1) * (n + 1) / 4
        spread = [squares(n) - ties[c] - mean for c in "xy"]
        # All terms are quarters, so a group of ties alone has a spread of exactly zero.
        return F.when((spread[0] > 0) & (spread[1] > 0), (cross - mean) / F.sqrt(spread[0] * spread[1]))

    full = correlation(F.col("__n"), F.col("__xy"), {c: F.col(f"__tie_{c}") for c in "xy"})

    def without(i: Column) -> Column:
        half = lambda a, b: F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)
        cross = add(lambda j: (j["rx"] - half(j["x"], i["x"])) * (j["ry"] - half(j["y"], i["y"])))
        cross = cross - (i["rx"] - 0.5) * (i["ry"] - 0.5)
        ties = {c: F.col(f"__tie_{c}") - cube(i[f"t{c}"]) + cube(i[f"t{c}"] - 1) for c in "xy"}
        return F.struct(i["key"].alias("omitted"), correlation(F.col("__n") - 1, cross, ties).alias("leave_one_out"))

    out = groups.withColumn("full_sample", full).select(
        *by, (F.col("__n") - 1).cast("bigint").alias("n"), "full_sample", F.inline(F.transform("items", without))
    )
    return out.withColumn("change", F.abs(F.col("leave_one_out") - F.col("full_sample")))


def influence_summary(details: DataFrame, by: Sequence[str], named: str) -> DataFrame:
    """Range of the left-out correlations, how often they keep the sign, and the row that moves them most.

    A null correlation keeps no sign; of equal changes the first name counts.  ``named`` is one omission to report.
    """
    order = W.partitionBy(*by).orderBy(F.col("change").desc_nulls_last(), "omitted")  # one row per feature
    rows = details.withColumns({
        "__rn": F.row_number().over(order),
        "__same": F.coalesce((F.signum("leave_one_out") == F.signum("full_sample")).cast("double"), F.lit(0.0)),
    })
    first = F.col("__rn") == 1
    return rows.groupBy(*by).agg(
        F.max("full_sample").alias("full_sample"), F.min("leave_one_out").alias("minimum"),
        F.max("leave_one_out").alias("maximum"), F.percentile("leave_one_out", F.lit(0.5)).alias("median"),
        F.avg("__same").alias("sign_stability"), (F.min("__same") == 1.0).alias("sign_stable"),
        F.max(F.when(first, F.col("omitted"))).alias("most_influential"),
        F.max(F.when(first, F.col("change"))).alias("largest_change"),
        F.max(F.when(F.col("omitted") == named, F.col("leave_one_out"))).alias("named_omission"),
        F.count(F.lit(1)).alias("n"),
    )


def classify_evidence(
    summary: DataFrame, features: DataFrame, prior: DataFrame, methods: tuple[str, str], primary: str,
    trend: str, reversal: str, horizons: int = S.HORIZONS,
) -> DataFrame:
    """One row: the four gates, their parts, the case and the classification.

    ``summary`` is an ``influence_summary`` by (method, metric), whose full-sample values are the correlations;
    ``features`` has feature, sfm, first_reversal, first_decay, recovers, apr_12, h1_agree and target (importance under the
    first method); ``prior`` is one row with ``prior``, the correlation to improve on.  A gate with a missing
    input is not passed; a correlation that is missing is not positive.
    """
    one, two = methods
    yes = lambda c: F.coalesce(c, F.lit(False))
    is_primary = F.col("metric") == primary
    at = lambda m: F.max(F.when(is_primary & (F.col("method") == m), F.col("full_sample")))
    positive = lambda m: F.avg(F.when(F.col("method") == m, yes(F.col("full_sample") > 0).cast("double")))
    stable = yes(F.col("sign_stable")) & yes(F.col("largest_change") <= S.EVIDENCE_MAX_CHANGE)
    facts = summary.where(F.col("method").isin(one, two)).agg(
        at(one).alias("first_primary"), at(two).alias("second_primary"),
        positive(one).alias("first_positive_share"), positive(two).alias("second_positive_share"),
        yes(F.every(F.when(is_primary, stable))).alias("stability_pass"),
    )
    f = F.col("feature")
    holds = (
        (F.col("sfm") > 0) & (F.col("first_reversal") == horizons + 1) & (F.col("target") > 0)
    )
    turns = (
        (F.col("first_decay") == 2) & ~F.col("recovers") & (F.col("apr_12") < S.EVIDENCE_APR)
        & F.col("h1_agree") & (F.col("target") <= 0)
    )
    coherence = features.agg(
        yes(F.max(F.when(f == trend, holds))).alias("trend_coherent"),
        yes(F.max(F.when(f == reversal, turns))).alias("reversal_coherent"),
    )
    a, b = F.col("first_primary"), F.col("second_primary")
    least = F.least("first_positive_share", "second_positive_share")
    both = yes((a > 0) & (b > 0))
    rows = facts.join(coherence).join(F.broadcast(prior.select("prior"))).withColumns({
        "improvement_pass": yes(a >= F.col("prior") + S.EVIDENCE_IMPROVEMENT),
        "consistency_pass": both & yes(least >= S.EVIDENCE_POSITIVE_SHARE),
        "coherence_pass": F.col("trend_coherent") & F.col("reversal_coherent"),
    })
    case = F.col("improvement_pass") & F.col("consistency_pass") & F.col("stability_pass") & F.col("coherence_pass")
    strong = yes((a >= S.EVIDENCE_STRONG) & (b >= S.EVIDENCE_STRONG) & (least >= S.EVIDENCE_STRONG_SHARE))
    mixed = ~yes(F.signum(a) == F.signum(b)) | yes(least < S.EVIDENCE_WEAK_SHARE)
    texts = [F.lit(t) for t in S.EVIDENCE_TEXTS]
    return rows.withColumns({
        "decision": F.when(case, S.EVIDENCE_CASES[0]).otherwise(S.EVIDENCE_CASES[1]),
        "classification": F.when(case & strong, texts[0]).when(case, texts[1])
        .when(both & yes(least >= S.EVIDENCE_WEAK_SHARE) & F.col("coherence_pass"), texts[2])
        .when(mixed, texts[3]).otherwise(texts[4]),
    })
