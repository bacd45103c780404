"""Registered queries: net-utility policies on linear and random features, and selection among all policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosspanel import settings as S
from crosspanel.operators import learned, ledger, paths, performance, policy, regress, scaling, selection
from crosspanel.plans import base
from crosspanel.plans.models import SEED
from crosspanel.plans.policies import AUM, GRID_KEYS, GRID_OUT, STATIC_METHODS, UNI, _speed_sql, grid_returns
from crosspanel.plans.portfolio import METRICS
from crosspanel.plans.registry import register
from crosspanel.sources.panel import FEATURES

INPUTS = [f"rank_{f}" for f in FEATURES]
MAPS = learned.feature_maps(len(INPUTS), S.FEATURE_COUNTS, S.FEATURE_SCALES, SEED)


def months(spark, sf_dir) -> dict[int, int]:
    """Test years by month number."""
    rows = base.stats(spark, sf_dir).select("t", F.year("eom").alias("year")).collect()
    return {r.t: r.year for r in rows}


def names(spark, sf_dir) -> DataFrame:
    def build():
        rows = scaling.clean_volatility(
            base.universe(spark, sf_dir), "vol_12m", "volatility", group_rows=base.bound(spark, sf_dir)
        ).withColumns({
            "speed": policy.trading_speed(F.col("variance"), F.col("lambda_adv"), aum=AUM), "label": F.col("ret_exc_lead1m"),
            "features": F.array(*[F.coalesce(F.col(c), F.lit(S.NEUTRAL_RANK)) for c in INPUTS]),
        })
        return paths.entity_paths(rows, base.stats(spark, sf_dir), learned.NUMBERS, "features", learned.OPTIONAL)

    return base.shared(spark, sf_dir, "learned_paths", build)


_MOMENTS: dict[tuple[str, str], list] = {}


def moments(spark, sf_dir) -> list:
    """Month means and lengths of all features, once per application and data."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MOMENTS:
        _MOMENTS[key] = learned.moments(names(spark, sf_dir), len(months(spark, sf_dir)), len(INPUTS), MAPS)
    return _MOMENTS[key]


def statistics(spark, sf_dir) -> DataFrame:
    return base.shared(
        spark, sf_dir, "learned_statistics",
        lambda: learned.statistics(
            names(spark, sf_dir), base.stats(spark, sf_dir), len(months(spark, sf_dir)), len(INPUTS), MAPS, moments(spark, sf_dir), aum=AUM
        ),
    )


def fitted(spark, sf_dir) -> DataFrame:
    years = sorted(set(months(spark, sf_dir).values()))
    return base.shared(
        spark, sf_dir, "learned_fits",
        lambda: learned.fits(statistics(spark, sf_dir), years, len(INPUTS), MAPS, S.POLICY_LAMBDAS),
    )


def carried(spark, sf_dir) -> DataFrame:
    years = months(spark, sf_dir)
    rows = learned.priced_positions(
        names(spark, sf_dir), len(years), years, len(INPUTS), MAPS, moments(spark, sf_dir), fitted(spark, sf_dir).collect()
    )
    return learned.carried(rows, base.stats(spark, sf_dir))


def held(spark, sf_dir) -> DataFrame:
    return carried(spark, sf_dir).where("not dropped")


def returns(spark, sf_dir) -> DataFrame:
    """Monthly returns of all learned candidates."""
    return base.shared(
        spark, sf_dir, "learned_returns", lambda: ledger.evaluate(carried(spark, sf_dir), GRID_KEYS, AUM)
    )


# The features of all maps, by place in their bank; frequencies are literals, as in the operator.
def _angle(w) -> str:
    return " + ".join(f"coalesce({c}, 0.5e0) * {float(v)!r}e0".replace("e-05e0", "e-05") for c, v in zip(INPUTS, w))


def _features_sql() -> str:
    def row(kind, eta, k, value):
        return f"{{'kind': '{kind}', 'eta': {eta}, 'k': {k}, 'v': {value}}}"

    items = [row("linear", "CAST(NULL AS DOUBLE)", k, f"coalesce({c}, 0.5e0)") for k, c in enumerate(INPUTS)]
    for m in MAPS[1:]:
        half = m.weights.shape[1]
        for part, fn in enumerate(("cos", "sin")):
            items += [
                row("rf", f"{m.eta!r}e0", part * half + k, f"{fn}({_angle(m.weights[:, k])}) / sqrt({2 * half}e0)")
                for k in range(half)
            ]
    return f"[{', '.join(items)}]"


FEATURE_MOMENTS = f"""{UNI},
mapped AS MATERIALIZED (SELECT eom, t, entity, f.kind AS kind, f.eta AS eta, CAST(f.k AS INTEGER) AS k, f.v AS v
  FROM (SELECT eom, t, entity, unnest({_features_sql()}) AS f FROM uni JOIN growth USING (eom))),
fmeans AS (SELECT kind, eta, k, eom, t, count(*) AS n, avg(v) AS mean FROM mapped GROUP BY ALL),
fmoments AS MATERIALIZED (SELECT m.kind, m.eta, m.k, m.eom, m.t, any_value(n) AS n, any_value(mean) AS mean, sqrt(sum(pow(v - mean, 2))) AS length
  FROM mapped m JOIN fmeans f ON f.kind = m.kind AND f.eta IS NOT DISTINCT FROM m.eta AND f.k = m.k AND f.t = m.t GROUP BY ALL)"""
DIAGONALS = f"""{FEATURE_MOMENTS},
speeds AS ({_speed_sql()}),
bases AS MATERIALIZED (SELECT entity, t, speed, variance, lambda_adv, ret_exc_lead1m, (1e0 + coalesce(ret_exc_lead1m, 0e0)) / growth AS lift,
  coalesce(CASE WHEN vol_12m >= 0.01e0 THEN vol_12m END, median(CASE WHEN vol_12m >= 0.01e0 THEN vol_12m END) OVER (PARTITION BY eom), 0.05e0) AS v FROM speeds JOIN growth USING (eom)),
runs AS MATERIALIZED (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY t) AS run FROM
  (SELECT *, coalesce(lag(t) OVER (PARTITION BY entity ORDER BY t) = t - 1, false) AS follows, coalesce(lead(t) OVER (PARTITION BY entity ORDER BY t) = t + 1, false) AS stays FROM bases)),
designs AS MATERIALIZED (SELECT r.*, m.kind, m.eta, m.k, CASE WHEN length > 1e-12 THEN (m.v - mean) / length ELSE 0e0 END / r.v AS x
  FROM mapped m JOIN fmoments f ON f.kind = m.kind AND f.eta IS NOT DISTINCT FROM m.eta AND f.k = m.k AND f.t = m.t JOIN runs r ON r.entity = m.entity AND r.t = m.t),
bscan AS (
  SELECT entity, t, kind, eta, k, 0e0 AS i, (1 - speed) * x AS b, lift FROM designs WHERE NOT follows
  UNION ALL SELECT n.entity, n.t, n.kind, n.eta, n.k, p.b * p.lift, n.speed * (p.b * p.lift) + (1 - n.speed) * n.x, n.lift
  FROM bscan p JOIN designs n ON n.entity = p.entity AND n.t = p.t + 1 AND n.kind = p.kind AND n.eta IS NOT DISTINCT FROM p.eta AND n.k = p.k AND n.follows),
loaded AS MATERIALIZED (SELECT s.*, r.variance, r.lambda_adv, r.ret_exc_lead1m, r.stays FROM bscan s JOIN runs r USING (entity, t)),
diagonals AS (SELECT l.kind, l.eta, l.k, l.t, l.xx + coalesce(e.xx, 0e0) AS xx, l.xy FROM
  (SELECT kind, eta, k, t, sum(1e1 * variance * b * b + 1e5 * lambda_adv * (b - i) * (b - i)) AS xx, coalesce(sum(b * ret_exc_lead1m), 0e0) AS xy FROM loaded GROUP BY ALL) l
  LEFT JOIN (SELECT kind, eta, k, t + 1 AS t, sum(1e5 * lambda_adv * b * b * lift * lift) AS xx FROM loaded WHERE NOT stays GROUP BY ALL) e
  ON e.kind = l.kind AND e.eta IS NOT DISTINCT FROM l.eta AND e.k = l.k AND e.t = l.t)"""


@register(
    "learned_moments",
    "kind eta:2 k eom n:bigint mean:9 length:8",
    "SELECT kind, eta, k, eom, n, mean, length FROM fmoments",
    FEATURE_MOMENTS,
)
def learned_moments(spark, sf_dir):
    """Month mean and length of each of six ranks and of the random features of two scales."""
    calendar = base.stats(spark, sf_dir).select("t", "eom").orderBy("t").collect()
    rows = [
        (m.kind, m.eta, k, calendar[t].eom, int(counts[t]), float(means[t, k]), float(lengths[t, k]))
        for m, (counts, means, lengths) in zip(MAPS, moments(spark, sf_dir))
        for t in range(len(calendar))
        for k in range(means.shape[1])
    ]
    return spark.createDataFrame(rows, "kind string, eta double, k int, eom date, n long, mean double, length double")


@register(
    "learned_statistics",
    "kind eta:2 k eom xx:5 xy:7",
    "SELECT kind, eta, k, eom, xx, xy FROM diagonals JOIN growth USING (t)",
    DIAGONALS,
)
def learned_statistics(spark, sf_dir):
    """Diagonal of the utility sums, and the reward, by map, feature and month."""
    parts = F.flatten(F.transform("parts", lambda p: p["values"]))
    cases = []
    for i, m in enumerate(MAPS):
        width = 1 + m.width(len(INPUTS))
        cells = width * (width + 1) // 2
        # Row k of the upper triangle begins after the rows before it; place 0 is the constant.
        at = lambda k, width=width: k * width - k * (k - 1) // 2
        items = F.array(*[
            F.struct(
                F.lit(m.kind).alias("kind"), F.lit(m.eta).cast("double").alias("eta"), F.lit(k).alias("k"),
                F.col("all")[at(k + 1)].alias("xx"), F.col("all")[cells + k + 1].alias("xy"),
            ) for k in range(width - 1)
        ])
        rows = statistics(spark, sf_dir).where(F.col("map") == i).select("eom", parts.alias("all"))
        cases.append(rows.select("eom", F.inline(items)))
    out = cases[0]
    for c in cases[1:]:
        out = out.unionByName(c)
    return out


@register("learned_fits", "kind eta:2 p penalty:2 test_year n:bigint beta_norm:8 objective:10 gradient_norm:8")
def learned_fits(spark, sf_dir):
    """Coefficients of every map, width, penalty and test year; a year without history has a null fit."""
    return fitted(spark, sf_dir)


@register("learned_positions", "method candidate eom entity aim_weight:8 weight:8 inherited:8")
def learned_positions(spark, sf_dir):
    """Positions of thirty learned candidates, each trading towards its aim from what it carries."""
    return held(spark, sf_dir)


@register("learned_ledger", GRID_OUT)
def learned_ledger(spark, sf_dir):
    return returns(spark, sf_dir)


@register("learned_metrics", f"method candidate {METRICS}")
def learned_metrics(spark, sf_dir):
    return performance.performance(returns(spark, sf_dir), by=GRID_KEYS)


def all_selected(spark, sf_dir) -> DataFrame:
    rows = grid_returns(spark, sf_dir).unionByName(returns(spark, sf_dir), allowMissingColumns=True)
    return selection.select_cumulative(rows, STATIC_METHODS)


@register(
    "select_learned",
    "method candidate test_year score:10 validation_months:bigint validation_years:bigint latest_validation_year selected future_information_used",
)
def select_learned(spark, sf_dir):
    """Walk-forward choice within static methods by mean-variance, within learned ones by utility flow."""
    return all_selected(spark, sf_dir)
