"""Registered queries: sufficient statistics, ridge models, predictions, daily factor models."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel import settings as S
from crosspanel.operators import performance, ranks, regress, scaling, signals
from crosspanel.plans import base
from crosspanel.plans.registry import register
from crosspanel.plans.sqltext import FEATURES, UNIVERSE, WEIGHTS, panel_ctes
from crosspanel.sources.panel import THEMES, read

PANEL = panel_ctes()
HELD = f"{PANEL},{UNIVERSE},{WEIGHTS}"
X2 = ["rank_discount", "rank_momentum"]
LABEL = "ret_exc_lead1m"
PENALTIES = (0.01, 0.1, 1.0, 10.0)


def ridge_sql(source: str, by: str, lam: str, x1: str = "rank_discount", x2: str = "rank_momentum", y: str = LABEL, standard: bool = True) -> str:
    """Two-feature ridge by Cramer's rule on population moments, one row per ``by`` and penalty."""
    s1 = "CASE WHEN v1 < 1e-20 THEN 1e0 ELSE sqrt(v1) END" if standard else "1e0"
    s2 = "CASE WHEN v2 < 1e-20 THEN 1e0 ELSE sqrt(v2) END" if standard else "1e0"
    return f"""
  SELECT {by}, penalty, n, my - m1 * b1 - m2 * b2 AS b0, b1, b2 FROM (
    SELECT *, (r1 * a22 - r2 * a12) / (a11 * a22 - a12 * a12) / s1 AS b1, (r2 * a11 - r1 * a12) / (a11 * a22 - a12 * a12) / s2 AS b2 FROM (
      SELECT *, v1 / (s1 * s1) + penalty AS a11, v2 / (s2 * s2) + penalty AS a22, c12 / (s1 * s2) AS a12, c1 / s1 AS r1, c2 / s2 AS r2 FROM (
        SELECT *, {s1} AS s1, {s2} AS s2 FROM (
          SELECT {by}, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, var_pop({x1}) AS v1, var_pop({x2}) AS v2,
            covar_pop({x1}, {x2}) AS c12, covar_pop({x1}, {y}) AS c1, covar_pop({x2}, {y}) AS c2
          FROM {source} WHERE {y} IS NOT NULL GROUP BY {by}) CROSS JOIN (SELECT unnest([{lam}]) AS penalty))))"""


LAMBDAS = ", ".join(f"{p!r}::DOUBLE" for p in PENALTIES)
HISTORY = f"""{PANEL},
history AS (
  SELECT p.*, y.test_year, CASE WHEN back <= 12 THEN 'validation' ELSE 'train' END AS part FROM panel p JOIN
    (SELECT eom, test_year, row_number() OVER (PARTITION BY test_year ORDER BY eom DESC) AS back FROM (SELECT eom FROM panel GROUP BY eom HAVING count({LABEL}) > 0)
     JOIN (SELECT DISTINCT CAST(year(eom) AS INTEGER) AS test_year FROM panel) ON eom <= make_date(test_year - 1, 11, 30)) y USING (eom)),
trained AS ({ridge_sql("(SELECT * FROM history WHERE part = 'train')", "test_year", LAMBDAS)}),
refit AS ({ridge_sql("history", "test_year", LAMBDAS)}),
scored AS (
  SELECT h.test_year, t.penalty, avg(pow(b0 + b1 * rank_discount + b2 * rank_momentum - {LABEL}, 2)) AS validation_mse
  FROM history h JOIN trained t ON h.test_year = t.test_year AND part = 'validation' WHERE {LABEL} IS NOT NULL GROUP BY 1, 2),
model AS (
  SELECT s.test_year, s.penalty, s.validation_mse, row_number() OVER (PARTITION BY s.test_year ORDER BY validation_mse, s.penalty) = 1 AS selected, b0, b1, b2
  FROM scored s JOIN refit r ON s.test_year = r.test_year AND s.penalty = r.penalty),
predictions AS (
  SELECT p.*, m.test_year, m.validation_mse, b0 + b1 * rank_discount + b2 * rank_momentum AS mu_hat FROM panel p JOIN model m ON selected AND year(p.eom) = m.test_year)"""


def _model(spark, sf_dir):
    rows = base.panel(spark, sf_dir)
    return regress.return_model_by_year(rows, X2, LABEL, PENALTIES, validation_months=12)


def _coefficients(df):
    return df.select(
        "*", F.element_at("coef", 1).alias("b0"), F.element_at("coef", 2).alias("b1"), F.element_at("coef", 3).alias("b2")
    )


def _predictions(spark, sf_dir):
    chosen = base.shared(spark, sf_dir, "chosen_model", lambda: _model(spark, sf_dir).where("selected"))
    rows = base.panel(spark, sf_dir).withColumn("test_year", F.year("eom"))
    return regress.predict(rows, chosen, X2, ["test_year"])


@register(
    "gram",
    "eom n xx_11:8 xx_12:8 xx_22:8 xy_0:8 xy_1:8 yy:8",
    f"SELECT eom, count(*) AS n, sum(rank_discount * rank_discount) AS xx_11, sum(rank_discount * rank_momentum) AS xx_12, sum(rank_momentum * rank_momentum) AS xx_22, sum({LABEL}) AS xy_0, sum(rank_discount * {LABEL}) AS xy_1, sum({LABEL} * {LABEL}) AS yy FROM panel WHERE {LABEL} IS NOT NULL GROUP BY eom",
    PANEL,
)
def gram(spark, sf_dir):
    """Month moments; xx is packed (00, 01, 02, 11, 12, 22)."""
    m = regress.gram(base.panel(spark, sf_dir), X2, LABEL, ["eom"])
    return m.select(
        "eom", "n", F.col("xx")[3].alias("xx_11"), F.col("xx")[4].alias("xx_12"), F.col("xx")[5].alias("xx_22"),
        F.col("xy")[0].alias("xy_0"), F.col("xy")[1].alias("xy_1"), "yy",
    )


@register(
    "running_gram",
    "eom n:bigint xx_11:8 xx_12:8 xy_2:8",
    f"SELECT eom, CAST(sum(n) OVER w AS BIGINT) AS n, sum(a) OVER w AS xx_11, sum(b) OVER w AS xx_12, sum(c) OVER w AS xy_2 FROM (SELECT eom, count(*) AS n, sum(rank_discount * rank_discount) AS a, sum(rank_discount * rank_momentum) AS b, sum(rank_momentum * {LABEL}) AS c FROM panel WHERE {LABEL} IS NOT NULL GROUP BY eom) WINDOW w AS (ORDER BY eom)",
    PANEL,
)
def running_gram(spark, sf_dir):
    """Moments of every expanding window at once."""
    m = regress.running_gram(regress.gram(base.panel(spark, sf_dir), X2, LABEL, ["eom"]), "eom")
    return m.select("eom", "n", F.col("xx")[3].alias("xx_11"), F.col("xx")[4].alias("xx_12"), F.col("xy")[2].alias("xy_2"))


@register(
    "gram_wide",
    "year n:bigint xx_11:8 xx_last:8 xy_last:8",
    f"SELECT CAST(year(eom) AS INTEGER) AS year, count(*) AS n, sum(rank_discount * rank_discount) AS xx_11, sum(rank_tax * rank_tax * rank_momentum * rank_momentum) AS xx_last, sum(rank_tax * rank_momentum * {LABEL}) AS xy_last FROM panel WHERE {LABEL} IS NOT NULL GROUP BY 1",
    PANEL,
)
def gram_wide(spark, sf_dir):
    """Moments of a design too wide for expressions: all features and their products."""
    names = [f"rank_{f}" for f in FEATURES]
    crossed = {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(names) for b in names[i:]}
    rows = base.panel(spark, sf_dir).withColumns(crossed).withColumn("year", F.year("eom"))
    wide = [n for n in [*names, *crossed] if n != "rank_tax_x_rank_momentum"] + ["rank_tax_x_rank_momentum"]
    m = regress.gram(rows, wide, LABEL, ["year"])
    k = len(wide) + 1
    return m.select(
        "year", "n", F.element_at("xx", k + 1).alias("xx_11"), F.element_at("xx", -1).alias("xx_last"),
        F.element_at("xy", -1).alias("xy_last"),
    )


@register(
    "ridge_fit",
    "year penalty n:bigint b0:8 b1:8 b2:8",
    ridge_sql("(SELECT *, CAST(year(eom) AS INTEGER) AS year FROM panel)", "year", LAMBDAS),
    PANEL,
)
def ridge_fit(spark, sf_dir):
    rows = base.panel(spark, sf_dir).withColumn("year", F.year("eom"))
    moments = regress.gram(rows, X2, LABEL, ["year"])
    return _coefficients(regress.ridge_fit(regress.grid(moments, penalty=list(PENALTIES)), "penalty"))


@register(
    "return_model_by_year",
    "test_year penalty validation_mse:10 selected b0:8 b1:8 b2:8",
    "SELECT * FROM model",
    HISTORY,
)
def return_model_by_year(spark, sf_dir):
    """Expanding fits, validation on the last year before November, refit on all history."""
    return _coefficients(_model(spark, sf_dir))


@register("predict", "eom entity mu_hat:8", "SELECT * FROM predictions", HISTORY)
def predict(spark, sf_dir):
    return _predictions(spark, sf_dir)


@register(
    "prediction_diagnostics",
    "test_year prediction_mean:8 mean_prediction_std:8 mean_rank_ic:8 test_mse:8",
    f"SELECT test_year, sum(mean_mu * n) / sum(n) AS prediction_mean, avg(sd) AS mean_prediction_std, avg(ic) AS mean_rank_ic, sum(sq) / sum(labelled) AS test_mse FROM "
    f"(SELECT test_year, eom, count(*) AS n, avg(mu_hat) AS mean_mu, stddev_samp(mu_hat) AS sd, corr(CASE WHEN {LABEL} IS NOT NULL THEN rm END, ry) AS ic, sum(pow(mu_hat - {LABEL}, 2)) AS sq, count({LABEL}) AS labelled FROM "
    f"(SELECT *, rank() OVER (PARTITION BY eom ORDER BY round(mu_hat, 12)) + (count(*) OVER (PARTITION BY eom, round(mu_hat, 12)) - 1) / 2e0 AS rm, "
    f"CASE WHEN {LABEL} IS NOT NULL THEN rank() OVER (PARTITION BY eom ORDER BY {LABEL} NULLS LAST) + (count(*) OVER (PARTITION BY eom, {LABEL}) - 1) / 2e0 END AS ry FROM predictions) GROUP BY 1, 2) GROUP BY 1",
    HISTORY,
)
def prediction_diagnostics(spark, sf_dir):
    """Mean, spread, rank correlation and error of the predictions by year (ties at 12 places)."""
    rows = _predictions(spark, sf_dir).withColumn("mu_key", F.round("mu_hat", 12))
    return signals.prediction_diagnostics(rows, "mu_hat", "mu_key", LABEL, base.bound(spark, sf_dir))


SEED, MAPS, SCALE = 7, 8, 0.5


def _rf_sql() -> str:
    w = regress.random_weights(2, MAPS, SCALE, SEED, bank=64)
    half = MAPS // 2
    parts = []
    for k in range(half):
        angle = f"(rank_discount * {float(w[0, k])!r}::DOUBLE + rank_momentum * {float(w[1, k])!r}::DOUBLE)"
        parts += [f"cos({angle}) / sqrt({MAPS}) AS f{k}", f"sin({angle}) / sqrt({MAPS}) AS f{half + k}"]
    return f"SELECT entity, eom, {', '.join(parts)} FROM panel"


@register("random_features", "entity eom " + " ".join(f"f{k}:8" for k in range(MAPS)), _rf_sql(), PANEL)
def random_features(spark, sf_dir):
    """Random Fourier features with a fixed draw, as plain expressions."""
    w = regress.random_weights(2, MAPS, SCALE, SEED, bank=64)
    return regress.random_features(base.panel(spark, sf_dir), X2, w)


@register(
    "parameter_grid",
    "segment kind penalty p eta:2",
    "SELECT c_mktsegment AS segment, 'ridge' AS kind, penalty, CAST(NULL AS INTEGER) AS p, CAST(NULL AS DOUBLE) AS eta FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT unnest([0.01, 0.1, 1, 10, 100, 1000]::DOUBLE[]) AS penalty) "
    "UNION ALL SELECT c_mktsegment, 'rf_ridge', penalty, p, eta FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT unnest([0.01, 0.1, 1, 10, 100, 1000]::DOUBLE[]) AS penalty) CROSS JOIN (SELECT unnest([32, 64]) AS p) CROSS JOIN (SELECT unnest([0.1, 0.5]::DOUBLE[]) AS eta)",
)
def parameter_grid(spark, sf_dir):
    """The hyper-parameter grid of the return model for each market segment."""
    segments = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    linear = regress.grid(segments, kind=["ridge"], penalty=list(S.RETURN_LAMBDAS))
    random = regress.grid(
        segments, kind=["rf_ridge"], p=list(S.FEATURE_COUNTS), eta=list(S.FEATURE_SCALES), penalty=list(S.RETURN_LAMBDAS)
    )
    return linear.unionByName(random, allowMissingColumns=True)


RECOVER = f"""{HELD},
aims AS (SELECT eom, entity, CAST(year(eom) AS INTEGER) AS year, 0.4e0 * rank_discount - 0.3e0 * rank_momentum + 0.1e0 * rank_tax AS aim, rank_discount, rank_momentum
  FROM panel),
beta AS ({ridge_sql("aims", "year", "0::DOUBLE", y="aim", standard=False)})"""


def _aims(spark, sf_dir):
    """Aim weights that two features explain only in part."""
    rows = base.panel(spark, sf_dir)
    aim = F.lit(0.4) * F.col("rank_discount") - F.lit(0.3) * F.col("rank_momentum") + F.lit(0.1) * F.col("rank_tax")
    return rows.select("eom", "entity", F.year("eom").alias("year"), aim.alias("aim"), *X2)


@register(
    "recover_beta",
    "year b0:8 b1:8 b2:8 max_error:8",
    "SELECT year, b0, b1, b2, max(abs(aim - b0 - b1 * rank_discount - b2 * rank_momentum)) AS max_error FROM aims JOIN beta USING (year) GROUP BY 1, 2, 3, 4",
    RECOVER,
)
def recover_beta(spark, sf_dir):
    """Coefficients by year from saved aim weights, and the largest misfit."""
    rows = _aims(spark, sf_dir)
    fits = regress.least_squares(regress.gram(rows, X2, "aim", ["year"])).select("year", "coef")
    fitted = regress.predict(rows, fits, X2, ["year"], "fitted")
    errors = fitted.groupBy("year").agg(F.max(F.abs(F.col("aim") - F.col("fitted"))).alias("max_error"))
    return _coefficients(fits).join(errors, "year")


@register(
    "contributions",
    "year feature mean_abs:8 mean_signed:8 share:8",
    "SELECT year, feature, mean_abs, mean_signed, mean_abs / sum(mean_abs) OVER (PARTITION BY year) AS share FROM (SELECT year, 'rank_discount' AS feature, avg(abs(b1 * rank_discount)) AS mean_abs, avg(b1 * rank_discount) AS mean_signed FROM aims JOIN beta USING (year) GROUP BY 1 "
    "UNION ALL SELECT year, 'rank_momentum', avg(abs(b2 * rank_momentum)), avg(b2 * rank_momentum) FROM aims JOIN beta USING (year) GROUP BY 1)",
    RECOVER,
)
def contributions(spark, sf_dir):
    rows = _aims(spark, sf_dir)
    fits = regress.least_squares(regress.gram(rows, X2, "aim", ["year"])).select("year", "coef")
    return regress.contributions(rows, fits, X2, ["year"], ["year"])


USER_DAYS = """
user_days AS (
  SELECT user_id, CAST(ts AS DATE) AS date, greatest(least(sum(CAST(round(value * 100) AS BIGINT)) / 100e0 / count(*) / 100e0 - 0.3e0, 0.5e0), -0.5e0) AS ret,
    count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE AS buys, count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE AS errors
  FROM events GROUP BY 1, 2),
clipped AS (
  SELECT user_id, date, ret, greatest(least(buys, b_hi), b_lo) AS buys, greatest(least(errors, e_hi), e_lo) AS errors FROM user_days JOIN
    (SELECT date, quantile_cont(buys, 0.01) AS b_lo, quantile_cont(buys, 0.99) AS b_hi, quantile_cont(errors, 0.01) AS e_lo, quantile_cont(errors, 0.99) AS e_hi FROM user_days GROUP BY 1) USING (date))"""


def _user_days(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    daily = rows.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.lit(100.0) / F.count(F.lit(1)) / F.lit(100.0) - 0.3).alias("ret"),
        (F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("buys"),
        (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("errors"),
    )
    return daily.withColumn("ret", F.greatest(F.least("ret", F.lit(0.5)), F.lit(-0.5)))


@register(
    "factor_returns",
    "date factor n:bigint factor_return:8",
    f"SELECT date, factor, n, factor_return FROM ({ridge_sql('clipped', 'date', '0.001::DOUBLE', 'buys', 'errors', 'ret', standard=False)}) r, LATERAL (VALUES ('intercept', b0), ('buys', b1), ('errors', b2)) v(factor, factor_return)",
    USER_DAYS,
)
def factor_returns(spark, sf_dir):
    """Daily cross-sectional ridge on clipped exposures."""
    daily = _user_days(spark, sf_dir)
    rows = ranks.largest_group(daily, ["date"])
    clean = regress.winsorise(daily, ["buys", "errors"], 0.01, 0.99, ["date"], rows)
    return regress.factor_returns(clean, ["buys", "errors"], "ret", 0.001)


@register(
    "factor_residuals",
    "date user_id fitted:8 residual:8",
    f"SELECT date, user_id, b0 + b1 * buys + b2 * errors AS fitted, ret - (b0 + b1 * buys + b2 * errors) AS residual FROM clipped JOIN ({ridge_sql('clipped', 'date', '0.001::DOUBLE', 'buys', 'errors', 'ret', standard=False)}) r USING (date)",
    USER_DAYS,
)
def factor_residuals(spark, sf_dir):
    """What the day's factors leave of every user's return."""
    daily = _user_days(spark, sf_dir)
    clean = regress.winsorise(daily, ["buys", "errors"], 0.01, 0.99, ["date"], ranks.largest_group(daily, ["date"]))
    return regress.factor_residuals(clean, ["buys", "errors"], "ret", 0.001)


IDIO_LEAST = 20
SUPPLIER_DAYS = f"""
supplier_days AS (
  SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS date, greatest(least((sum(CAST(l_quantity AS BIGINT)) / count(*)::DOUBLE - 25.5e0) / 50e0, 0.5e0), -0.5e0) AS ret,
    sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 100e0) AS disc, sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 100e0) AS tax
  FROM lineitem GROUP BY 1, 2),
supplier_clipped AS (
  SELECT supplier, date, ret, greatest(least(disc, d_hi), d_lo) AS disc, greatest(least(tax, t_hi), t_lo) AS tax FROM supplier_days JOIN
    (SELECT date, quantile_cont(disc, 0.01) AS d_lo, quantile_cont(disc, 0.99) AS d_hi, quantile_cont(tax, 0.01) AS t_lo, quantile_cont(tax, 0.99) AS t_hi FROM supplier_days GROUP BY 1) USING (date)),
left_over AS (
  SELECT supplier, date, ret - (b0 + b1 * disc + b2 * tax) AS residual FROM supplier_clipped
  JOIN ({ridge_sql('supplier_clipped', 'date', '0.001::DOUBLE', 'disc', 'tax', 'ret', standard=False)}) r USING (date)),
aged AS (SELECT l.*, pow(1e0 - 2e0 / {S.EWMA_SPAN + 1}e0, -k::DOUBLE) AS w FROM left_over l JOIN (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM left_over)) USING (date)),
decayed AS (SELECT supplier, date, count(*) OVER r AS seen, sum(w * residual * residual) OVER r / sum(w) OVER r - pow(sum(w * residual) OVER r / sum(w) OVER r, 2) AS variance FROM aged WINDOW r AS (PARTITION BY supplier ORDER BY date))"""


@register(
    "idiosyncratic_variance",
    "supplier eom days observations idio_var:10",
    f"SELECT supplier, CAST(last_day(date) AS DATE) AS eom, count(*) AS days, max(seen) AS observations, CASE WHEN max(seen) >= {IDIO_LEAST} THEN greatest(arg_max(variance, date), 0e0) END AS idio_var FROM decayed GROUP BY 1, 2",
    SUPPLIER_DAYS,
)
def idiosyncratic_variance(spark, sf_dir):
    """Month-end decayed variance of what the day's factors leave of a supplier's shipments."""
    n = F.count(F.lit(1))
    points = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")) / (n * F.lit(100.0))
    daily = read(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("supplier"), F.to_date("l_shipdate").alias("date")
    ).agg(
        ((F.sum(F.col("l_quantity").cast("bigint")) / n - F.lit(25.5)) / F.lit(50.0)).alias("ret"),
        points("l_discount").alias("disc"), points("l_tax").alias("tax"),
    ).withColumn("ret", F.greatest(F.least("ret", F.lit(0.5)), F.lit(-0.5)))
    clean = regress.winsorise(daily, ["disc", "tax"], 0.01, 0.99, ["date"], ranks.largest_group(daily, ["date"]))
    left = regress.factor_residuals(clean, ["disc", "tax"], "ret", 0.001)
    return regress.idiosyncratic_variance(left, "supplier", "date", S.EWMA_SPAN, IDIO_LEAST)


FACTORS = """
daily_lines AS (
  SELECT CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 100e0) - 0.05e0 AS f_discount, sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 100e0) - 0.04e0 AS f_tax,
    sum(CAST(l_quantity AS BIGINT)) / (count(*) * 1000e0) - 0.0255e0 AS f_qty FROM lineitem GROUP BY 1),
factor_days AS (SELECT date, factor, factor_return FROM daily_lines, LATERAL (VALUES ('rank_discount', f_discount), ('rank_tax', f_tax), ('intercept', f_qty)) v(factor, factor_return))"""


def factor_days(spark, sf_dir):
    """Daily factor return series from the ship dates: (date, factor, factor_return)."""
    lines = F.count(F.lit(1))
    points = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")) / (lines * F.lit(100.0))
    rows = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        (points("l_discount") - F.lit(0.05)).alias("rank_discount"),
        (points("l_tax") - F.lit(0.04)).alias("rank_tax"),
        (F.sum(F.col("l_quantity").cast("bigint")) / (lines * F.lit(1000.0)) - F.lit(0.0255)).alias("intercept"),
    )
    names = ("rank_discount", "rank_tax", "intercept")
    items = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("factor_return")) for n in names])
    return rows.select("date", F.inline(items))


def monthly_covariance(spark, sf_dir, span=S.EWMA_SPAN):
    """Month-end exponentially weighted factor covariance, upper triangle."""
    days = factor_days(spark, sf_dir)
    a = days.select("date", F.col("factor").alias("factor_1"), F.col("factor_return").alias("x"))
    b = days.select("date", F.col("factor").alias("factor_2"), F.col("factor_return").alias("y"))
    pairs = a.join(b, "date").where("factor_1 <= factor_2")
    every_day = regress.ewma_moments(pairs, ["factor_1", "factor_2"], "date", "x", "y", span)
    return every_day.groupBy("factor_1", "factor_2", F.last_day("date").alias("eom")).agg(
        F.max_by("covariance", "date").alias("covariance")
    )


EWMA = f"""{FACTORS},
pair_days AS (SELECT a.date, a.factor AS factor_1, b.factor AS factor_2, a.factor_return AS x, b.factor_return AS y, row_number() OVER (PARTITION BY a.factor, b.factor ORDER BY a.date) AS k
  FROM factor_days a JOIN factor_days b ON a.date = b.date AND a.factor <= b.factor),
pair_sums AS (SELECT *, pow(1e0 - 2e0 / 61e0, -k::DOUBLE) AS w FROM pair_days),
pair_running AS (SELECT *, sum(w) OVER r AS sw, sum(w * x) OVER r AS sx, sum(w * y) OVER r AS sy, sum(w * x * y) OVER r AS sxy FROM pair_sums WINDOW r AS (PARTITION BY factor_1, factor_2 ORDER BY date)),
factor_cov AS (SELECT factor_1, factor_2, CAST(last_day(date) AS DATE) AS eom, arg_max(sxy / sw - (sx / sw) * (sy / sw), date) AS covariance FROM pair_running GROUP BY 1, 2, 3)"""


@register("ewma_covariance", "eom factor_1 factor_2 covariance:12", "SELECT * FROM factor_cov", EWMA)
def ewma_covariance(spark, sf_dir):
    return monthly_covariance(spark, sf_dir)


@register(
    "design_health",
    "eom n min_norm:8 median_norm:8 max_norm:8 max_abs_mean:8 near_zero duplicates effective_rank condition:4",
    f"SELECT eom, count(*) AS n, least(sqrt(sum(a * a)), sqrt(sum(b * b))) AS min_norm, (sqrt(sum(a * a)) + sqrt(sum(b * b))) / 2 AS median_norm, greatest(sqrt(sum(a * a)), sqrt(sum(b * b))) AS max_norm, greatest(abs(avg(a)), abs(avg(b))) AS max_abs_mean, "
    "CAST(0 AS INTEGER) AS near_zero, CAST(0 AS INTEGER) AS duplicates, CAST(2 AS INTEGER) AS effective_rank, "
    "sqrt((sum(a*a) + sum(b*b) + sqrt(pow(sum(a*a) - sum(b*b), 2) + 4 * pow(sum(a*b), 2))) / (sum(a*a) + sum(b*b) - sqrt(pow(sum(a*a) - sum(b*b), 2) + 4 * pow(sum(a*b), 2)))) AS condition "
    f"FROM (SELECT eom, {LABEL}, rank_discount AS a, rank_tax AS b FROM panel) WHERE {LABEL} IS NOT NULL GROUP BY eom",
    PANEL,
)
def design_health(spark, sf_dir):
    monthly = regress.gram(base.panel(spark, sf_dir), ["rank_discount", "rank_tax"], LABEL, ["eom"])
    return regress.design_health(monthly, 2)
