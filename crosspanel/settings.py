"""Fixed values.  They must equal the published research settings for equal results."""

# Feature neutral value, minimum cross-section for a monthly correlation.
NEUTRAL_RANK = 0.5
MIN_CROSS_SECTION = 20

# Cost model and accounting.
LAMBDA_MULTIPLIER = 0.2
TRADING_DAYS = 21
ADV_MONTHS = 6
AUM = 1.0e9
GAMMA = 10.0
GROWTH_FLOOR = 0.1
COVARIANCE_RIDGE = 1.0e-8

# Risk model.
VARIANCE_FLOOR = 1.0e-6
VOLATILITY_FLOOR = 0.01
VOLATILITY_DEFAULT = 0.05
DAILY_TO_MONTHLY = 21.0
MAX_IDIO_MISSING = 0.10
VARIANCE_RATIO_MAX = 25.0
ANNUAL_VOL_MAX = 2.0
EWMA_SPAN = 60

# Trading speed.
EXPECTED_MARKET_RETURN = 0.007
RISK_FREE_RATE = 0.0
SPEED_UPDATES = 10
SPECTRAL_LIMIT = 1.5

# Estimation.
COEFFICIENT_RIDGE_FLOOR = 1.0e-10
SCALE_FLOOR = 1.0e-12
NORM_FLOOR = 1.0e-12

# Inference.
HAC_LAGS = 6
BOOTSTRAP_BLOCK = 12
BOOTSTRAP_REPLICATIONS = 2000
HORIZONS = 12
NEAR_ZERO = 1.0e-8
SUM_ROUNDING = 1.0e-10
PERSISTENCE_GAP = 0.10
DRAWDOWN_CLIP = -0.999999

# Scenario grids.
GAMMA_GRID = (2.5, 5.0, 7.5, 10.0, 15.0, 20.0, 30.0, 50.0)
AUM_MULTIPLIERS = (0.0, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)

# Hyper-parameter grids.
RETURN_LAMBDAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
POLICY_LAMBDAS = (0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
FEATURE_COUNTS = (32, 64)
FEATURE_SCALES = (0.1, 0.5)
PHI_GRID = (1.0, 3.0, 6.0, 12.0)
SHRINKAGE_GRID = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0)
U_GRID = (0.05, 0.1, 0.25, 0.5, 1.0)
V_GRID = (0.0, 0.25, 0.5, 1.0)
K_GRID = (0.5, 1.0, 2.0)

# Data-quality thresholds.
MIN_PRICE = 5.0
COUNT_JUMP_FRACTION = 0.20
LAMBDA_TAIL_RATIO = 10000.0
LABEL_MISSING_RATE = 0.20
RAW_MISSING_RATE = 0.50
LOOKAHEAD_MARGIN = 0.10
LOOKAHEAD_ROWS = 30

# Persistence report: limits, and the texts of its causes.
PERSISTENCE_SIGN = 0.05
PERSISTENCE_FILLS = 0.10
PERSISTENCE_TIES = 0.10
PERSISTENCE_OVERLAP = 0.90
CAUSE_FILLS = "material neutral-rank missing-value fills"
CAUSE_TIES = "material rank ties"
CAUSE_OVERLAP = "low dynamic-universe overlap"
CAUSE_OTHER = "rank transformation or nonlinear cross-sectional movement"

# Risk calibration: limits of the ratio of realised to predicted volatility, and the texts of a breach.
RATIO_WITHIN = (0.6, 1.5)
RATIO_MEDIAN = (0.8, 1.25)
RATIO_BREACH = 2.0
BREACH_YEARS = 0.1
WITHIN_SHARE = 0.8
LEVERAGE_BREACH = 1.5
FACTOR_SHARE = 0.5
SOURCE_NONE = "within_threshold"
SOURCE_SCALING = "position_scaling"
SOURCE_FACTOR = "factor_covariance_underestimation_or_regime_shock"
SOURCE_IDIO = "idiosyncratic_covariance_underestimation_or_regime_shock"

# Feature scores: weights of the two scores, the scales of their parts, and the hard screens.
BALANCED_WEIGHTS = {
    "quality": 0.25, "ic_score": 0.25, "stability": 0.15, "persistence_score": 0.20, "diversity": 0.10, "bonus": 0.05,
    "trading_penalty": -0.05,
}
CONSERVATIVE_WEIGHTS = {
    "quality": 0.35, "ic_score": 0.05, "stability": 0.10, "persistence_score": 0.30, "diversity": 0.20, "trading_penalty": -0.05,
}
SCORE_SCALES = {
    "missing": 0.20, "std": 0.20, "ic": 0.03, "top_years": 0.60, "persistence_from": 0.20, "persistence_over": 0.75,
    "sensitive_persistence": 0.70,
}
QUALITY_PARTS = (0.7, 0.3)
STABILITY_PARTS = (0.6, 0.4)
REDUNDANCY_PARTS = (0.6, 0.4)
SCREENS = {"missing": 0.20, "std": 0.02, "persistence": 0.20, "max_abs": 0.90}
CONSERVATIVE_SCREENS = {"missing": 0.10, "std": 0.05, "persistence": 0.60, "max_abs": 0.85, "average_abs": 0.35}

# Windows of the competing return models, in months.  Fixed values.
RETURN_VALIDATION_MONTHS = 120
RETURN_MIN_TRAIN = 24
RETURN_MIN_VALIDATION = 12

# Evidence gates on rank correlations of a feature table.  Fixed values.
EVIDENCE_IMPROVEMENT = 0.20
EVIDENCE_POSITIVE_SHARE = 0.60
EVIDENCE_MAX_CHANGE = 0.35
EVIDENCE_APR = 0.50
EVIDENCE_STRONG = 0.50
EVIDENCE_STRONG_SHARE = 0.80
EVIDENCE_WEAK_SHARE = 0.50
EVIDENCE_TEXTS = (
    "strongly consistent", "moderately consistent", "weakly consistent", "mixed", "inconsistent",
)
EVIDENCE_CASES = ("Case A", "Case B")

# Outcomes of the importance report and the metrics they are differences of.  Fixed values.
IMPORTANCE_OUTCOMES = {
    "delta_utility": "annualized_ex_ante_utility_flow",
    "delta_net_return": "annualized_net_return",
    "delta_trading_cost": "annualized_trading_cost",
    "delta_turnover": "average_turnover",
    "delta_volatility": "annualized_volatility",
    "delta_leverage": "average_leverage",
}
