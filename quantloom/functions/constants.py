"""Fixed values of the risk model. Every operator takes them as default parameters."""

from __future__ import annotations

# Lags, lookbacks and thresholds of the model.
REPORTING_LAG_DAYS = 60
QUARTERLY_REPORTING_LAG_DAYS = 45
RF_ANNUAL = 0.055
TRADING_DAYS_PER_YEAR = 252
TRADING_DAYS_PER_MONTH = 21
MOMENTUM_LOOKBACK_DAYS = 252
MOMENTUM_LAG_DAYS = 21
BETA_LOOKBACK_DAYS = 252
LIQUIDITY_LOOKBACK_DAYS = 252
HOLIDAY_SHARE = 0.5
TOP_N = 100
WINSOR = (0.01, 0.99)
MIN_N_PER_DAY = 40
DEGENERATE_STD = 1e-6
CORPORATE_ACTION_RETURN = 0.40
EWMA_HALFLIFE = 90
SHRINK_T_MIN = 1.0
SHRINK_T_FULL = 3.0
FRONTIER_POINTS = 25
BACKTEST_FRONTIER_POINTS = 8
MAX_STOCK_WEIGHT = 0.10
MAX_INDUSTRY_WEIGHT = 0.20
STOCK_SOFT_PENALTY = 0.001
GROUP_MAX_WEIGHT = 0.20
GROUP_SOFT_PENALTY = 0.01
MAX_LEVERAGE = 1.2
CONCENTRATION_WARN = 0.10
CONCENTRATION_FAIL = 0.20
MACRO_MOMENTUM_MONTHS = 3
MACRO_MIN_MONTHS = 24
FUZZY_THRESHOLD = 0.90
NON_ANNUAL_GAP_DAYS = (300, 430)
MODEL_PERIODS = {"2018_2021": ("2018-01-01", "2021-01-01"), "2021_2023": ("2021-01-01", "2023-01-01"), "2023_present": ("2023-01-01", "2100-01-01")}

# Names of the factors, in the order of reports.
INDUSTRY_FACTORS = ["Financial Services", "Consumer Discretionary", "Materials", "Energy & Utilities", "Healthcare", "Consumer Staples", "Industrials", "Information Technology", "Communication Services", "Real Estate"]
STYLE_FACTORS = ["beta", "idio_vol", "momentum", "size", "value", "leverage", "quality", "capex", "growth", "profitability", "liquidity"]
INDICATOR_FACTORS = ["top100_flag", "psu_flag"]
ALL_FACTORS = INDUSTRY_FACTORS + STYLE_FACTORS + INDICATOR_FACTORS
SEGMENT_FACTORS = INDUSTRY_FACTORS + STYLE_FACTORS + ["psu_flag"]
SEGMENTS = {"top100": 1.0, "rest": 0.0}
