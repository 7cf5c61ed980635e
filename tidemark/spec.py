"""Names and numbers shared by every operator.

All values below are fixed: results only agree with the existing daily signals when they are
kept exactly as they are.
"""

from __future__ import annotations

CHAINS = ("BTC", "ETH")

RAW_PREFIX = {"BTC": "v1.0/btc", "ETH": "v1.0/eth"}

BTC_FEATURES = (
    "whale_flow_1d",
    "exchange_netflow_7d",
    "mempool_stress",
    "fee_pressure",
    "active_addresses",
    "utxo_age_1y",
    "revived_supply",
)

ETH_FEATURES = (
    "whale_flow_1d",
    "exchange_netflow_7d",
    "gas_price_median",
    "active_addresses",
    "smart_contract_calls",
    "eth2_staking_flow",
)

BTC_MINIMAL_FEATURES = (
    "BTC_total_block_count",
    "BTC_total_transactions_count",
    "BTC_total_output_value_btc",
    "BTC_mean_transaction_fee_rate_sat_per_vbyte",
    "BTC_active_addresses_count",
)

FEATURES_BY_CHAIN = {"BTC": BTC_FEATURES, "ETH": ETH_FEATURES}

# every feature of any chain once, in chain order
ALL_FEATURES = tuple(dict.fromkeys(BTC_FEATURES + ETH_FEATURES))

# units
SAT_PER_BTC = 1e8
WEI_PER_ETH = 1e18
WEI_PER_GWEI = 1e9
WHALE_THRESHOLD_WEI = "1000000000000000000000"  # 1,000 ETH
STAKING_DEPOSIT_CONTRACT = "0x00000000219ab540356cbb839cbe05303d7705fa"
OLD_OUTPUT_DAYS = 365

# signals
SMOOTHING_DAYS = 5
HISTORY_DAYS_PER_SMOOTHING_DAY = 6
HYSTERESIS_POINTS = 10.0
MIN_REGIME_CHANGE_HOURS = 48
NEUTRAL_SCORE = 50.0
REGIMES = ("Bull", "Neutral", "Bear")
RISK_STATES = ("Risk ON", "Neutral", "Risk OFF")
BEAR_FROM, NEUTRAL_FROM = 66.0, 33.0
RISK_OFF_FROM, RISK_NEUTRAL_FROM = 60.0, 40.0
SQUASH_SCALE = 10.0

# alerts
ALERT_TYPES = ("whale_spike", "stress_event", "momentum_collapse", "regime_shift")
ALERT_MESSAGES = {
    "whale_spike": "Whale activity spike: whale_index up by %.1f points vs previous day.",
    "stress_event": "On-chain stress elevated: stress_index at %.1f.",
    "momentum_collapse": "Momentum collapse: momentum_score down by %.1f points vs previous day.",
    "regime_shift": "Regime shift from %s to %s.",
}
WHALE_SPIKE_POINTS = 20.0
STRESS_LEVEL = 80.0
MOMENTUM_DROP_POINTS = 25.0
MAX_ALERT_HISTORY_DAYS = 90
DEFAULT_ALERT_DAYS = 7
READY_HOUR_UTC = 2

# quality
CRITICAL_NAME_PARTS = ("price", "volume", "count", "value", "total")
FEATURE_BOUND = 1e9

# models
MIN_PRODUCTION_AUC = 0.65
CLASS_THRESHOLD = 0.5
MAX_DROPPED_ROW_SHARE = 0.05
TARGET_DRAWDOWN_PCT = 5.0
TARGET_WINDOW_DAYS = 21
ANNUALISATION = 252.0

# freshness
HEALTHY_HOURS = 24
DEGRADED_HOURS = 48
