"""The same results as DuckDB SQL, written independently of the Spark plans.

``CTES`` holds named relations; a query lists the ones it starts from and gets a WITH clause
with everything they depend on.
"""

from __future__ import annotations

import re

from checks.inputs import TABLES, duck

CTES: dict[str, str] = {name: duck(name) for name in TABLES}
ORACLES: dict[str, str] = {}


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [n for n in CTES if n in words]


def _ordered(text: str, seen: list[str], stack: tuple[str, ...] = ()) -> list[str]:
    for name in _needs(text):
        if name not in seen and name not in stack:
            _ordered(CTES[name], seen, (*stack, name))
            seen.append(name)
    return seen


def sql(text: str, recursive: bool = False) -> str:
    parts = [f"{n} AS ({CTES[n]})" for n in _ordered(text, [])]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + text) if parts else text


def oracle(name: str, text: str) -> None:
    ORACLES[name] = sql(text)


OWN_DIGITS = {"close": 6, "gas_price_median": 6}


def R(expr: str, alias: str, digits: int = 6) -> str:
    digits = max(digits, OWN_DIGITS.get(alias, 0))
    return f"ROUND({expr}, {digits}) + 0.0E0 AS {alias}"


BTC = ["whale_flow_1d", "exchange_netflow_7d", "mempool_stress", "fee_pressure", "active_addresses",
       "utxo_age_1y", "revived_supply"]
ETH = ["whale_flow_1d", "exchange_netflow_7d", "gas_price_median", "active_addresses", "smart_contract_calls",
       "eth2_staking_flow"]
ALL = list(dict.fromkeys(BTC + ETH))


def Rs(names: list[str], digits: int = 6) -> str:
    return ", ".join(R(n, n, digits) for n in names)


# ------------------------------------------------------------------ relations

CTES["btc_day"] = """
SELECT COALESCE(b.chain, t.chain) AS chain, COALESCE(b.date, t.date) AS date,
  t.whale AS whale_flow_1d, t.netflow AS exchange_netflow_7d,
  COALESCE(b.txs, t.n)::DOUBLE AS mempool_stress, COALESCE(b.ratio, t.fee) AS fee_pressure,
  a.n::DOUBLE AS active_addresses, t.aged AS utxo_age_1y, t.aged AS revived_supply
FROM (SELECT chain, date, SUM(tx_count) AS txs,
        AVG(CASE WHEN block_subsidy_btc <> 0 THEN total_fees_btc / block_subsidy_btc END) AS ratio
      FROM btc_blocks GROUP BY ALL) b
FULL JOIN (SELECT chain, date, COUNT(*) AS n, COALESCE(SUM(value_usd) FILTER (is_whale), 0) AS whale,
             SUM(exchange_in_usd) - SUM(exchange_out_usd) AS netflow, AVG(fee_rate) AS fee,
             COALESCE(SUM(value_usd) FILTER (spent_output_age_days >= 365), 0) AS aged
           FROM btc_tx GROUP BY ALL) t ON b.chain = t.chain AND b.date = t.date
LEFT JOIN (SELECT chain, date, COUNT(DISTINCT e) AS n
           FROM (SELECT chain, date, from_address AS e FROM btc_tx
                 UNION ALL SELECT chain, date, to_address FROM btc_tx) GROUP BY ALL) a
  ON a.chain = t.chain AND a.date = t.date"""

CTES["eth_day"] = """
SELECT t.chain, t.date, t.whale_eth * COALESCE(p.close, 1) AS whale_flow_1d, 0.0E0 AS exchange_netflow_7d,
  t.gas / 1e9 AS gas_price_median, a.n::DOUBLE AS active_addresses, t.calls::DOUBLE AS smart_contract_calls,
  t.staked AS eth2_staking_flow, t.whale_eth
FROM (SELECT chain, date,
        COALESCE(SUM(value) FILTER (value >= 1000000000000000000000), 0)::DOUBLE / 1e18 AS whale_eth,
        MEDIAN(gas_price) AS gas,
        COUNT(*) FILTER ((input IS NOT NULL AND input <> '0x') OR to_address IS NULL) AS calls,
        COALESCE(SUM(value) FILTER (LOWER(to_address) = '0x00000000219ab540356cbb839cbe05303d7705fa'), 0)::DOUBLE
          / 1e18 AS staked
      FROM eth_tx GROUP BY ALL) t
JOIN (SELECT chain, date, COUNT(DISTINCT e) AS n
      FROM (SELECT chain, date, from_address AS e FROM eth_tx
            UNION ALL SELECT chain, date, to_address FROM eth_tx) GROUP BY ALL) a
  ON a.chain = t.chain AND a.date = t.date
LEFT JOIN prices p ON p.chain = t.chain AND p.date = t.date"""

CTES["all_day"] = f"""
SELECT chain, date, {", ".join(ALL)} FROM
  (SELECT chain, date, {", ".join(BTC)}, NULL::DOUBLE AS gas_price_median, NULL::DOUBLE AS smart_contract_calls,
     NULL::DOUBLE AS eth2_staking_flow FROM btc_day
   UNION ALL BY NAME
   SELECT chain, date, {", ".join(ETH)} FROM eth_day)"""

CTES["both_blocks"] = "SELECT chain, date FROM btc_blocks UNION ALL SELECT chain, date FROM eth_blocks"
CTES["both_tx"] = "SELECT chain, date FROM btc_tx UNION ALL SELECT chain, date FROM eth_tx"
CTES["spine"] = """
SELECT chain, CAST(UNNEST(GENERATE_SERIES(a, b, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT chain, MIN(date) AS a, MAX(date) AS b
      FROM (SELECT * FROM both_blocks UNION ALL SELECT * FROM both_tx) GROUP BY chain)"""

CTES["checked_day"] = f"""
SELECT s.chain, s.date, {", ".join("d." + n for n in ALL)}, p.close,
  CASE WHEN d.chain IS NULL THEN 'no_raw_data' WHEN p.close IS NULL THEN 'no_price' END AS invalid_reason
FROM spine s LEFT JOIN all_day d ON d.chain = s.chain AND d.date = s.date
LEFT JOIN prices p ON p.chain = s.chain AND p.date = s.date"""

_stats = " UNION ALL ".join(
    f"SELECT chain, '{n}' AS feature, AVG({n}) AS mean, STDDEV_POP({n}) AS std FROM all_day "
    f"WHERE chain IN ({', '.join(repr(c) for c, own in (('BTC', BTC), ('ETH', ETH)) if n in own)}) GROUP BY chain"
    for n in ALL
)
CTES["fitted"] = f"SELECT chain, feature, COALESCE(mean, 0) AS mean, COALESCE(std, 0) AS std FROM ({_stats})"

_wide = ", ".join(
    f"MAX(mean) FILTER (feature = '{n}') AS m_{n}, MAX(std) FILTER (feature = '{n}') AS s_{n}" for n in ALL
)
CTES["wide_params"] = f"SELECT chain, {_wide} FROM fitted GROUP BY chain"
_z = ", ".join(
    f"CASE WHEN s_{n} IS NULL THEN {n} WHEN s_{n} = 0 THEN CASE WHEN {n} IS NOT NULL THEN 0.0E0 END "
    f"ELSE ({n} - m_{n}) / s_{n} END AS {n}" for n in ALL
)
CTES["scaled"] = f"SELECT d.chain, d.date, {_z} FROM all_day d JOIN wide_params w ON w.chain = d.chain"


def squash(x: str) -> str:
    return f"GREATEST(0.0E0, LEAST(100.0E0, 50.0E0 + 50.0E0 * TANH(({x}) / 10.0E0)))"


def fb(n: str) -> str:
    return f"COALESCE({n}, 50.0E0)"


WHALE = squash(f"ABS({fb('whale_flow_1d')}) + GREATEST(0.0E0, -{fb('exchange_netflow_7d')})")
STRESS = squash(
    f"CASE WHEN chain = 'BTC' THEN {fb('mempool_stress')} + {fb('fee_pressure')} ELSE {fb('gas_price_median')} END"
)
MOMENTUM = squash(
    f"CASE WHEN chain = 'BTC' THEN {fb('active_addresses')} - {fb('utxo_age_1y')} "
    f"ELSE {fb('active_addresses')} + {fb('smart_contract_calls')} END"
)


def regime(s: str) -> str:
    return f"CASE WHEN {s} < 33 THEN 'Bull' WHEN {s} < 66 THEN 'Neutral' ELSE 'Bear' END"


def state(s: str) -> str:
    return f"CASE WHEN {s} < 40 THEN 'Risk ON' WHEN {s} < 60 THEN 'Neutral' ELSE 'Risk OFF' END"


def epoch(hours: int) -> str:
    return f"CAST(date - DATE '1970-01-01' AS BIGINT) * 86400 + {hours * 3600}"


CTES["clean_score"] = "SELECT chain, date, GREATEST(0.0E0, LEAST(100.0E0, raw_score)) AS score FROM raw_scores"
CTES["indexed"] = f"""
SELECT z.chain, z.date, c.score, {WHALE.replace("chain =", "z.chain =")} AS whale_index,
  {STRESS.replace("chain =", "z.chain =")} AS stress_index, {MOMENTUM.replace("chain =", "z.chain =")} AS momentum_score
FROM scaled z JOIN clean_score c ON c.chain = z.chain AND c.date = z.date"""
CTES["stored_signal"] = f"""
SELECT chain, date, score AS risk_score, {regime("score")} AS regime, {state("score")} AS risk_state,
  whale_index, stress_index, momentum_score, {epoch(27)} AS created_at FROM indexed"""

_msg = {
    "whale_spike": "FORMAT('Whale activity spike: whale_index up by {:.1f} points vs previous day.', whale_index - pw)",
    "stress_event": "FORMAT('On-chain stress elevated: stress_index at {:.1f}.', stress_index)",
    "momentum_collapse":
        "FORMAT('Momentum collapse: momentum_score down by {:.1f} points vs previous day.', pm - momentum_score)",
    "regime_shift": "'Regime shift from ' || pr || ' to ' || regime || '.'",
}
_when = {
    "whale_spike": "whale_index - pw > 20", "stress_event": "stress_index > 80",
    "momentum_collapse": "pm - momentum_score > 25", "regime_shift": "regime <> pr",
}


def alert_union(src: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT chain, date, '{k}' AS alert_type, {_msg[k]} AS message{extra} FROM {src} WHERE {_when[k]}" for k in _when
    )


CTES["signal_pair"] = """
SELECT *, LAG(whale_index) OVER w AS pw, LAG(momentum_score) OVER w AS pm, LAG(regime) OVER w AS pr,
  LAG(date) OVER w AS pd FROM stored_signal WINDOW w AS (PARTITION BY chain ORDER BY date)"""
CTES["stored_alert"] = alert_union("signal_pair", ", created_at")

_pairs = """
SELECT {keys} COUNT(*) AS n_rows,
  COUNT(*) FILTER (y = 0 AND p < {t}) AS tn, COUNT(*) FILTER (y = 0 AND p >= {t}) AS fp,
  COUNT(*) FILTER (y = 1 AND p < {t}) AS fn, COUNT(*) FILTER (y = 1 AND p >= {t}) AS tp
FROM predictions {group}"""
CTES["counts"] = _pairs.format(keys="chain, model_version,", t="0.5", group="GROUP BY chain, model_version")
CTES["ranked"] = """
SELECT chain, model_version, y, (RANK() OVER w + (COUNT(*) OVER v - 1) / 2.0E0) AS rk
FROM predictions WINDOW w AS (PARTITION BY chain, model_version ORDER BY p),
  v AS (PARTITION BY chain, model_version, p)"""
CTES["auc_by_model"] = """
SELECT chain, model_version,
  (SUM(rk) FILTER (y = 1) - COUNT(*) FILTER (y = 1) * (COUNT(*) FILTER (y = 1) + 1) / 2.0E0)
    / NULLIF(COUNT(*) FILTER (y = 1) * COUNT(*) FILTER (y = 0), 0) AS auc
FROM ranked GROUP BY chain, model_version"""
CTES["rates"] = """
SELECT *, COALESCE(tp::DOUBLE / NULLIF(tp + fp, 0), 0) AS "precision", COALESCE(tp::DOUBLE / NULLIF(tp + fn, 0), 0) AS recall,
  COALESCE(2.0E0 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, tp::DOUBLE / NULLIF(tp + fn, 0) AS hitrate FROM counts"""
CTES["performance"] = """
SELECT r.chain, r.model_version, a.auc, r.hitrate, NULL::DOUBLE AS sharpe_ratio,
  1704067200 + CAST(SPLIT_PART(r.model_version, '.', 3) AS BIGINT) * 86400 AS trained_at
FROM rates r JOIN auc_by_model a ON a.chain = r.chain AND a.model_version = r.model_version"""

CTES["labelled"] = """
SELECT chain, date, close, CASE WHEN seen = 21 THEN CAST(low <= close * (1.0E0 - 5.0E0 / 100.0E0) AS INTEGER) END AS target
FROM (SELECT *, MIN(close) OVER w AS low, COUNT(*) OVER w AS seen FROM prices
      WINDOW w AS (PARTITION BY chain ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING))"""
CTES["returned"] = """
SELECT chain, date, close / LAG(close) OVER (PARTITION BY chain ORDER BY date) - 1 AS ret FROM prices"""
CTES["strategy"] = """
SELECT chain, date, CASE WHEN raw_score >= 66 THEN 0.0E0 * ret ELSE ret END AS ret, ret AS base_ret
FROM returned JOIN raw_scores USING (chain, date)"""

# ------------------------------------------------------------------ sources

oracle("daily_spine", "SELECT chain, date FROM spine")
oracle("missing_days", "SELECT chain, date FROM spine EXCEPT SELECT chain, date FROM both_blocks")
oracle("data_availability", "SELECT chain, date FROM spine INTERSECT SELECT chain, date FROM both_blocks")
oracle("raw_readiness", """
SELECT s.chain, s.date, COALESCE(b.n, 0) AS n_blocks, COALESCE(t.n, 0) AS n_tx,
  CASE WHEN b.n IS NULL AND t.n IS NULL THEN 'missing' WHEN b.n IS NULL OR t.n IS NULL THEN 'partial'
       ELSE 'complete' END AS raw_status
FROM spine s
LEFT JOIN (SELECT chain, date, COUNT(*) AS n FROM both_blocks GROUP BY ALL) b USING (chain, date)
LEFT JOIN (SELECT chain, date, COUNT(*) AS n FROM both_tx GROUP BY ALL) t USING (chain, date)""")
oracle("placeholder_days", f"""
SELECT chain, date, {", ".join(R(f"CASE WHEN invalid_reason IS NULL THEN {n} END", n, 4) for n in ALL)},
  {R("close", "close", 4)}, invalid_reason IS NULL AS is_valid, invalid_reason FROM checked_day""")
oracle("tx_scan_limited", """
SELECT chain, date, COUNT(*) AS n_tx, CAST(SUM(tx_id) AS BIGINT) AS sum_tx_id
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chain, date ORDER BY tx_id, value_usd, from_address, to_address) AS rn
      FROM btc_tx) WHERE rn <= 5 GROUP BY chain, date""")
oracle("union_of_files", """
SELECT 'BTC' AS chain, COUNT(*) AS n_rows, COUNT(value_usd) AS n_value_usd, 0::BIGINT AS n_gas_price FROM btc_tx
UNION ALL SELECT 'ETH', COUNT(*), 0, COUNT(gas_price) FROM eth_tx""")

oracle("chains_accepted", """
SELECT id, chain || CASE WHEN y = 1 THEN 'X' ELSE '' END AS chain, y = 0 AS is_known FROM predictions""")
ORACLES["dates_read"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS from_timestamp,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS from_text FROM orders"""

# ------------------------------------------------------------------ features

for _q, _f, _d in [
    ("btc_whale_flow", "whale_flow_1d", 4), ("btc_exchange_netflow", "exchange_netflow_7d", 4),
    ("btc_mempool_stress", "mempool_stress", 4), ("btc_fee_pressure", "fee_pressure", 6),
    ("btc_active_addresses", "active_addresses", 4), ("btc_utxo_age_1y", "utxo_age_1y", 4),
    ("btc_revived_supply", "revived_supply", 4),
]:
    oracle(_q, f"SELECT chain, date, {R(_f, _f, _d)} FROM btc_day")
oracle("btc_features", f"SELECT chain, date, {Rs(BTC, 4)} FROM btc_day")
oracle("btc_min_features", f"""
SELECT chain, date, b.n::DOUBLE AS "BTC_total_block_count", t.n::DOUBLE AS "BTC_total_transactions_count",
  {R("t.v", '"BTC_total_output_value_btc"', 4)},
  {R("t.f", '"BTC_mean_transaction_fee_rate_sat_per_vbyte"', 4)}, t.a::DOUBLE AS "BTC_active_addresses_count"
FROM (SELECT chain, date, COUNT(*) AS n FROM btc_blocks GROUP BY ALL) b
FULL JOIN (SELECT chain, date, COUNT(*) AS n, SUM(value_btc) AS v, COUNT(DISTINCT from_address) AS a,
             AVG(fee / vsize) FILTER (vsize > 0) AS f FROM btc_tx GROUP BY ALL) t USING (chain, date)""")
oracle("btc_mean_block_size", f"SELECT chain, date, {R('AVG(size)', 'mean_block_size_bytes', 4)} FROM btc_blocks GROUP BY chain, date")
oracle("eth_whale_flow", f"SELECT chain, date, {R('whale_flow_1d', 'whale_flow_1d', 2)}, 'USD' AS whale_flow_unit FROM eth_day")
oracle("eth_whale_flow_in_eth", f"SELECT chain, date, {R('whale_eth', 'whale_flow_1d', 4)}, 'ETH' AS whale_flow_unit FROM eth_day")
for _q, _f, _d in [
    ("eth_netflow_placeholder", "exchange_netflow_7d", 6), ("eth_gas_median", "gas_price_median", 6),
    ("eth_active_addresses", "active_addresses", 6), ("eth_contract_calls", "smart_contract_calls", 6),
    ("eth_staking_flow", "eth2_staking_flow", 4),
]:
    oracle(_q, f"SELECT chain, date, {R(_f, _f, _d)} FROM eth_day")
oracle("eth_gas_from_blocks", f"""
SELECT chain, date, {R("MEDIAN(base_fee_per_gas) / 1e9", "gas_price_median")} FROM eth_blocks GROUP BY chain, date""")
oracle("eth_labelled_netflow", f"""
SELECT chain, date, {R("(SUM(CASE WHEN to_address LIKE '%7' THEN value ELSE 0 END)"
                       " - SUM(CASE WHEN from_address LIKE '%7' THEN value ELSE 0 END))::DOUBLE / 1e18",
                       "exchange_netflow_7d", 4)}
FROM eth_tx GROUP BY chain, date""")
oracle("eth_features", f"SELECT chain, date, {Rs(ETH, 2)} FROM eth_day")
oracle("features_all_chains", f"SELECT chain, date, {Rs(ALL, 2)} FROM all_day")
_valid = f"SELECT chain, date, {Rs([*ALL, 'close'], 2)}, TRUE AS is_valid FROM checked_day WHERE invalid_reason IS NULL AND "
oracle("features_date_range", _valid + "date BETWEEN DATE '1996-01-01' AND DATE '2024-01-15'")
oracle("incremental_build", f"""
SELECT chain, date, {Rs([*ETH], 2)}, {R("CASE WHEN date = DATE '2024-01-05' THEN -1.0E0 ELSE close END", "close", 2)},
  invalid_reason IS NULL AS is_valid, invalid_reason FROM checked_day WHERE chain = 'ETH'""")
oracle("raw_folders_united", """
SELECT chain, date, COUNT(*) AS n_rows, COUNT(CASE WHEN date < DATE '2024-01-11' THEN value END) AS n_value,
  COUNT(CASE WHEN date >= DATE '2024-01-11' THEN gas_price END) AS n_gas_price,
  COUNT(CASE WHEN date >= DATE '2024-01-11' THEN input END) AS n_input, COUNT(DISTINCT from_address) AS n_senders
FROM eth_tx WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY chain, date""")
oracle("retention_to_the_day", f"SELECT chain, date, {Rs(ALL, 2)} FROM all_day WHERE date >= DATE '2000-05-17'")
_twice = ["whale_flow_1d * CASE WHEN date >= DATE '2000-01-01' THEN 2 ELSE 1 END", *ALL[1:]]
oracle("atomic_replace", f"""
SELECT chain, date, {Rs(ALL, 2)}, 1 AS version FROM all_day
UNION ALL
SELECT chain, date, {", ".join(R(e, n, 2) for e, n in zip(_twice, ALL))}, 2 FROM all_day
WHERE date < DATE '2000-01-01' OR EXTRACT(DAY FROM date) <= 20""")
oracle("features_of_day", _valid + "date = DATE '1997-06-02'")

# ------------------------------------------------------------------ normalisation, training data

oracle("norm_params", f"SELECT chain, feature, {Rs(['mean', 'std'], 3)} FROM fitted")
oracle("params_cleaned", f"SELECT chain, feature, {Rs(['mean', 'std'], 3)} FROM fitted WHERE feature <> 'fee_pressure'")
oracle("zscore", f"SELECT chain, date, {Rs(ALL)} FROM scaled")
oracle("zscore_one_chain", "SELECT d.chain, d.date, " + ", ".join(
    R(f"CASE WHEN d.chain = 'BTC' THEN s.{n} END", n) for n in ALL) + " FROM all_day d JOIN scaled s ON s.chain = d.chain AND s.date = d.date")
oracle("bad_params", "SELECT chain, feature FROM fitted WHERE feature = 'fee_pressure' OR std = 0")
oracle("finite_vectors", f"""
SELECT chain, date FROM all_day WHERE CASE chain WHEN 'BTC' THEN {" AND ".join(f"{n} IS NOT NULL" for n in BTC)}
  ELSE {" AND ".join(f"{n} IS NOT NULL" for n in ETH)} END""")
_zi = ", ".join(
    R(f"CASE WHEN s_{n} = 0 THEN 0.0E0 WHEN s_{n} IS NOT NULL THEN CAST(CAST(({n} - m_{n}) / s_{n} AS FLOAT) AS DOUBLE) END", n, 4)
    for n in ALL
)
oracle("zscore_inference_variant", f"SELECT d.chain, d.date, {_zi} FROM all_day d JOIN wide_params w ON w.chain = d.chain")
oracle("clean_training_rows", f"""
SELECT chain, date,
  {R("COALESCE(whale_flow_1d, CASE WHEN share > 0.05 THEN m1 END)", "whale_flow_1d", 4)},
  {R("COALESCE(active_addresses, CASE WHEN share > 0.05 THEN m2 END)", "active_addresses", 4)},
  {R("COALESCE(cost, CASE WHEN share > 0.05 THEN m3 END)", "cost", 4)}
FROM (SELECT *, whale_flow_1d IS NULL OR active_addresses IS NULL OR cost IS NULL AS gap,
        AVG(CASE WHEN whale_flow_1d IS NULL OR active_addresses IS NULL OR cost IS NULL THEN 1.0E0 ELSE 0.0E0 END)
          OVER (PARTITION BY chain) AS share,
        MEDIAN(whale_flow_1d) OVER (PARTITION BY chain) AS m1, MEDIAN(active_addresses) OVER (PARTITION BY chain) AS m2,
        MEDIAN(cost) OVER (PARTITION BY chain) AS m3
      FROM (SELECT chain, date, whale_flow_1d, active_addresses,
              CASE WHEN chain = 'BTC' OR EXTRACT(DAY FROM date) % 3 <> 0 THEN COALESCE(gas_price_median, fee_pressure) END
                AS cost FROM all_day))
WHERE share > 0.05 OR NOT gap""")
oracle("train_val_split", f"""
SELECT d.chain, d.date, CASE WHEN d.date <= DATE '1999-12-31' THEN 'train' ELSE 'validation' END AS split, l.target,
  {R("d.whale_flow_1d", "whale_flow_1d", 4)}
FROM all_day d JOIN labelled l ON l.chain = d.chain AND l.date = d.date
WHERE l.target IS NOT NULL AND d.chain = 'BTC' AND d.date BETWEEN DATE '1995-01-01' AND DATE '2001-06-30'
UNION ALL
SELECT d.chain, d.date, CASE WHEN d.date <= DATE '2024-01-06' THEN 'train' ELSE 'validation' END, l.target, {R("d.whale_flow_1d", "whale_flow_1d", 4)}
FROM all_day d JOIN labelled l ON l.chain = d.chain AND l.date = d.date
WHERE l.target IS NOT NULL AND d.chain = 'ETH' AND d.date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""")
oracle("drawdown_label", f"SELECT chain, date, {R('close', 'close', 4)}, target FROM labelled")
oracle("daily_returns", f"SELECT chain, date, {R('ret', 'ret')} FROM returned")
oracle("netflow_7d", f"""
SELECT chain, date, {R("SUM(exchange_netflow_7d) OVER (PARTITION BY chain ORDER BY date "
                       "RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)", "netflow_7d", 3)} FROM btc_day""")
oracle("training_input_check", f"""
SELECT d.chain, CASE WHEN d.date <= DATE '1999-12-31' THEN 'train' ELSE 'validation' END AS split, COUNT(*) AS n_rows,
  COUNT(*) FILTER ({" AND ".join(f"d.{n} IS NOT NULL" for n in BTC)}) AS n_complete, 7::INTEGER AS n_features
FROM all_day d JOIN labelled l ON l.chain = d.chain AND l.date = d.date
WHERE l.target IS NOT NULL AND d.chain = 'BTC' AND d.date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY ALL
UNION ALL
SELECT d.chain, CASE WHEN d.date <= DATE '2024-01-06' THEN 'train' ELSE 'validation' END AS split, COUNT(*) AS n_rows,
  COUNT(*) FILTER ({" AND ".join(f"d.{n} IS NOT NULL" for n in ETH)}) AS n_complete, 6::INTEGER AS n_features
FROM all_day d JOIN labelled l ON l.chain = d.chain AND l.date = d.date
WHERE l.target IS NOT NULL AND d.chain = 'ETH' AND d.date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY ALL""")

# ------------------------------------------------------------------ metrics

oracle("auc", f"SELECT chain, model_version, {R('auc', 'auc')} FROM auc_by_model")
oracle("auc_overall", f"""
SELECT {R("(SUM(rk) FILTER (y = 1) - COUNT(*) FILTER (y = 1) * (COUNT(*) FILTER (y = 1) + 1) / 2.0E0)"
          " / (COUNT(*) FILTER (y = 1) * COUNT(*) FILTER (y = 0))", "auc")}
FROM (SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0E0 AS rk FROM predictions)""")
oracle("confusion", "SELECT chain, model_version, tn, fp, fn, tp FROM counts")
oracle("precision_recall_f1", f"SELECT chain, model_version, {R('\"precision\"', '\"precision\"')}, {Rs(['recall', 'f1'])} FROM rates")
oracle("drawdown_hitrate", f"""
SELECT chain, model_version, {R("COUNT(*) FILTER (y = 1 AND p >= 0.3)::DOUBLE / NULLIF(COUNT(*) FILTER (y = 1), 0)", "hitrate")}
FROM predictions GROUP BY chain, model_version""")


def sharpe(c: str) -> str:
    return (f"CASE WHEN STDDEV_SAMP({c}) = 0 THEN 0.0E0 WHEN STDDEV_SAMP({c}) > 0 "
            f"THEN AVG({c}) / STDDEV_SAMP({c}) * SQRT(252.0E0) END")


SORTINO = ("CASE WHEN COUNT(ret) > 0 AND COUNT(*) FILTER (ret < 0) = 0 THEN 'inf'::DOUBLE "
           "WHEN STDDEV_SAMP(ret) FILTER (ret < 0) = 0 THEN 0.0E0 "
           "ELSE AVG(ret) / STDDEV_SAMP(ret) FILTER (ret < 0) * SQRT(252.0E0) END")
oracle("sharpe", f"SELECT chain, {R(sharpe('ret'), 'sharpe', 5)} FROM strategy GROUP BY chain")
oracle("sortino", f"SELECT chain, {R(SORTINO, 'sortino', 5)} FROM strategy GROUP BY chain")
oracle("sharpe_improvement", f"""
SELECT chain, {R(sharpe("ret"), "sharpe", 5)}, {R(SORTINO, "sortino", 5)}, {R(sharpe("base_ret"), "base_sharpe", 5)},
  {R(f"({sharpe('ret')}) - ({sharpe('base_ret')})", "sharpe_improvement", 5)} FROM strategy GROUP BY chain""")
oracle("evaluation_report", f"""
SELECT r.chain, r.model_version, n_rows, tn, fp, fn, tp, {R('"precision"', '"precision"')}, {Rs(["recall", "f1", "hitrate"])},
  {R("a.auc", "auc")} FROM rates r JOIN auc_by_model a ON a.chain = r.chain AND a.model_version = r.model_version""")
_patch = "split_part(model_version, '.', 3)"
_cell = "CASE WHEN reason IS NULL THEN {n} END"
oracle("evaluation_report_checked", f"""
SELECT r.chain, r.model_version, n_rows, {", ".join(f"{_cell.format(n=n)} AS {n}" for n in ("tn", "fp", "fn", "tp"))},
  {", ".join(R(_cell.format(n=n), n) for n in ('"precision"', "recall", "f1", "hitrate", "auc"))}, reason
FROM rates r JOIN auc_by_model a ON a.chain = r.chain AND a.model_version = r.model_version
JOIN (SELECT chain, model_version, NULLIF(concat_ws(',',
          CASE WHEN bool_or({_patch} = '4' AND id % 7 = 1) THEN 'non_binary_label' END,
          CASE WHEN bool_or({_patch} = '2' AND id % 7 = 0) THEN 'bad_score' END,
          CASE WHEN bool_or({_patch} = '4' AND id % 3 = 0 AND p > 0) THEN 'score_out_of_range' END), '') AS reason
      FROM predictions GROUP BY chain, model_version) c ON c.chain = r.chain AND c.model_version = r.model_version""")
oracle("metric_input_check", """
SELECT chain, model_version, COUNT(*) AS n_rows, 0::BIGINT AS bad_label, 0::BIGINT AS non_binary_label, 0::BIGINT AS bad_score,
  COUNT(*) FILTER (p > 1) AS score_out_of_range, COUNT(*) FILTER (p > 1) = 0 AS is_usable
FROM (SELECT chain, model_version, CASE WHEN id % 7 = 0 THEN p * 1.5 ELSE p END AS p FROM predictions)
GROUP BY chain, model_version""")

# ------------------------------------------------------------------ signals

oracle("risk_score_sanitised", f"""
SELECT chain, date, {R("CASE WHEN EXTRACT(DAY FROM date) = 13 THEN 50.0E0 ELSE GREATEST(0.0E0, LEAST(100.0E0, raw_score * 1.4 - 20)) END",
                       "risk_score")} FROM raw_scores""")
oracle("risk_percent", f"SELECT id, {R('GREATEST(0.0E0, LEAST(1.0E0, p * 1.3 - 0.1)) * 100', 'raw_score')} FROM predictions")
oracle("feature_fallbacks", f"""
SELECT chain, date, {R(fb("mempool_stress"), "mempool_stress")}, {R(fb("gas_price_median"), "gas_price_median")},
  50.0E0 AS absent FROM all_day""")
oracle("regimes", f"SELECT chain, date, {regime('raw_score')} AS regime FROM raw_scores")
oracle("risk_states", f"SELECT chain, date, {state('raw_score')} AS risk_state FROM raw_scores")
oracle("whale_index", f"SELECT chain, date, {R(WHALE, 'whale_index')} FROM scaled")
oracle("stress_index", f"SELECT chain, date, {R(STRESS, 'stress_index')} FROM scaled")
oracle("momentum_score", f"SELECT chain, date, {R(MOMENTUM, 'momentum_score')} FROM scaled")

ALPHA = "(2.0E0 / 6.0E0)"
CTES["numbered"] = "SELECT *, ROW_NUMBER() OVER (PARTITION BY chain ORDER BY date) AS rn FROM clean_score"
CTES["folded"] = f"""
SELECT chain, rn, date, score, {regime("score")} AS regime,
  [{{'d': date, 'ts': {epoch(27)}, 'r': {regime("score")}}}] AS past
FROM numbered WHERE rn = 1
UNION ALL
SELECT chain, rn, date, score, regime,
  LIST_APPEND(kept, {{'d': date, 'ts': {epoch(27)}, 'r': regime}}) AS past
FROM (SELECT chain, rn, date, score, kept,
        CASE WHEN LEN(kept) = 0 OR held = kept[-1].r THEN held
             WHEN ({epoch(0)} - COALESCE(LIST_FILTER(kept, lambda x: x.r <> kept[-1].r)[-1].ts, kept[1].ts)) / 3600.0E0 < 48
             THEN kept[-1].r ELSE held END AS regime
      FROM (SELECT chain, rn, date, score, kept,
              CASE WHEN LEN(kept) > 0 AND ABS(score - before) < 10 THEN kept[-1].r ELSE {regime("score")} END AS held
            FROM (SELECT chain, rn, date, kept, before,
                    CASE WHEN LEN(kept) = 0 THEN raw
                         ELSE GREATEST(0.0E0, LEAST(100.0E0, {ALPHA} * raw + (1.0E0 - {ALPHA}) * before)) END AS score
                  FROM (SELECT n.chain, n.rn, n.date, n.score AS raw, f.score AS before,
                          LIST_FILTER(f.past, lambda x: x.d >= n.date - 30) AS kept
                        FROM folded f JOIN numbered n ON n.chain = f.chain AND n.rn = f.rn + 1))))"""
CTES["smooth"] = f"""
SELECT chain, rn, date, score FROM numbered WHERE rn = 1
UNION ALL
SELECT n.chain, n.rn, n.date, CASE WHEN n.date - s.date > 30 THEN n.score
  ELSE {ALPHA} * n.score + (1.0E0 - {ALPHA}) * s.score END
FROM smooth s JOIN numbered n ON n.chain = s.chain AND n.rn = s.rn + 1"""
ORACLES["ewma_scores"] = sql(f"SELECT chain, date, {R('score', 'risk_score')} FROM smooth", recursive=True)
ORACLES["signals_backfill"] = sql(f"""
SELECT f.chain, f.date, {R("f.score", "risk_score")}, f.regime, {state("f.score")} AS risk_state,
  {", ".join(R("i." + n, n) for n in ("whale_index", "stress_index", "momentum_score"))}
FROM folded f JOIN indexed i ON i.chain = f.chain AND i.date = f.date""", recursive=True)

ORACLES["signals_rerun"] = ORACLES["signals_backfill"]


def step_ctes(prefix: str, source: str) -> None:
    """Look-back of every target day over a table of stored signals."""
    CTES[prefix + "_look"] = f"""
SELECT t.chain, t.date, t.score, s.date AS sd, s.regime AS sr, s.risk_score AS ss, s.whale_index AS sw,
  s.momentum_score AS sm, s.created_at AS ts
FROM clean_score t JOIN {source} s ON s.chain = t.chain AND s.date BETWEEN t.date - 30 AND t.date - 1"""
    CTES[prefix + "_last"] = f"""
SELECT chain, date, ARG_MAX(sr, sd) AS lr, ARG_MAX(ss, sd) AS ls, ARG_MAX(sw, sd) AS lw, ARG_MAX(sm, sd) AS lm,
  ARG_MIN(ts, sd) AS oldest FROM {prefix}_look GROUP BY chain, date"""
    CTES[prefix + "_change"] = f"""
SELECT h.chain, h.date, ARG_MAX(h.ts, h.sd) AS changed FROM {prefix}_look h
JOIN {prefix}_last l ON l.chain = h.chain AND l.date = h.date WHERE h.sr <> l.lr GROUP BY h.chain, h.date"""
    CTES[prefix + "_smooth"] = f"""
SELECT t.chain, t.date, t.score AS raw, l.lr, l.ls, l.lw, l.lm, COALESCE(c.changed, l.oldest) AS changed,
  CASE WHEN l.ls IS NULL THEN t.score ELSE {ALPHA} * t.score + (1.0E0 - {ALPHA}) * l.ls END AS s
FROM clean_score t LEFT JOIN {prefix}_last l ON l.chain = t.chain AND l.date = t.date
LEFT JOIN {prefix}_change c ON c.chain = t.chain AND c.date = t.date"""
    CTES[prefix + "_held"] = f"""
SELECT *, CASE WHEN lr IS NOT NULL AND ABS(s - ls) < 10 THEN lr ELSE {regime("s")} END AS held FROM {prefix}_smooth"""
    CTES[prefix + "_final"] = f"""
SELECT *, CASE WHEN lr IS NULL OR held = lr THEN held
  WHEN ({epoch(0)} - changed) / 3600.0E0 < 48 THEN lr ELSE held END AS regime FROM {prefix}_held"""


CTES["plain_signal"] = f"""
SELECT chain, date, score AS risk_score, {regime("score")} AS regime, 50.0E0 AS whale_index, 50.0E0 AS momentum_score,
  {epoch(27)} AS created_at FROM clean_score"""
step_ctes("plain", "plain_signal")
step_ctes("full", "stored_signal")
oracle("hysteresis_step", f"SELECT chain, date, {R('s', 'risk_score')}, held AS regime FROM plain_held")
oracle("rate_limit_step", f"""
SELECT chain, date, {regime("raw")} AS wanted,
  CASE WHEN lr IS NULL OR {regime("raw")} = lr THEN {regime("raw")}
       WHEN ({epoch(0)} - changed) / 3600.0E0 < 48 THEN lr ELSE {regime("raw")} END AS regime
FROM plain_smooth""")
CTES["stepped"] = """
SELECT f.chain, f.date, f.s AS risk_score, f.regime, i.whale_index, i.stress_index, i.momentum_score,
  f.lw AS pw, f.lm AS pm, f.lr AS pr
FROM full_final f JOIN indexed i ON i.chain = f.chain AND i.date = f.date"""
oracle("signal_step", f"""
SELECT chain, date, {R("risk_score", "risk_score")}, regime, {state("risk_score")} AS risk_state,
  {Rs(["whale_index", "stress_index", "momentum_score"])}, {R("pw", "prev_whale_index")}, {R("pm", "prev_momentum_score")},
  pr AS prev_regime FROM stepped""")
CTES["recent_pair"] = """
SELECT * REPLACE (CASE WHEN date - pd <= 30 THEN pw END AS pw, CASE WHEN date - pd <= 30 THEN pm END AS pm,
  CASE WHEN date - pd <= 30 THEN pr END AS pr) FROM signal_pair"""
oracle("alerts", alert_union("recent_pair"))

# ------------------------------------------------------------------ quality

_cols = [*ALL, "close_price"]
CTES["stored_days"] = """
SELECT * FROM priced_day UNION ALL SELECT * FROM priced_day WHERE date >= DATE '2001-01-01'"""
CTES["priced_day"] = """
SELECT *, CASE WHEN gas_price_median > 33 THEN 'inf'::DOUBLE ELSE gas_price_median END AS close_price FROM all_day"""
oracle("violations_daily", " UNION ALL ".join(
    [
        "SELECT COALESCE(d.chain, p.chain) AS chain, COALESCE(d.date, p.date) AS date, 'not_one_row' AS rule, "
        "'' AS column_name, 'error' AS severity FROM (SELECT chain, date, COUNT(*) AS n FROM stored_days GROUP BY ALL) d "
        "RIGHT JOIN prices p ON p.chain = d.chain AND p.date = d.date WHERE COALESCE(d.n, 0) <> 1",
        "SELECT chain, date, 'unexpected_date', 'date', 'error' FROM (SELECT DISTINCT chain, date FROM stored_days "
        "EXCEPT SELECT chain, date FROM prices)",
    ]
    + [
        f"SELECT chain, date, 'missing_value', '{n}', '{'error' if n in ('close_price', 'gas_price_median') else 'warning'}' "
        f"FROM stored_days WHERE {n} IS NULL" for n in _cols
    ]
    + [f"SELECT chain, date, 'infinite_value', '{n}', 'error' FROM stored_days WHERE ABS({n}) = 'inf'::DOUBLE" for n in _cols]
))


def reasons(names: list[str]) -> str:
    parts = []
    for n in names:
        parts += [f"CASE WHEN {n} IS NULL THEN 'not_finite:{n}' END", f"CASE WHEN ABS({n}) > 700000 THEN 'out_of_bounds:{n}' END"]
    return f"CONCAT_WS(',', {', '.join(parts)})"


oracle("feature_validity", f"""
SELECT chain, date, reasons = '' AS is_valid, reasons
FROM (SELECT chain, date, CASE WHEN chain = 'BTC' THEN {reasons(BTC)} ELSE {reasons(ETH)} END AS reasons FROM all_day)""")
CTES["damaged"] = """
SELECT CASE WHEN EXTRACT(DAY FROM date) = 7 THEN 'DOGE' ELSE chain END AS chain, date,
  CASE WHEN EXTRACT(DAY FROM date) = 3 THEN NULL WHEN EXTRACT(DAY FROM date) = 4 THEN risk_score + 60 ELSE risk_score END
    AS risk_score,
  CASE WHEN EXTRACT(DAY FROM date) = 5 THEN 'Sideways' ELSE regime END AS regime,
  CASE WHEN EXTRACT(DAY FROM date) = 6 THEN NULL ELSE risk_state END AS risk_state FROM stored_signal"""
CTES["damage"] = """
SELECT chain, date, 'unknown_chain' AS rule, 'chain' AS column_name FROM damaged WHERE chain NOT IN ('BTC', 'ETH')
UNION ALL SELECT chain, date, 'future_date', 'date' FROM damaged WHERE date > DATE '2024-01-25'
UNION ALL SELECT chain, date, 'not_finite', 'risk_score' FROM damaged WHERE risk_score IS NULL
UNION ALL SELECT chain, date, 'out_of_range', 'risk_score' FROM damaged WHERE risk_score > 100
UNION ALL SELECT chain, date, 'unknown_value', 'regime' FROM damaged WHERE regime NOT IN ('Bull', 'Neutral', 'Bear')
UNION ALL SELECT chain, date, 'unknown_value', 'risk_state' FROM damaged WHERE risk_state IS NULL"""
oracle("violations_signals", "SELECT chain, date, rule, column_name, 'error' AS severity FROM damage")
oracle("signals_accepted", f"""
SELECT chain, date, {R("risk_score", "risk_score")}, regime FROM damaged d
WHERE NOT EXISTS (SELECT 1 FROM damage x WHERE x.chain = d.chain AND x.date = d.date)""")
oracle("violations_alerts", """
SELECT chain, date, 'missing_value' AS rule, 'message' AS column_name, 'error' AS severity FROM stored_alert
WHERE EXTRACT(DAY FROM date) % 3 = 0
UNION ALL SELECT chain, date, 'unknown_value', 'alert_type', 'error' FROM stored_alert WHERE EXTRACT(DAY FROM date) % 5 = 0""")
oracle("violations_performance", "SELECT chain, model_version, 'auc' AS column_name FROM performance WHERE auc * 1.6 > 1")

# ------------------------------------------------------------------ stored tables

_sig = ["risk_score", "whale_index", "stress_index", "momentum_score"]
_sig_out = f"chain, date, {Rs(_sig)}, regime, risk_state, created_at"
oracle("upsert_signals", f"""
SELECT {_sig_out} FROM stored_signal WHERE date < DATE '2000-01-01'
UNION ALL
SELECT {_sig_out} FROM (SELECT * REPLACE (
    CASE WHEN date >= DATE '2001-01-01' THEN 'Risk OFF' ELSE 'Neutral' END AS risk_state,
    created_at + CASE WHEN date >= DATE '2001-01-01' THEN 48 ELSE 24 END * 3600 AS created_at)
  FROM stored_signal WHERE date >= DATE '2000-01-01')""")
oracle("upsert_performance", f"""
SELECT chain, model_version, {R("auc", "auc")},
  {R("CASE WHEN model_version = '1.0.3' THEN hitrate ELSE 0.5E0 END", "hitrate")}, sharpe_ratio,
  trained_at + CASE WHEN model_version = '1.0.3' THEN 0 ELSE 60 END AS trained_at FROM performance""")
oracle("insert_alerts", """
SELECT chain, date, alert_type, message, created_at + CASE WHEN date > DATE '2000-06-30' THEN 86400 ELSE 0 END AS created_at
FROM stored_alert""")
oracle("split_signal_alerts", f"SELECT *, {epoch(27)} AS created_at FROM ({alert_union('stepped')})")
oracle("retention", """
SELECT chain, COUNT(*) AS n_days, MIN(date) AS first_day FROM all_day WHERE date >= DATE '2000-01-01' GROUP BY chain""")

# ------------------------------------------------------------------ reports

CTES["newest"] = "SELECT * FROM stored_signal QUALIFY ROW_NUMBER() OVER (PARTITION BY chain ORDER BY date DESC) = 1"
CTES["alert_list"] = """
SELECT chain, date, COUNT(*) AS n_alerts, STRING_AGG(alert_type, ',' ORDER BY alert_type) AS alert_types
FROM stored_alert GROUP BY chain, date"""
_nested = "COALESCE(a.n_alerts, 0) AS n_alerts, COALESCE(a.alert_types, '') AS alert_types"
_sig_s = f"s.chain, s.date, {', '.join(R('s.' + n, n) for n in _sig)}, s.regime, s.risk_state"
oracle("latest_signal", f"SELECT {_sig_out} FROM newest WHERE chain = 'BTC'")
oracle("latest_all", f"""
SELECT {_sig_s}, s.created_at, {_nested} FROM newest s LEFT JOIN alert_list a ON a.chain = s.chain AND a.date = s.date""")
oracle("signal_history", f"""
SELECT {_sig_out} FROM stored_signal WHERE chain = 'BTC' AND date BETWEEN DATE '1997-03-01' AND DATE '1999-03-01'""")
_response = f"""
SELECT {_sig_s}, s.created_at AS updated_at, {_nested} FROM {{rows}} s LEFT JOIN alert_list a ON a.chain = s.chain AND a.date = s.date"""
oracle("latest_signal_with_alerts", _response.format(rows="newest") + " WHERE s.chain = 'ETH'")
_range = "(SELECT * FROM stored_signal WHERE chain = 'BTC' AND date BETWEEN DATE '1997-03-01' AND DATE '1999-03-01')"
oracle("signal_history_with_alerts", f"SELECT *, COUNT(*) OVER () AS n_signals FROM ({_response.format(rows=_range)})")
oracle("last_n_signals", f"""
SELECT {_sig_out} FROM stored_signal QUALIFY ROW_NUMBER() OVER (PARTITION BY chain ORDER BY date DESC) <= 30""")
oracle("signals_with_alerts", f"""
SELECT {_sig_s}, CASE WHEN EXTRACT(DAY FROM s.date) % 4 = 0 THEN 1706670000 ELSE s.created_at END AS updated_at, {_nested}
FROM stored_signal s LEFT JOIN alert_list a ON a.chain = s.chain AND a.date = s.date""")
_alert_out = "chain, date, alert_type, message, created_at"
oracle("alerts_for_date", f"""
SELECT {_alert_out} FROM stored_alert
WHERE date = (SELECT date FROM stored_alert GROUP BY date ORDER BY COUNT(*) DESC, date DESC LIMIT 1)""")
oracle("alerts_on_fixed_date", f"""
SELECT {_alert_out} FROM stored_alert WHERE date = DATE '2024-01-17' AND alert_type = 'regime_shift'""")
oracle("alerts_today", f"SELECT {_alert_out} FROM stored_alert WHERE date = DATE '2024-01-17'")
oracle("recent_alerts", f"""
SELECT {_alert_out} FROM stored_alert WHERE chain = 'ETH' AND date BETWEEN DATE '2024-01-02' AND DATE '2024-01-31'
ORDER BY date DESC, created_at DESC, chain, alert_type LIMIT 20""")
oracle("recent_alerts_cut", f"""
SELECT {_alert_out} FROM stored_alert WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-31'
ORDER BY date DESC, created_at DESC, chain, alert_type LIMIT 5""")
oracle("alert_readiness", """
SELECT DISTINCT date, CASE WHEN date > DATE '2024-01-29' THEN 'future'
  WHEN date = DATE '2024-01-29' AND date NOT IN (SELECT date FROM stored_alert) THEN 'not_processed' ELSE 'ready' END AS readiness
FROM spine""")
CTES["best_known"] = "SELECT * FROM performance QUALIFY ROW_NUMBER() OVER (PARTITION BY chain ORDER BY trained_at DESC) = 1"
oracle("latest_model", f"SELECT chain, model_version, {Rs(['auc', 'hitrate'])}, sharpe_ratio, trained_at FROM best_known")
oracle("active_model", f"""
SELECT chain, model_version, {R("auc", "auc")}, trained_at FROM performance WHERE auc >= 0.6
QUALIFY ROW_NUMBER() OVER (PARTITION BY chain ORDER BY trained_at DESC) = 1""")
oracle("next_version", """
SELECT c.chain, COALESCE('1.0.' || CAST(CAST(SPLIT_PART(model_version, '.', 3) AS INTEGER) + 1 AS VARCHAR), '1.0.0') AS next_version
FROM (VALUES ('BTC'), ('ETH'), ('SOL')) c(chain) LEFT JOIN best_known b ON b.chain = c.chain""")


def status(age: str) -> str:
    return f"CASE WHEN {age} <= 24 THEN 'healthy' WHEN {age} <= 48 THEN 'degraded' ELSE 'unhealthy' END"


def age(as_of: int) -> str:
    return f"({as_of} - CAST(n.date - DATE '1970-01-01' AS BIGINT) * 86400) / 3600.0E0"


oracle("chain_status", f"""
SELECT n.chain, n.date AS latest_signal_date, {R("n.risk_score", "latest_risk_score")}, n.regime AS latest_regime,
  b.model_version, b.trained_at AS last_model_trained_at, {status(age(1706670000))} AS status
FROM newest n JOIN best_known b ON b.chain = n.chain""")
oracle("chain_list", f"SELECT n.chain, n.date AS latest_signal_date, {status(age(1706659200))} AS status FROM newest n")
oracle("freshness", f"""
SELECT {age(1706670000)} AS latest_signal_age_hours, {status(age(1706670000))} AS status FROM newest n WHERE chain = 'ETH'""")
oracle("train_score", """
SELECT d.chain, d.date, l.target::INTEGER AS y, TRUE AS score_ok FROM all_day d JOIN labelled l ON l.chain = d.chain AND l.date = d.date
WHERE l.target IS NOT NULL AND (d.chain = 'BTC' AND d.date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'
  OR d.chain = 'ETH' AND d.date BETWEEN DATE '2024-01-07' AND DATE '2024-01-31')""")
oracle("training_evidence", """
SELECT d.chain, COUNT(*) FILTER (d.chain = 'BTC' AND d.date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' OR d.chain = 'ETH' AND d.date BETWEEN DATE '2024-01-01' AND DATE '2024-01-06') AS n_train,
  CASE d.chain WHEN 'BTC' THEN 7 ELSE 6 END::BIGINT AS n_params, TRUE AS learns, TRUE AS same_auc, TRUE AS keeps_best, TRUE AS stops
FROM all_day d JOIN labelled l ON l.chain = d.chain AND l.date = d.date WHERE l.target IS NOT NULL GROUP BY d.chain""")
