"""DuckDB SQL of the queries on corporate events. The driver's tables have none, so every 97th week of a brand gets one."""

from __future__ import annotations

from .sql import BRAND, PANEL, rounded

_BASE = f"""WITH {BRAND}, {PANEL},
grid AS (SELECT u.symbol, u.asset_idx, c.t, c.day FROM uni u CROSS JOIN cal c),
ev AS (
  SELECT symbol, day + CAST(asset_idx % 3 AS INTEGER) AS date, CASE asset_idx % 4 WHEN 0 THEN 1 WHEN 1 THEN 11 WHEN 2 THEN 12 ELSE 5 END AS category_code,
    CASE asset_idx % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS c3
  FROM grid WHERE (t + 7 * asset_idx) % 97 = 0
),
prev AS (SELECT e.symbol, e.date, max(b.day) AS pd FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.day < e.date GROUP BY ALL),
nxt AS (SELECT e.symbol, e.date, min(b.day) AS ed FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.day >= e.date GROUP BY ALL),
near AS (
  SELECT e.*, p.pd, n.ed, bp.close AS pc, bp.volume AS pv, bn.close AS ec, bn.volume AS evol,
    CASE WHEN category_code = 5 THEN 'unsupported_category' WHEN pd IS NULL THEN 'no_previous_daily_row' WHEN ed IS NULL THEN 'future_event' ELSE '' END AS skip_reason
  FROM ev e LEFT JOIN prev p ON p.symbol = e.symbol AND p.date = e.date LEFT JOIN nxt n ON n.symbol = e.symbol AND n.date = e.date
  LEFT JOIN bars bp ON bp.symbol = e.symbol AND bp.day = p.pd LEFT JOIN bars bn ON bn.symbol = e.symbol AND bn.day = n.ed
),
stepped AS (
  SELECT *, CASE WHEN category_code = 1 THEN (10.0::DOUBLE + 1.0 + 1.0) / 10.0 ELSE c3 END AS share_step,
    CASE WHEN category_code = 1 THEN (pc - 0.5::DOUBLE) / ((10.0::DOUBLE + 1.0 + 1.0) / 10.0) ELSE pc / c3 END AS ex_close
  FROM near WHERE skip_reason = ''
)"""

_ADJUSTED = f"""{_BASE},
factored AS (
  SELECT b.symbol, b.day, any_value(b.open) AS open, any_value(b.high) AS high, any_value(b.low) AS low, any_value(b.close) AS close, any_value(b.volume) AS volume,
    any_value(b.amount) AS amount, coalesce(product(s.ex_close / s.pc), 1.0::DOUBLE) AS price_factor, coalesce(product(s.share_step), 1.0::DOUBLE) AS share_factor
  FROM bars b LEFT JOIN stepped s ON s.symbol = b.symbol AND s.date > b.day GROUP BY b.symbol, b.day
),
adj AS (
  SELECT *, open * price_factor AS adj_open, high * price_factor AS adj_high, low * price_factor AS adj_low, close * price_factor AS adj_close, volume * share_factor AS adj_volume,
    lag(close * price_factor) OVER (PARTITION BY symbol ORDER BY day) AS before, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS raw_return,
    (SELECT count(*) FROM stepped s WHERE s.symbol = f.symbol AND s.ed = f.day) AS applied_event_count
  FROM factored f
),
adjusted AS (SELECT *, adj_close / before - 1 AS adj_return FROM adj)"""

EVENT_AUDIT = f"""{_BASE}
SELECT n.symbol, n.date, n.category_code, CASE WHEN n.skip_reason <> '' THEN 'non_adjustment_event' WHEN n.category_code = 1 THEN 'cash_bonus_rights' ELSE 'share_split_merge' END AS event_kind,
  n.skip_reason = '' AS applied, n.skip_reason, s.pd AS previous_day, s.ed AS effective_day, round(s.pc, 6) + 0.0 AS previous_close, round(s.ec, 6) + 0.0 AS effective_close,
  round(s.share_step, 6) + 0.0 AS share_step, round(s.ex_close / s.pc, 6) + 0.0 AS price_step, round(s.ex_close, 6) + 0.0 AS ex_close, round(s.ec / s.pc - 1, 6) + 0.0 AS raw_event_return,
  round(s.ec / s.ex_close - 1, 6) + 0.0 AS adjusted_event_return, round(s.evol / s.pv, 6) + 0.0 AS raw_volume_ratio, round(s.evol / (s.pv * s.share_step), 6) + 0.0 AS adjusted_volume_ratio
FROM near n LEFT JOIN stepped s ON s.symbol = n.symbol AND s.date = n.date"""

_SHOWN = ("price_factor", "share_factor", "adj_open", "adj_high", "adj_low", "adj_close", "adj_volume", "raw_return", "adj_return")
ADJUSTED_BARS = f"{_ADJUSTED} SELECT symbol, day, {rounded(*_SHOWN, digits=6)}, applied_event_count FROM adjusted"
ADJUSTMENT_ANOMALIES = f"{_ADJUSTED} SELECT symbol, day, {rounded('raw_return', 'adj_return', digits=6)} FROM adjusted WHERE abs(raw_return) > 0.2::DOUBLE OR abs(adj_return) > 0.2::DOUBLE"

_QUALITY = f"""{_ADJUSTED},
quality AS (
  SELECT symbol, count(*) AS rows, min(day) AS first_day, max(day) AS last_day, count_if(abs(raw_return) > 0.2::DOUBLE) AS raw_jumps, count_if(abs(adj_return) > 0.2::DOUBLE) AS adjusted_jumps,
    max(abs(raw_return)) AS max_raw_return, max(abs(adj_return)) AS max_adjusted_return, count_if(least(adj_open, adj_high, adj_low, adj_close) <= 0) AS invalid_price_rows,
    count_if(adj_high < greatest(adj_open, adj_close)) AS invalid_high_rows, count_if(adj_low > least(adj_open, adj_close)) AS invalid_low_rows, count_if(adj_volume < 0) AS invalid_volume_rows,
    count_if(amount < 0) AS invalid_amount_rows, count_if(volume > 0 AND amount > 0 AND (amount / volume < low * 0.98::DOUBLE OR amount / volume > high * 1.02::DOUBLE)) AS invalid_implied_price_rows,
    count_if((volume = 0) <> (amount = 0)) AS flow_zero_mismatch_rows, count_if(NOT (volume > 0 AND amount > 0)) AS nontradable_rows
  FROM adjusted GROUP BY symbol
)"""
ADJUSTMENT_QUALITY = f"""{_QUALITY} SELECT q.* REPLACE (round(max_raw_return, 6) + 0.0 AS max_raw_return, round(max_adjusted_return, 6) + 0.0 AS max_adjusted_return),
  (SELECT count(*) FROM stepped s WHERE s.symbol = q.symbol) AS applied_events, (SELECT count(*) FROM stepped s WHERE s.symbol = q.symbol AND category_code > 1) AS share_events FROM quality q"""
GATE_FAILURES = f"""{_QUALITY} SELECT "check", CAST(failures AS BIGINT) AS failures FROM (
  SELECT 'adjusted_jumps' AS "check", sum(adjusted_jumps) AS failures FROM quality UNION ALL SELECT 'invalid_price_rows', sum(invalid_price_rows) FROM quality
  UNION ALL SELECT 'invalid_high_rows', sum(invalid_high_rows) FROM quality UNION ALL SELECT 'invalid_low_rows', sum(invalid_low_rows) FROM quality
  UNION ALL SELECT 'invalid_volume_rows', sum(invalid_volume_rows) FROM quality UNION ALL SELECT 'invalid_amount_rows', sum(invalid_amount_rows) FROM quality
  UNION ALL SELECT 'invalid_implied_price_rows', sum(invalid_implied_price_rows) FROM quality UNION ALL SELECT 'flow_zero_mismatch_rows', sum(flow_zero_mismatch_rows) FROM quality
) WHERE failures <> 0"""

_RELATIVE = ", ".join(f"CASE WHEN before > 0 THEN adj_{p} / before - 1 END AS {p}_rel" for p in ("open", "high", "low", "close"))
RELATIVE_BARS = f"{_ADJUSTED}, rel AS (SELECT symbol, day, {_RELATIVE} FROM adjusted) SELECT symbol, day, {rounded('open_rel', 'high_rel', 'low_rel', 'close_rel', digits=6)} FROM rel"
RELATIVE_QUALITY = f"""{_ADJUSTED}, rel AS (SELECT {_RELATIVE} FROM adjusted)
SELECT count_if(high_rel < greatest(open_rel, close_rel)) AS invalid_high_rows, count_if(low_rel > least(open_rel, close_rel)) AS invalid_low_rows,
  count_if(least(open_rel, high_rel, low_rel, close_rel) <= -1) AS impossible_price_rows FROM rel WHERE open_rel IS NOT NULL"""

RECONCILED_FLOW = f"""WITH {BRAND}, {PANEL},
flow AS (SELECT symbol, day, volume + 1 AS vol, CASE WHEN t % 7 <> 0 THEN round(amount, 4) / 2000 END AS thousands FROM panel WHERE tradable AND t % 5 <> 0),
mixed AS (
  SELECT b.symbol, b.day, CASE WHEN thousands IS NOT NULL THEN vol ELSE b.volume END AS volume, CASE WHEN thousands IS NOT NULL THEN thousands * 1000 ELSE round(b.amount, 4) END AS amount,
    CASE WHEN thousands IS NOT NULL THEN 'second_vendor' ELSE 'first_vendor' END AS flow_source
  FROM bars b LEFT JOIN flow f ON f.symbol = b.symbol AND f.day = b.day
)
SELECT symbol, day, round(volume, 4) + 0.0 AS volume, round(amount, 4) + 0.0 AS amount, flow_source, volume > 0 AND amount > 0 AS tradable, amount / (volume * 100) AS implied_price FROM mixed"""
