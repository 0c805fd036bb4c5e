"""DuckDB SQL of the registered queries, built from common table expressions that several of them share."""

from __future__ import annotations

from .functions import factors

_ORDER = "(l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)"


def _bars(symbol: str, day: str, joins: str) -> str:
    return f"""bars AS (
  SELECT {symbol} AS symbol, {day} AS day, arg_min(l_extendedprice / l_quantity, {_ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {_ORDER}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem {joins} GROUP BY ALL
)"""


BRAND = _bars("p_brand", "CAST(date_trunc('week', l_shipdate) AS DATE)", "JOIN part ON l_partkey = p_partkey")
NATION = _bars("n_name", "CAST(l_shipdate AS DATE)", "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
_FIELDS = ("open", "high", "low", "close", "volume", "amount")
PANEL = f"""uni AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS asset_idx FROM (SELECT DISTINCT symbol FROM bars)),
cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM (SELECT DISTINCT day FROM bars)),
panel AS (
  SELECT asset_idx, symbol, t, day, {', '.join(f'CASE WHEN tradable THEN {c} END AS {c}' for c in _FIELDS)}, tradable
  FROM (
    SELECT uni.asset_idx, uni.symbol, cal.t, cal.day, {', '.join(f'b.{c}' for c in _FIELDS)}, coalesce(b.volume > 0 AND b.amount > 0, false) AS tradable
    FROM uni CROSS JOIN cal LEFT JOIN bars b ON b.symbol = uni.symbol AND b.day = cal.day
  )
)"""


def rounded(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def bars(source: str) -> str:
    return f"WITH {source} SELECT symbol, day, {rounded('open', 'high', 'low', 'close')}, {rounded('volume', 'amount', digits=4)} FROM bars"


def panel(source: str) -> str:
    return f"WITH {source}, {PANEL} SELECT asset_idx, symbol, t, day, tradable, {rounded('open', 'close')}, {rounded('volume', digits=4)} FROM panel"


W = "OVER (PARTITION BY asset_idx ORDER BY t)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY asset_idx ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, f: str) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {f}({x}) {frame(n)} END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) END"


def factor(name: str) -> str:
    """A base factor over the panel's columns and, for VOL, over dayret."""
    family, *rest = name.rsplit("_", 2 if name.startswith("MA_RATIO") else 1)
    n = [*map(int, rest)] if name not in factors.FIXED else []
    before = f"lag(close, 1) {W}"
    x = {
        "DAYRET": lambda: ratio("close", before) + " - 1",
        "GAP": lambda: ratio("open", before) + " - 1",
        "INTRADAY": lambda: ratio("close", "open") + " - 1",
        "RANGE": lambda: ratio("high - low", before),
        "CLV": lambda: "CASE WHEN high - low > 0 THEN (close * 2 - high - low) / (high - low) WHEN high - low = 0 THEN 0.0 END",
        "ROC": lambda: ratio("close", f"lag(close, {n[0]}) {W}") + " - 1",
        "PRICE_MA": lambda: ratio("close", full("close", n[0], "avg")) + " - 1",
        "VOL": lambda: full("dayret", n[0], "stddev_pop"),
        "TS_RANK": lambda: f"""CASE WHEN count(close) {frame(n[0])} = {n[0]} THEN
          (list_sum(list_transform(list(close) {frame(n[0])}, lambda v: CASE WHEN v < close THEN 1.0::DOUBLE WHEN v = close THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) - 0.5) / {n[0] - 1} END""",
        "RSV": lambda: f"""CASE WHEN {full('high', n[0], 'max')} - {full('low', n[0], 'min')} > 0
          THEN (close - {full('low', n[0], 'min')}) / ({full('high', n[0], 'max')} - {full('low', n[0], 'min')})
          WHEN {full('high', n[0], 'max')} - {full('low', n[0], 'min')} = 0 THEN 0.0 END""",
        "MA_RATIO": lambda: ratio(full("close", n[0], "avg"), full("close", n[1], "avg")) + " - 1",
    }[family if family in (*factors.FAMILIES, "MA_RATIO") else name]()
    return f"CASE WHEN tradable THEN {x} END"


def with_factors(source: str, names: tuple[str, ...]) -> str:
    """CTEs up to `factored`: the panel with the factors."""
    return f"""{source}, {PANEL},
returned AS (SELECT *, {factor('DAYRET')} AS dayret FROM panel),
factored AS (SELECT * EXCLUDE (dayret), {', '.join(f'{factor(n)} AS "{n}"' for n in names)} FROM returned)"""


def factor_query(source: str, names: tuple[str, ...]) -> str:
    return f"WITH {with_factors(source, names)} SELECT asset_idx, t, {rounded(*names)} FROM factored"


def mean(x: str, n: int) -> str:
    return full(x, n, "avg")


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"


OLDER = {
    **{f"DELAY{k}": f"lag(close, {k}) {W}" for k in (1, 5, 10)},
    **{f"MA{k}": mean("close", k) for k in (5, 10, 20)},
    "STD10": full("close", 10, "stddev_pop"),
    **{f"RET{k}": _safe("close", f"lag(close, {k}) {W}") + " - 1" for k in (5, 10)},
    "DECAY": f"(close + 0.8::DOUBLE * lag(close, 1) {W} + 0.6::DOUBLE * lag(close, 2) {W}) / 2.4::DOUBLE",
}
OLDER_OPERATORS = f"WITH {BRAND}, {PANEL} SELECT asset_idx, t, {', '.join(f'round({x}, 8) + 0.0 AS {n}' for n, x in OLDER.items())} FROM panel"

FIXED_FORMULAS = f"""WITH {BRAND}, {PANEL},
z AS (SELECT *, {_safe(f"amount - {mean('amount', 20)}", full('amount', 20, 'stddev_pop'))} AS z, {OLDER['RET10']} AS r10 FROM panel)
SELECT asset_idx, t, round(r10, 8) + 0.0 AS mom_10, round({_safe(mean('close', 5), mean('close', 20))} - 1, 8) + 0.0 AS ma_gap_5_20,
  round(r10 * CASE WHEN z > 0 THEN z WHEN z IS NOT NULL THEN 0.0 END, 6) + 0.0 AS volume_confirmed_mom_10, round(-({OLDER['RET5']}), 8) + 0.0 AS reversal_5
FROM z"""

#: Forward targets of the split that starts at t = 60 and ends with the calendar, for a horizon of 10.
TARGETS = """sale AS (
  SELECT *, CASE WHEN tradable AND open > 0 THEN t END AS exec_t, CASE WHEN tradable AND open > 0 THEN open END AS exec_open FROM panel
),
ahead AS (SELECT *, min(exec_t) OVER (PARTITION BY asset_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_t FROM sale),
placed AS (
  SELECT *, lead(t, 1) OVER w AS buy_t, lead(exec_open, 1) OVER w AS buy_open, lead(next_t, 11) OVER w AS planned_t FROM ahead
  WINDOW w AS (PARTITION BY asset_idx ORDER BY t)
),
priced AS (
  SELECT p.*, CASE WHEN p.buy_open IS NOT NULL THEN s.t END AS sell_t, CASE WHEN p.buy_open IS NULL THEN 0.0::DOUBLE ELSE s.open / p.buy_open - 1 END AS fwd_ret
  FROM placed p LEFT JOIN panel s ON s.asset_idx = p.asset_idx AND s.t = p.planned_t
  WHERE p.t >= 60 AND p.buy_t IS NOT NULL AND p.tradable
),
days AS (
  SELECT t, count(*) AS available_count, avg(fwd_ret) AS baseline_ret, least(4, greatest(2, CAST(ceil(count(*) * 0.2::DOUBLE) AS INTEGER))) AS top_k
  FROM priced GROUP BY t HAVING count(*) = count(fwd_ret) AND count(*) >= 10
),
targets AS (SELECT p.*, d.available_count, d.baseline_ret, d.top_k FROM priced p JOIN days d ON d.t = p.t)"""


def _daily(signal: str) -> str:
    return f"""sig AS (SELECT *, CAST({signal} AS FLOAT) AS s FROM targets),
ranks AS (
  SELECT *, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY s DESC NULLS LAST, asset_idx) END AS rk, count(s) OVER (PARTITION BY t) AS eligible_count,
    CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY t, s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY t, s) - 1) / 2.0::DOUBLE END AS rank_sig,
    CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY t, s IS NULL ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY t, s IS NULL, fwd_ret) - 1) / 2.0::DOUBLE END AS rank_ret
  FROM sig
),
daily AS (
  SELECT t, day, CAST(min(available_count) AS BIGINT) AS available_count, CAST(min(eligible_count) AS BIGINT) AS eligible_count, CAST(min(top_k) AS BIGINT) AS top_k,
    avg(fwd_ret) FILTER (rk <= top_k) AS absolute_return, min(baseline_ret) AS baseline_return,
    coalesce(string_agg(CAST(asset_idx AS VARCHAR), ';' ORDER BY rk) FILTER (rk <= top_k), '') AS selected,
    max(coalesce(sell_t, -1)) FILTER (rk <= top_k) AS last_exit,
    CASE WHEN min(eligible_count) >= 10 AND stddev_pop(rank_sig) > 0 AND stddev_pop(rank_ret) > 0 THEN round(corr(rank_sig, rank_ret), 12) END AS rank_ic
  FROM ranks GROUP BY t, day
)"""


def scored(factors_used: tuple[str, ...], signal: str) -> str:
    return f"WITH {with_factors(BRAND, factors_used)}, {TARGETS.replace('FROM panel', 'FROM factored', 1)}, {_daily(signal)}"


FORWARD_TARGETS = f"""WITH {BRAND}, {PANEL}, {TARGETS}
SELECT asset_idx, t, buy_t, sell_t, round(fwd_ret, 8) + 0.0 AS fwd_ret, CAST(available_count AS BIGINT) AS available_count, CAST(top_k AS BIGINT) AS top_k, round(baseline_ret, 8) + 0.0 AS baseline_ret
FROM targets"""


def score_daily(factors_used: tuple[str, ...], signal: str) -> str:
    return f"""{scored(factors_used, signal)}
SELECT t, day, available_count, eligible_count, top_k, selected, last_exit, {rounded('absolute_return', 'baseline_return', 'rank_ic')},
  round(absolute_return - baseline_return, 8) + 0.0 AS excess_return FROM daily"""


def score_summary(factors_used: tuple[str, ...], signal: str) -> str:
    return f"""{scored(factors_used, signal)},
s AS (SELECT coalesce(bool_and(eligible_count >= top_k), false) AS valid, count(*) AS scorer_days, avg(absolute_return - baseline_return) AS excess, avg(absolute_return) AS a,
  median(absolute_return) AS m, avg(CASE WHEN absolute_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS h, avg(baseline_return) AS b, avg(rank_ic) AS im, stddev_pop(rank_ic) AS isd,
  avg(CASE WHEN rank_ic > 0 THEN 1.0::DOUBLE WHEN rank_ic IS NOT NULL THEN 0.0::DOUBLE END) AS ip FROM daily)
SELECT valid, scorer_days, round(CASE WHEN valid THEN excess ELSE -5.0::DOUBLE END, 8) + 0.0 AS reward, round(CASE WHEN valid THEN a END, 8) + 0.0 AS mean_absolute_return,
  round(CASE WHEN valid THEN m END, 8) + 0.0 AS median_absolute_return, round(CASE WHEN valid THEN h END, 8) + 0.0 AS absolute_hit_rate, round(CASE WHEN valid THEN b END, 8) + 0.0 AS mean_baseline_return,
  round(CASE WHEN valid THEN im END, 8) + 0.0 AS rank_ic_mean, round(CASE WHEN valid THEN isd END, 8) + 0.0 AS rank_ic_std, round(CASE WHEN valid AND isd > 0 THEN im / isd END, 6) + 0.0 AS rank_ic_ir,
  round(CASE WHEN valid THEN ip END, 8) + 0.0 AS rank_ic_positive_rate FROM s"""


#: Every tenth day from each offset, leaving out days bought before the last sale: a recursion along each offset.
def drawdowns(factors_used: tuple[str, ...], signal: str) -> str:
    return f"""{scored(factors_used, signal).replace('WITH', 'WITH RECURSIVE', 1)},
numbered AS (SELECT *, (row_number() OVER (ORDER BY t) - 1) AS p FROM daily),
steps AS (SELECT p % 10 AS o, row_number() OVER (PARTITION BY p % 10 ORDER BY t) AS i, t, last_exit, absolute_return FROM numbered),
run AS (
  SELECT o, 0::BIGINT AS i, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak, 0.0::DOUBLE AS dd, -1::BIGINT AS ex, 0::BIGINT AS used FROM (SELECT DISTINCT o FROM steps)
  UNION ALL
  SELECT r.o, s.i, CASE WHEN s.t + 1 <= r.ex THEN r.equity ELSE r.equity * (1.0 + s.absolute_return) END,
    CASE WHEN s.t + 1 <= r.ex THEN r.peak ELSE greatest(r.peak, r.equity * (1.0 + s.absolute_return)) END,
    CASE WHEN s.t + 1 <= r.ex THEN r.dd ELSE least(r.dd, r.equity * (1.0 + s.absolute_return) / greatest(r.peak, r.equity * (1.0 + s.absolute_return)) - 1.0) END,
    CASE WHEN s.t + 1 <= r.ex THEN r.ex WHEN s.last_exit >= 0 THEN s.last_exit ELSE s.t + 1 END, CASE WHEN s.t + 1 <= r.ex THEN r.used ELSE r.used + 1 END
  FROM run r JOIN steps s ON s.o = r.o AND s.i = r.i + 1
)
SELECT o AS "offset", round(equity - 1.0, 8) + 0.0 AS total_return, round(dd, 8) + 0.0 AS max_drawdown, used FROM run r WHERE i = (SELECT max(i) FROM steps s WHERE s.o = r.o)"""


_OLD_DAILY = f"""WITH {BRAND}, {PANEL},
sig AS (SELECT *, {OLDER['RET10']} AS s FROM panel),
moved AS (
  SELECT *, lead(open, 1) OVER w AS b, lead(open, 11) OVER w AS x, lead(tradable, 1) OVER w AS ok_b, lead(tradable, 11) OVER w AS ok_s FROM sig
  WINDOW w AS (PARTITION BY asset_idx ORDER BY t)
),
avail AS (SELECT *, count(*) OVER (PARTITION BY t) AS available_count FROM moved WHERE tradable AND ok_s IS NOT NULL),
elig AS (SELECT *, count(*) OVER (PARTITION BY t) AS eligible_count FROM avail WHERE available_count >= 10 AND ok_b AND ok_s AND s IS NOT NULL AND b > 0 AND x IS NOT NULL),
ranks AS (
  SELECT *, least(eligible_count, least(4, greatest(2, CAST(ceil(available_count * 0.2::DOUBLE) AS INTEGER)))) AS top_k, row_number() OVER (PARTITION BY t ORDER BY s DESC, asset_idx) AS rk
  FROM elig WHERE eligible_count >= 2
),
daily AS (
  SELECT t, day, CAST(min(available_count) AS BIGINT) AS available_count, CAST(min(eligible_count) AS BIGINT) AS eligible_count, CAST(min(top_k) AS BIGINT) AS top_k,
    avg(x / b - 1) AS mean_forward_return, median(x / b - 1) AS median_forward_return, avg(CASE WHEN x / b - 1 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hit_rate
  FROM ranks WHERE rk <= top_k GROUP BY t, day
)"""
OLDER_DAILY = f"{_OLD_DAILY} SELECT t, day, available_count, eligible_count, top_k, {rounded('mean_forward_return', 'median_forward_return', 'hit_rate')} FROM daily"
OLDER_SUMMARY = f"""{_OLD_DAILY} SELECT count(*) AS scorer_days, round(avg(mean_forward_return), 8) + 0.0 AS mean_return, round(median(mean_forward_return), 8) + 0.0 AS median_return,
  round(avg(CASE WHEN mean_forward_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) + 0.0 AS hit_rate, round(avg(mean_forward_return) * 252 / 10, 6) + 0.0 AS annual_proxy,
  round(avg(top_k), 8) + 0.0 AS avg_top_k FROM daily"""


def signal_quality(signals: dict[str, str], factors_used: tuple[str, ...]) -> str:
    each = " UNION ALL ".join(f"SELECT '{name}' AS formula, {x} AS v FROM targets" for name, x in signals.items())
    return f"""WITH {with_factors(BRAND, factors_used)}, {TARGETS.replace('FROM panel', 'FROM factored', 1)}, v AS ({each}),
q AS (SELECT formula, count(*) AS available, count(v) AS finite, stddev_pop(v) AS spread FROM v GROUP BY formula),
r AS (SELECT *, CASE WHEN finite = 0 THEN 'non_finite_result' WHEN finite / available < 0.9::DOUBLE THEN 'low_coverage' WHEN spread <= 1e-12 THEN 'constant_signal' ELSE '' END AS reason FROM q)
SELECT formula, available, finite, round(finite / available, 8) + 0.0 AS coverage, round(spread, 8) + 0.0 AS spread, reason,
  CASE WHEN reason = '' THEN 0.0::DOUBLE WHEN reason IN ('low_coverage', 'constant_signal') THEN -2.0::DOUBLE ELSE -5.0::DOUBLE END AS penalty FROM r"""
