"""Registered queries on vendor rows, the inventory, reports and the candidate table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .operators import candidates, inventory, reports, scans, scoring
from .plans import language
from .queries import _VALUES, FORMULAS, HORIZON, START, _signal, query, rounded, tree
from .sources import manifest, star, vendor
from .sources.storage import kept

# Vendor rows. The tables have none, so the brands' weekly bars are written as text, with faults on certain days of a year.

FROM, FACTOR = "1996-01-01", 0.5
_DIGITS = ("5", "6", "0", "1", "3")


def _code(n):
    return F.concat(F.element_at(F.array(*map(F.lit, _DIGITS)), (n % 5 + 1).cast("int")), F.lpad(n.cast("string"), 5, "0"))


def _vendor_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raw, adjusted) rows of text."""
    k = F.dayofyear("day")
    bars = star.bars_brand_week(spark, sf_dir).withColumns({"symbol": _code(F.substring("symbol", 7, 9).cast("int")), "k": k})
    text = {c: F.col(c).cast("string") for c in star.FIELDS}
    text |= {"high": F.when(F.col("k") % 17 == 0, F.col("low")).otherwise(F.col("high")).cast("string"), "volume": F.when(F.col("k") % 11 == 0, F.lit("n/a")).otherwise(F.col("volume").cast("string"))}
    raw = kept(bars.select("symbol", F.concat(F.col("day").cast("string"), F.lit(" 15:00:00")).alias("date"), "k", *[x.alias(c) for c, x in text.items()]))
    halved = [(F.col(c).cast("double") * FACTOR).cast("string").alias(c) for c in star.PRICES]
    return raw.drop("k"), raw.where("k % 13 <> 0").select("symbol", "date", *halved, "volume", "amount")


def _vendor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    code = F.when(key % 7 == 0, "x").otherwise(F.substring("o_orderpriority", 1, 1))
    texts = {"c1": F.col("o_totalprice").cast("string"), "c2": F.lit("n/a"), "c3": (key % 10).cast("string"), "c4": F.lit("")}
    return star.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").cast("string").alias("date"), _code((F.col("o_custkey") % 25 + 1).cast("int")).alias("symbol"), code.alias("category_code"), *[x.alias(c) for c, x in texts.items()]
    )


def _code_sql(n: str) -> str:
    return f"(CASE ({n}) % 5 {' '.join(f'WHEN {i} THEN {d!r}' for i, d in enumerate(_DIGITS))} END || lpad(CAST({n} AS VARCHAR), 5, '0'))"


_P = ("open", "high", "low", "close")
_VENDOR = f"""WITH {sql.BRAND},
coded AS (SELECT *, {_code_sql('CAST(substr(symbol, 7) AS INTEGER)')} AS code, dayofyear(day) AS k FROM bars WHERE day >= DATE '{FROM}'),
raw AS (
  SELECT code AS symbol, day, CASE WHEN left(code, 1) IN ('5', '6') THEN 'sh' ELSE 'sz' END || code AS exchange_symbol, open, CASE WHEN k % 17 = 0 THEN low ELSE high END AS high, low, close,
    CASE WHEN k % 11 <> 0 THEN volume END AS volume, amount, k FROM coded
),
adjusted AS (SELECT symbol, day, exchange_symbol, {', '.join(f'{p} * {FACTOR}::DOUBLE AS {p}' for p in _P)}, volume, amount FROM raw WHERE k % 13 <> 0),
ev AS (
  SELECT CAST(o_orderdate AS DATE) AS date, {_code_sql('CAST(o_custkey % 25 + 1 AS INTEGER)')} AS symbol, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(left(o_orderpriority, 1) AS INTEGER) END AS category_code,
    o_totalprice AS c1, CAST(NULL AS DOUBLE) AS c2, CAST(o_orderkey % 10 AS DOUBLE) AS c3, CAST(NULL AS DOUBLE) AS c4 FROM orders
),
events_n AS (SELECT *, coalesce(category_code = 1, false) AS is_rights, coalesce(category_code IN (2, 3, 5, 7, 8, 9, 10), false) AS is_equity FROM ev)"""


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw, adjusted = _vendor_rows(spark, sf_dir)
    return vendor.normalise_bars(raw, "raw", FROM), vendor.normalise_bars(adjusted, "adjusted", FROM)


@query(f"{_VENDOR} SELECT day, symbol, exchange_symbol, 'raw' AS source, {sql.rounded(*_P)}, {sql.rounded('volume', 'amount', digits=4)} FROM raw")
def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(_raw(spark, sf_dir)[0], *_P), "volume", "amount", digits=4)


@query(f"{_VENDOR} SELECT * FROM events_n")
def vendor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.normalise_events(_vendor_events(spark, sf_dir))


def _checks_sql(source: str, label: str) -> str:
    return f"""SELECT symbol, count_if(least(open, high, low, close) <= 0) AS {label}_invalid_price_rows, count_if(high < greatest(open, close)) AS {label}_invalid_high_rows,
      count_if(low > least(open, close)) AS {label}_invalid_low_rows, count_if(volume IS NULL OR amount IS NULL) AS {label}_missing_flow_rows FROM {source} GROUP BY symbol"""


@query(f"{_VENDOR} {_checks_sql('raw', 'raw')}")
def vendor_ohlc_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.ohlc_checks(_raw(spark, sf_dir)[0], "raw")


_REPORT = f"""{_VENDOR},
names AS (SELECT DISTINCT symbol FROM raw UNION ALL SELECT 'unlisted'),
r AS (SELECT symbol, min(day) AS raw_first_day, max(day) AS raw_last_day, count(*) AS n, arg_max(close, day) AS close, count_if(volume IS NOT NULL) AS whole FROM raw GROUP BY symbol),
a AS (SELECT symbol, count(*) AS n, arg_max(close, day) AS close FROM adjusted GROUP BY symbol),
gaps AS (SELECT symbol, count(*) AS n FROM raw r WHERE NOT EXISTS (SELECT 1 FROM adjusted a WHERE a.symbol = r.symbol AND a.day = r.day) GROUP BY symbol),
e AS (SELECT symbol, count(*) AS n, count_if(is_rights) AS rights FROM events_n GROUP BY symbol), cr AS ({_checks_sql('raw', 'raw')}), ca AS ({_checks_sql('adjusted', 'adjusted')})
SELECT names.symbol, raw_first_day, raw_last_day, coalesce(r.n, 0) AS raw_rows, coalesce(a.n, 0) AS adjusted_rows, coalesce(gaps.n, 0) AS day_mismatches, coalesce(e.n, 0) AS events,
  coalesce(e.rights, 0) AS rights_events, coalesce(r.whole, 0) AS whole_days, round(abs(r.close - a.close), 8) + 0.0 AS latest_close_diff,
  round(coalesce(r.whole, 0) / (SELECT count(DISTINCT day) FROM raw), 8) + 0.0 AS coverage, cr.* EXCLUDE (symbol), ca.* EXCLUDE (symbol)
FROM names LEFT JOIN r ON r.symbol = names.symbol LEFT JOIN a ON a.symbol = names.symbol LEFT JOIN gaps ON gaps.symbol = names.symbol LEFT JOIN e ON e.symbol = names.symbol
LEFT JOIN cr ON cr.symbol = names.symbol LEFT JOIN ca ON ca.symbol = names.symbol"""


@query(_REPORT)
def vendor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, adjusted = _raw(spark, sf_dir)
    names = raw.select("symbol").distinct().unionByName(spark.createDataFrame([("unlisted",)], "symbol string"))
    found = vendor.panel_report(names, raw, adjusted, vendor.normalise_events(_vendor_events(spark, sf_dir)))
    return rounded(found, "latest_close_diff", "coverage")


@query(f"{_VENDOR} SELECT symbol, day, 'left' AS side FROM (SELECT symbol, day FROM raw EXCEPT SELECT symbol, day FROM adjusted) UNION ALL SELECT symbol, day, 'right' FROM (SELECT symbol, day FROM adjusted EXCEPT SELECT symbol, day FROM raw)")
def vendor_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.set_differences(*_raw(spark, sf_dir), ["symbol", "day"])


@query(f"{_VENDOR} SELECT symbol, date, count(*) AS rows FROM events_n GROUP BY symbol, date HAVING count(*) > 1")
def vendor_repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.repeated(vendor.normalise_events(_vendor_events(spark, sf_dir)), ["symbol", "date"])


@query(f"{_VENDOR} SELECT * FROM events_n QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY category_code NULLS FIRST, c1) = 1")
def vendor_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vendor.first_of(vendor.normalise_events(_vendor_events(spark, sf_dir)), ["symbol", "date"], ["category_code", "c1"])


_GAPS = f"""{_VENDOR},
ours AS (SELECT symbol, day, x / lag(x) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM (SELECT symbol, day, close * (1 + k % 3 * 0.01::DOUBLE) AS x FROM raw WHERE k % 9 <> 0)),
theirs AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM adjusted),
gap AS (SELECT o.symbol, abs(o.ret - t.ret) AS g FROM ours o JOIN theirs t ON t.symbol = o.symbol AND t.day = o.day)
SELECT symbol, count(*) AS overlap_rows, round(avg(g), 8) + 0.0 AS mean_gap, round(max(g), 8) + 0.0 AS max_gap, count_if(g > 0.01::DOUBLE) AS gaps_over_1pct, count_if(g > 0.05::DOUBLE) AS gaps_over_5pct
FROM gap WHERE g IS NOT NULL GROUP BY symbol"""


@query(_GAPS)
def vendor_return_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, adjusted = _raw(spark, sf_dir)
    k = F.dayofyear("day")
    ours = vendor.factor_returns(raw, raw.where(k % 9 != 0).select("symbol", "day", (1 + k % 3 * 0.01).alias("adj_factor")))
    theirs = vendor.factor_returns(adjusted, adjusted.select("symbol", "day", F.lit(1.0).alias("adj_factor")))
    return rounded(vendor.return_differences(ours, theirs), "mean_gap", "max_gap")


# Inventory: parts as products, line items as their days

AS_OF, ALIASES = "2000-06-30", {"BRAND#1ECONOMY": "BRAND#1SMALL"}
PATTERNS = {"excluded": ("cold", "red"), "review": ("small", "blue"), "allowed": ("cold widget",)}


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = star.table(spark, sf_dir, "lineitem"), star.table(spark, sf_dir, "part")
    days = lines.select(F.col("l_partkey").alias("code"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("day"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("volume"), F.try_divide("l_extendedprice", "l_quantity").alias("close"))
    liquid = kept(inventory.liquidity(days))  # a row for each product
    spans = liquid.select("code", F.col("first_day.l_shipdate").cast("date").alias("listed"), F.col("last_day.l_shipdate").cast("date").alias("last"))
    code = F.col("p_partkey").alias("code")
    products = parts.select(code, F.col("p_name").alias("name"), F.concat("p_brand", F.lit(" - "), "p_type", F.lit(" (Return)")).alias("benchmark")).join(spans, "code", "left")
    products = products.withColumn("delisted", F.when(F.col("code") % 5 == 0, F.col("last"))).drop("last")
    shares = parts.where("p_partkey % 3 <> 0").select(code, F.col("p_size").alias("latest_share"))
    return inventory.inventory(products, liquid, shares, AS_OF, aliases=ALIASES, **PATTERNS)


def _matches_sql(patterns: tuple[str, ...]) -> str:
    return f"list_filter([{', '.join(map(repr, patterns))}], lambda p: contains(upper(text), upper(p)))"


_INVENTORY = f"""WITH lines AS (SELECT *, l_extendedprice / l_quantity AS price, (l_shipdate, l_orderkey, l_linenumber) AS ord FROM lineitem),
liq AS (SELECT l_partkey AS code, count(*) AS observations, avg(l_extendedprice) AS avg_amount, median(l_extendedprice) AS median_amount, avg(l_quantity) AS avg_volume, arg_max(price, ord) AS latest_close,
  CAST(min(l_shipdate) AS DATE) AS listed, CAST(max(l_shipdate) AS DATE) AS last FROM lines GROUP BY 1),
texts AS (
  SELECT p_partkey AS code, p_name AS name, p_brand || ' - ' || p_type || ' (Return)' AS benchmark, p_name || '|' || p_brand || ' - ' || p_type || ' (Return)' AS text,
    upper(p_brand) || upper(p_type) AS plain, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS latest_share FROM part
),
found AS (
  SELECT t.*, {_matches_sql(PATTERNS['excluded'])} AS ex, {_matches_sql(PATTERNS['review'])} AS re, {_matches_sql(PATTERNS['allowed'])} AS al, liq.* EXCLUDE (code), CASE WHEN t.code % 5 = 0 THEN last END AS delisted
  FROM texts t LEFT JOIN liq ON liq.code = t.code
),
inv AS (
  SELECT *, CASE WHEN len(al) > 0 THEN 'candidate' WHEN len(ex) > 0 THEN 'exclude' WHEN len(re) > 0 THEN 'review' ELSE 'candidate' END AS scope,
    CASE WHEN len(al) > 0 THEN 'explicit_allow' WHEN len(ex) > 0 THEN array_to_string(ex, ';') ELSE array_to_string(re, ';') END AS reasons,
    CASE plain {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in ALIASES.items())} ELSE plain END AS "group",
    CASE WHEN delisted <= DATE '{AS_OF}' THEN 'ended' WHEN listed IS NULL OR listed > DATE '{AS_OF}' THEN 'not_yet_listed' ELSE 'active' END AS state
  FROM found
),
inventory AS (SELECT *, rank() OVER (PARTITION BY "group" ORDER BY avg_amount DESC NULLS LAST) AS rank_in_group FROM inv)"""
_AMOUNTS = ("avg_amount", "median_amount", "avg_volume", "latest_close")


@query(f'{_INVENTORY} SELECT code, name, benchmark, listed, delisted, scope, reasons, "group", state, observations, {sql.rounded(*_AMOUNTS)}, latest_share, rank_in_group FROM inventory')
def inventory_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_inventory(spark, sf_dir), *_AMOUNTS)


@query(f"""{_INVENTORY} SELECT "group", count(*) AS products, count_if(state = 'active') AS active, count_if(state = 'ended') AS ended, count_if(state = 'not_yet_listed') AS pending,
  string_agg(CAST(code AS VARCHAR), ';' ORDER BY code) AS codes, round(max(avg_amount), 8) + 0.0 AS max_avg_amount FROM inventory WHERE scope = 'candidate' GROUP BY "group" """)
def inventory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inventory.groups(_inventory(spark, sf_dir)), "max_avg_amount")


@query(f"""{_INVENTORY} SELECT code, "group", count(*) OVER (PARTITION BY "group") AS active_in_group, row_number() OVER (PARTITION BY "group" ORDER BY avg_amount DESC NULLS LAST, code) AS place
  FROM inventory WHERE scope = 'candidate' AND state = 'active' QUALIFY place <= 3""")
def inventory_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.selection(_inventory(spark, sf_dir), 3).select("code", "group", "active_in_group", "place")


# Reports over a benchmark, two scored formulas and their trades

_SCORED = {n: _VALUES[n] for n in ("clv_intraday", "reversal")}


def _batch_sql(source: str, names: dict[str, str], last: str = "factored") -> str:
    """CTEs `ranks` and `daily` of several signals, by formula."""
    each = " UNION ALL ".join(f"SELECT '{n}' AS formula, *, CAST({x} AS FLOAT) AS s FROM targets" for n, x in names.items())
    found = sql._daily("s").split("ranks AS", 1)[1]
    found = "ranks AS" + found.replace("PARTITION BY t", "PARTITION BY formula, t").replace("SELECT t, day,", "SELECT formula, t, day,").replace("GROUP BY t, day", "GROUP BY formula, t, day")
    return f"{source}, {sql.TARGETS.replace('FROM panel', f'FROM {last}', 1)}, sig AS ({each}), {found}"


_BATCH = "WITH " + _batch_sql(sql.with_factors(sql.BRAND, ("CLV", "INTRADAY", "PRICE_MA_20")), _SCORED)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.unpivoted(_signal(spark, sf_dir, *_SCORED), [*_SCORED])
    return scoring.ranked(rows, "signal", ("formula",))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.daily_scores(scoring.unpivoted(_signal(spark, sf_dir, *_SCORED), [*_SCORED]), "signal", keys=("formula",))


_EQUITY = f"""WITH {sql.BRAND}, {sql.PANEL},
moves AS (SELECT *, CASE WHEN tradable AND lag(tradable) {sql.W} AND lag(close) {sql.W} > 0 THEN close / lag(close) {sql.W} - 1 END AS r FROM panel),
ret AS (SELECT t, day, CASE WHEN t = {START} THEN 0.0::DOUBLE ELSE coalesce(avg(r), 0.0::DOUBLE) END AS daily_return FROM moves WHERE t >= {START} GROUP BY t, day),
eq AS (SELECT *, product(1 + daily_return) OVER (ORDER BY t) AS equity FROM ret)
SELECT t, day, {sql.rounded('daily_return', 'equity')}, round(equity / max(equity) OVER (ORDER BY t) - 1, 8) + 0.0 AS drawdown FROM eq"""


@query(_EQUITY)
def benchmark_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.benchmark_equity(star.brand_panel(spark, sf_dir), START), "daily_return", "equity", "drawdown")


_CURVES = f"""{_BATCH},
curve AS (SELECT *, product(1 + absolute_return) OVER (PARTITION BY formula ORDER BY t) AS equity, product(1 + baseline_return) OVER (PARTITION BY formula ORDER BY t) AS bench FROM daily)"""
_SUMMED = ("total_return", "annual_return", "sharpe", "max_drawdown", "benchmark_total_return", "benchmark_annual_return")


def _summary_sql(by: str, year: str) -> str:
    return f"""{_CURVES},
years AS (SELECT *{year} FROM curve),
steps AS (SELECT *, coalesce(equity / lag(equity) OVER (PARTITION BY {by} ORDER BY t) - 1, 0) AS r, equity / max(equity) OVER (PARTITION BY {by} ORDER BY t) - 1 AS dd FROM years),
s AS (SELECT {by}, count(*) AS days, count_if(round(r, 12) > 0) AS up_days, count_if(round(r, 12) < 0) AS down_days, arg_max(equity, t) / arg_min(equity, t) AS e, arg_max(bench, t) / arg_min(bench, t) AS b, avg(r) AS m, stddev_pop(r) AS sd, min(dd) AS dd FROM steps GROUP BY {by})
SELECT {by}, days, up_days, down_days, round(e - 1, 6) + 0.0 AS total_return, round(pow(e, 252.0::DOUBLE / days) - 1, 6) + 0.0 AS annual_return, round(CASE WHEN sd > 0 THEN m / sd * sqrt(252.0::DOUBLE) END, 6) + 0.0 AS sharpe,
  round(dd, 6) + 0.0 AS max_drawdown, round(b - 1, 6) + 0.0 AS benchmark_total_return, round(pow(b, 252.0::DOUBLE / days) - 1, 6) + 0.0 AS benchmark_annual_return FROM s"""


@query(_summary_sql("formula", ""))
def equity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.equity_summary(reports.strategy_equity(_daily(spark, sf_dir), ["formula"]), ["formula"]), *_SUMMED, digits=6)


@query(_summary_sql("formula, year", ", CAST(year(day) AS INTEGER) AS year"))
def annual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.equity_summary(reports.strategy_equity(_daily(spark, sf_dir), ["formula"]), ["formula"], yearly=True), *_SUMMED, digits=6)


_TRADES = f"""{_BATCH},
closed AS (SELECT formula, t, symbol, fwd_ret AS pnl, coalesce(sell_t - buy_t, 0) AS held, CASE WHEN sell_t IS NULL THEN 'not_bought' WHEN fwd_ret < 0 THEN 'loss' ELSE 'gain' END AS reason FROM ranks WHERE rk <= top_k)"""


@query(f"""{_TRADES} SELECT formula, count(*) AS trades, round(avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) + 0.0 AS win_rate, round(avg(pnl), 8) + 0.0 AS mean_pnl, round(median(pnl), 8) + 0.0 AS median_pnl,
  round(quantile_cont(pnl, 0.05), 8) + 0.0 AS p05_pnl, round(quantile_cont(pnl, 0.95), 8) + 0.0 AS p95_pnl, round(avg(held), 8) + 0.0 AS mean_holding_days, CAST(median(held) AS DOUBLE) AS median_holding_days,
  round(sum(pnl), 6) + 0.0 AS total_pnl FROM closed GROUP BY formula""")
def trade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.trade_distribution(reports.trades(_ranked(spark, sf_dir), ["formula"]), ["formula"])
    return rounded(rounded(found, "win_rate", "mean_pnl", "median_pnl", "p05_pnl", "p95_pnl", "mean_holding_days"), "total_pnl", digits=6)


@query(f"""{_TRADES},
spots AS (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY pnl, t, symbol) AS low, count(*) OVER (PARTITION BY formula) AS n, greatest(1, ceil(count(*) OVER (PARTITION BY formula) * 0.1::DOUBLE)) AS size FROM closed),
tails AS (SELECT *, 'left' AS tail FROM spots WHERE low <= size UNION ALL SELECT *, 'right' FROM spots WHERE low > n - size)
SELECT formula, tail, symbol, reason, count(*) AS trades, round(avg(pnl), 8) + 0.0 AS mean_pnl, round(sum(pnl), 8) + 0.0 AS total_pnl, round(avg(held), 8) + 0.0 AS mean_holding_days FROM tails GROUP BY ALL""")
def tail_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.tail_attribution(reports.trades(_ranked(spark, sf_dir), ["formula"]), ["formula"]), "mean_pnl", "total_pnl", "mean_holding_days")


_DRAWDOWNS = sql.drawdowns(("CLV", "INTRADAY"), _VALUES["clv_intraday"])
_OFFSETS = "offs AS (" + _DRAWDOWNS.rsplit("\nSELECT", 1)[1].join(["SELECT", ")"])


@query(_DRAWDOWNS.rsplit("\nSELECT", 1)[0] + f""", {_OFFSETS} SELECT count(*) AS offsets, round(median(total_return), 7) + 0.0 AS median_total_return, round(min(total_return), 7) + 0.0 AS worst_total_return,
  round(median(max_drawdown), 7) + 0.0 AS median_drawdown, round(min(max_drawdown), 7) + 0.0 AS worst_drawdown FROM offs""")
def drawdown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = rounded(scoring.drawdown_offsets(scoring.daily_scores(_signal(spark, sf_dir, "clv_intraday"), "clv_intraday"), HORIZON), "total_return", "max_drawdown")
    return rounded(reports.drawdown_summary(offsets), "median_total_return", "worst_total_return", "median_drawdown", "worst_drawdown", digits=7)


@query(f"WITH {sql.NATION}, {sql.PANEL}, n AS (SELECT t, day FROM panel GROUP BY t, day HAVING count_if(tradable) >= 15) SELECT t, day FROM n ORDER BY t LIMIT 1")
def first_usable_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_usable_day(star.nation_panel(spark, sf_dir), 15)


@query(f"{_BATCH} SELECT formula, t, asset_idx, eligible_count - rk + 1 AS score FROM ranks WHERE rk IS NOT NULL")
def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rank_scores(_ranked(spark, sf_dir), ["formula"])


# Formulas in SQL


def formula_ctes(trees: dict[str, tuple]) -> str:
    """CTEs from `factored` to `valued`, which has a column for each tree: nested windows one level after another."""
    names: dict[tuple, str] = {}

    def value(t: tuple) -> str:
        if t in names:
            return f'"{names[t]}"'
        head, *rest = t
        if head == "CONST":
            return f"(CASE WHEN tradable THEN {rest[0]}::DOUBLE END)"
        if head in language.BINARY:
            return f"(CASE WHEN tradable THEN {value(rest[0])} {dict(ADD='+', SUB='-', MUL='*')[head]} {value(rest[1])} END)"
        if head in language.UNARY:
            return f"({dict(NEG='-', ABS='abs', SIGN='sign')[head]}({value(rest[0])}))::DOUBLE"
        return '"' + "_".join(map(str, t)) + '"'

    def height(t: tuple) -> int:
        return max((height(r) for r in t[1:] if isinstance(r, tuple)), default=0) + (t[0] in language.ROLLING)

    levels: dict[int, list[tuple]] = {}

    def visit(t: tuple) -> None:
        for r in t[1:]:
            if isinstance(r, tuple):
                visit(r)
        if t[0] in language.ROLLING and t not in levels.setdefault(height(t), []):
            levels[height(t)].append(t)

    for t in trees.values():
        visit(t)
    out, last = [], "factored"
    for level in sorted(levels):
        inner = {t: f"in{level}_{i}" for i, t in enumerate(levels[level])}
        out.append(f"l{level}a AS (SELECT *, {', '.join(f'{value(t[1])} AS {n}' for t, n in inner.items())} FROM {last})")
        rolled = [f"CASE WHEN tradable THEN {f'lag({n}, {t[2]}) {sql.W}' if t[0] == 'REF' else sql.mean(n, t[2])} END AS ro{level}_{i}" for i, (t, n) in enumerate(inner.items())]
        out.append(f"l{level}b AS (SELECT *, {', '.join(rolled)} FROM l{level}a)")
        names |= {t: f"ro{level}_{i}" for i, t in enumerate(levels[level])}
        last = f"l{level}b"
    out.append(f"valued AS (SELECT *, {', '.join(f'{value(t)} AS {n}' for n, t in trees.items())} FROM {last})")
    return ", ".join(out)


# Likeness of signals: formulas with ties, signs and missing values

_PAIRED = ("clv_intraday", "reversal", "smooth_clv", "trend_sign")
_PAIRED_TREES = {n: tree(n) for n in _PAIRED}
_PAIRED_USED = tuple(n for n in language.factors.NAMES if any(n in language.factor_names(t) for t in _PAIRED_TREES.values()))
_PAIRS = [(a, b) for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]]
_TARGETS_OF = f"WITH {sql.with_factors(sql.BRAND, _PAIRED_USED)}, {formula_ctes(_PAIRED_TREES)}, {sql.TARGETS.replace('FROM panel', 'FROM valued', 1)}"


@query(f"""{_TARGETS_OF},
p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, t, CAST({a} AS FLOAT) AS x, CAST({b} AS FLOAT) AS y FROM targets WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)}),
ranks AS (
  SELECT a, b, t, rank() OVER (PARTITION BY a, b, t ORDER BY x) + (count(*) OVER (PARTITION BY a, b, t, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b, t ORDER BY y) + (count(*) OVER (PARTITION BY a, b, t, y) - 1) / 2.0::DOUBLE AS ry FROM p
),
d AS (SELECT a, b, t, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 12) END AS r FROM ranks GROUP BY a, b, t HAVING count(*) >= 10),
z AS (SELECT a, b, atanh(least(greatest(r, 1e-7 - 1), 1 - 1e-7)) AS z, greatest(n - 3, 1) AS w FROM d WHERE r IS NOT NULL)
SELECT a, b, count(*) AS days, count(*) >= 252 AS sufficient, round(CASE WHEN count(*) >= 252 THEN tanh(sum(z * w) / sum(w)) END, 8) + 0.0 AS rho FROM z GROUP BY a, b""")
def signal_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.similarity(_signal(spark, sf_dir, *_PAIRED), [*_PAIRED]), "rho")


@query(f"""{_TARGETS_OF}, c AS ({' UNION ALL '.join(f"SELECT '{n}' AS formula, t, count({n}) AS k FROM targets GROUP BY t" for n in _PAIRED)})
SELECT formula, count_if(k >= 10) AS days, count_if(k >= 10) >= 252 AS sufficient FROM c GROUP BY formula""")
def similarity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.covered(_signal(spark, sf_dir, *_PAIRED), [*_PAIRED])


# Reconciliation, order and digests


@query(f"""{_VENDOR},
b AS (SELECT coalesce(r.symbol, a.symbol) AS symbol, r.symbol IS NULL OR a.symbol IS NULL AS lone, {', '.join(f'abs(r.{p} - a.{p}) AS {p}' for p in _P)} FROM raw r FULL JOIN adjusted a ON a.symbol = r.symbol AND a.day = r.day),
m AS (SELECT count_if(lone) AS unmatched, {', '.join(f'max({p}) AS {p}' for p in _P)} FROM b)
{' UNION ALL '.join(f"SELECT '{p}' AS name, round({p}, 8) + 0.0 AS max_gap, unmatched FROM m" for p in _P)}""")
def vendor_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.largest_gaps(*_raw(spark, sf_dir), ["symbol", "day"], [*_P]), "max_gap")


@query(f'{_INVENTORY} SELECT code, "group", rank_in_group, row_number() OVER (ORDER BY scope, "group", rank_in_group, code DESC) - 1 AS place FROM inventory')
def inventory_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.numbered(_inventory(spark, sf_dir), [F.col("scope"), F.col("group"), F.col("rank_in_group"), F.col("code").desc()], "place")
    return found.select("code", "group", "rank_in_group", "place")


@query("""SELECT s_suppkey, sha256('{"s_acctbal":' || CAST(CAST(s_acctbal * 100 AS BIGINT) AS VARCHAR) || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS digest FROM supplier""")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.round(F.col("s_acctbal") * 100).cast("long"))
    return rows.select("s_suppkey", manifest.json_digest(["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]).alias("digest"))
