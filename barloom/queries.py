"""The registered queries of the factor engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import event_sql, sql
from .functions import factors
from .operators import adjustment, scoring
from .plans import language
from .sources import star
from .sources.storage import kept

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}

START, HORIZON = 60, 10


def query(text: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        FOUND[key] = f
        if text is not None:
            SQL[key] = text
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; queries show them rounded, and no negative zero."""
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


# Bars and panels


@query(sql.bars(sql.BRAND))
def bars_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(star.bars_brand_week(spark, sf_dir), "open", "high", "low", "close"), "volume", "amount", digits=4)


@query(sql.bars(sql.NATION))
def bars_nation_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(star.bars_nation_day(spark, sf_dir), "open", "high", "low", "close"), "volume", "amount", digits=4)


def _panel(panel: DataFrame) -> DataFrame:
    shown = panel.select("asset_idx", "symbol", "t", "day", "tradable", "open", "close", "volume")
    return rounded(rounded(shown, "open", "close"), "volume", digits=4)


@query(sql.panel(sql.BRAND))
def panel_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(star.brand_panel(spark, sf_dir))


@query(sql.panel(sql.NATION))
def panel_nation_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(star.nation_panel(spark, sf_dir))


# Factors, one query for each family; the sparse nation panel shows what gaps do


def _family(names: tuple[str, ...], panel: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(factors.with_factors(panel(spark, sf_dir), names).select("asset_idx", "t", *names), *names)

    return run


for _name, _names in {
    "factors_single": factors.FIXED,
    **{f"factors_{f.lower()}": tuple(f"{f}_{w}" for w in factors.WINDOWS) for f in factors.FAMILIES},
    "factors_ma_ratio": tuple(n for n in factors.NAMES if n.startswith("MA_RATIO")),
}.items():
    query(sql.factor_query(sql.BRAND, _names), _name)(_family(_names, star.brand_panel))
_names = ("DAYRET", "CLV", "ROC_5", "PRICE_MA_5", "VOL_5", "TS_RANK_5", "RSV_5", "MA_RATIO_5_10")
query(sql.factor_query(sql.NATION, _names), "factors_with_gaps")(_family(_names, star.nation_panel))


@query(sql.OLDER_OPERATORS)
def older_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, names = star.brand_panel(spark, sf_dir), [*factors.OPERATORS]
    return rounded(panel.select("asset_idx", "t", *[f(F.col("close")).alias(n) for n, f in factors.OPERATORS.items()]), *names)


@query(sql.FIXED_FORMULAS)
def fixed_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = star.brand_panel(spark, sf_dir)
    out = panel.select("asset_idx", "t", *[factors.fixed_formula(n).alias(n) for n in factors.FIXED_FORMULAS])
    return rounded(rounded(out, "mom_10", "ma_gap_5_20", "reversal_5"), "volume_confirmed_mom_10", digits=6)


# Formulas. Each has the SQL of its value for windows nested at most once.

FORMULAS = {
    "clv_intraday": "CLV INTRADAY ADD",
    "reversal": "PRICE_MA WIN_20 NEG",
    "smooth_clv": "CLV WIN_10 MEAN",
    "delayed_sum": "DAYRET ROC WIN_20 ADD WIN_5 REF",
    "trend_sign": "MA_RATIO WIN_5 WIN_20 SIGN RSV WIN_10 MUL",
    "turn": "TS_RANK WIN_10 CONST_1 SUB ABS VOL WIN_20 SUB",
}


def tree(name: str) -> tuple:
    return language.parse(FORMULAS[name].split())


def _masked(x: str) -> str:
    return f"CASE WHEN tradable THEN {x} END"


_VALUES = {
    "clv_intraday": '"CLV" + "INTRADAY"',
    "reversal": '-"PRICE_MA_20"',
    "smooth_clv": _masked(sql.mean('"CLV"', 10)),
    "delayed_sum": _masked(f'lag("DAYRET" + "ROC_20", 5) {sql.W}'),
    "trend_sign": 'sign("MA_RATIO_5_20") * "RSV_10"',
    "turn": 'abs("TS_RANK_10" - 1.0) - "VOL_20"',
}
_USED = tuple(n for n in factors.NAMES if any(n in language.factor_names(tree(f)) for f in FORMULAS))


@query(f"WITH {sql.with_factors(sql.BRAND, _USED)} SELECT asset_idx, t, {', '.join(f'round({x}, 8) + 0.0 AS {n}' for n, x in _VALUES.items())} FROM factored")
def formula_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.plan(star.brand_panel(spark, sf_dir), {n: tree(n) for n in FORMULAS})
    return rounded(out.select("asset_idx", "t", *FORMULAS), *FORMULAS)


def _signal(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Decision days with a column for each formula. Windows see the rows before the split."""
    planned = language.plan(star.brand_panel(spark, sf_dir), {n: tree(n) for n in names})
    return scoring.forward_targets(planned, START, None, HORIZON)


@query(sql.FORWARD_TARGETS)
def forward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("asset_idx", "t", "buy_t", "sell_t", "fwd_ret", "available_count", "top_k", "baseline_ret")
    return rounded(_signal(spark, sf_dir).select(*names), "fwd_ret", "baseline_ret")


def daily(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scoring.daily_scores(_signal(spark, sf_dir, name), name)


def _score(name: str, used: tuple[str, ...]) -> None:
    value = _VALUES[name]

    @query(sql.score_daily(used, value), f"score_daily_{name}")
    def of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(daily(spark, sf_dir, name), "absolute_return", "baseline_return", "rank_ic", "excess_return")

    @query(sql.score_summary(used, value), f"score_summary_{name}")
    def of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scoring.summary(daily(spark, sf_dir, name))
        names = [c for c in out.columns if c not in ("valid", "scorer_days", "rank_ic_ir")]
        return rounded(rounded(out, *names), "rank_ic_ir", digits=6)


_score("clv_intraday", ("CLV", "INTRADAY"))
_score("reversal", ("PRICE_MA_20",))


@query(sql.drawdowns(("CLV", "INTRADAY"), _VALUES["clv_intraday"]))
def drawdown_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.drawdown_offsets(daily(spark, sf_dir, "clv_intraday"), HORIZON), "total_return", "max_drawdown")


def _older(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = star.brand_panel(spark, sf_dir).withColumn("mom_10", factors.fixed_formula("mom_10"))
    return scoring.older_daily_scores(panel, "mom_10", HORIZON)


@query(sql.OLDER_DAILY)
def older_score_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_older(spark, sf_dir), "mean_forward_return", "median_forward_return", "hit_rate")


@query(sql.OLDER_SUMMARY)
def older_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.older_summary(_older(spark, sf_dir), HORIZON)
    return rounded(rounded(out, "mean_return", "median_return", "hit_rate", "avg_top_k"), "annual_proxy", digits=6)


_QUALITY = {n: _VALUES[n] for n in ("clv_intraday", "reversal", "trend_sign", "turn")}


@query(sql.signal_quality(_QUALITY, _USED))
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.signal_quality(_signal(spark, sf_dir, *_QUALITY), [*_QUALITY]), "coverage", "spread")


# Corporate events. The tables have none, so every 97th week of a brand gets one, of the category that its index deals.


def _weeks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bars, events) of the brand weeks."""
    c = F.col("asset_idx") % 4
    bars = kept(star.bars_brand_week(spark, sf_dir))
    found = star.panel(bars, are_kept=True).where("(t + 7 * asset_idx) % 97 = 0")
    events = found.select(
        "symbol",
        F.date_add("day", (F.col("asset_idx") % 3).cast("int")).alias("date"),
        F.when(c == 0, 1).when(c == 1, 11).when(c == 2, 12).otherwise(5).alias("category_code"),
        F.lit(10.0).alias("c1"),
        F.lit(5.0).alias("c2"),
        F.when(c == 0, 1.0).when(c == 1, 2.0).when(c == 2, 0.5).otherwise(0.0).alias("c3"),
        F.lit(1.0).alias("c4"),
    )
    return bars, events


def _adjusted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars, events = _weeks(spark, sf_dir)
    audit = kept(adjustment.event_audit(bars, events))
    return adjustment.adjusted_bars(bars, audit), audit


@query(event_sql.EVENT_AUDIT)
def event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = adjustment.event_audit(*_weeks(spark, sf_dir))
    return rounded(audit, *[n for n, kind in audit.dtypes if kind == "double"], digits=6)


@query(event_sql.ADJUSTED_BARS)
def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("price_factor", "share_factor", *adjustment.ADJUSTED, "adj_volume", "raw_return", "adj_return")
    return rounded(_adjusted(spark, sf_dir)[0].select("symbol", "day", *names, "applied_event_count"), *names, digits=6)


@query(event_sql.ADJUSTMENT_ANOMALIES)
def adjustment_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjustment.anomalies(_adjusted(spark, sf_dir)[0])
    return rounded(found.select("symbol", "day", "raw_return", "adj_return"), "raw_return", "adj_return", digits=6)


@query(event_sql.ADJUSTMENT_QUALITY)
def adjustment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(adjustment.quality(*_adjusted(spark, sf_dir), lot=1.0), "max_raw_return", "max_adjusted_return", digits=6)


@query(event_sql.GATE_FAILURES)
def adjustment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted, audit = _adjusted(spark, sf_dir)
    return adjustment.gate_failures(adjustment.quality(adjusted, audit, lot=1.0), audit)


@query(event_sql.RELATIVE_BARS)
def relative_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjustment.relative_bars(_adjusted(spark, sf_dir)[0])
    return rounded(found.select("symbol", "day", *adjustment.RELATIVE), *adjustment.RELATIVE, digits=6)


@query(event_sql.RELATIVE_QUALITY)
def relative_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjustment.relative_quality(adjustment.relative_bars(_adjusted(spark, sf_dir)[0]))


@query(event_sql.RECONCILED_FLOW)
def reconciled_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = kept(star.bars_brand_week(spark, sf_dir))
    panel = star.panel(bars, are_kept=True).where("tradable and t % 5 <> 0")
    flow = panel.select("symbol", "day", (F.col("volume") + 1).alias("vol"), F.when(F.col("t") % 7 != 0, F.round("amount", 4) / 2000).alias("amount"))
    found = adjustment.reconcile_flow(rounded(bars, "amount", digits=4), flow)
    out = found.select("symbol", "day", "volume", "amount", "flow_source", "tradable", "implied_price")
    return rounded(out, "volume", "amount", digits=4)  # a price that is rounded to a tie would differ between engines


from . import attempt_queries, market_queries  # noqa: E402,F401 - they register their queries, which use those above


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
