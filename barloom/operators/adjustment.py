"""Corporate events, adjusted bars and their quality gates.

Bars are rows (symbol, day, open, high, low, close, volume, amount), one for each symbol and day that has data; events are
rows (symbol, date, category_code, c1, c2, c3, c4). Bars and events of a symbol meet on one time line, so as-of lookups and
running products are windows over it: no range join, and as many rows as both tables have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.star import FIELDS, PRICES, tradable

#: Cash dividend, bonus and rights; share split; share merge.
CASH, SPLITS = 1, (11, 12)
SUPPORTED = (CASH, *SPLITS)
#: Skips that a gate lets pass.
EXPECTED_SKIPS = ("no_previous_daily_row", "future_event")
ADJUSTED = tuple(f"adj_{p}" for p in PRICES)
RELATIVE = tuple(f"{p}_rel" for p in PRICES)


def reconcile_flow(bars: DataFrame, flow: DataFrame, lot: float = 100.0) -> DataFrame:
    """Bars with volume and amount of the second vendor (symbol, day, vol, amount in thousands) where it has both.

    Adds flow_source, tradable and implied_price = amount / (volume * lot) of tradable rows. `flow` has one row for each
    symbol and day; repeated ones raise an error, as they would multiply bars.
    """
    once = flow.groupBy("symbol", "day").agg(F.count("*").alias("__n"), F.first("vol").alias("__vol"), F.first("amount").alias("__amount"))
    alone = F.when(F.col("__n") > 1, F.raise_error(F.lit("flow has several rows for a symbol and day")).cast("boolean")).otherwise(F.lit(True))
    rows = bars.select("symbol", "day", *FIELDS).join(once.where(alone), ["symbol", "day"], "left")
    both = F.col("__vol").isNotNull() & F.col("__amount").isNotNull()
    rows = rows.withColumns(
        {
            "volume": F.when(both, F.col("__vol")).otherwise(F.col("volume")).cast("double"),
            "amount": F.when(both, F.col("__amount") * 1000.0).otherwise(F.col("amount")).cast("double"),
            "flow_source": F.when(both, "second_vendor").otherwise("first_vendor"),
        }
    ).drop("__n", "__vol", "__amount")
    rows = rows.withColumn("tradable", tradable())
    return rows.withColumn("implied_price", F.when(F.col("tradable"), F.try_divide("amount", F.col("volume") * lot)))


def _newest_first():
    """The time line backwards; on one day bars come before events, so an event sees bars from its own day on."""
    return Window.partitionBy("symbol").orderBy(F.col("date").desc(), "is_event").rowsBetween(Window.unboundedPreceding, 0)


def _oldest_first():
    """The time line; on one day events come before bars, so an event sees bars before its day."""
    return Window.partitionBy("symbol").orderBy("date", F.col("is_event").desc()).rowsBetween(Window.unboundedPreceding, 0)


def _steps(previous: Column) -> tuple[Column, Column]:
    """(share step, theoretical price after the event)."""
    cash = F.col("category_code") == CASH
    share = F.when(cash, (F.col("c3") + F.col("c4") + 10.0) / 10.0).otherwise(F.col("c3"))
    paid = F.when(cash, (F.col("c1") - F.col("c4") * F.col("c2")) / 10.0).otherwise(0.0)
    return share, F.try_divide(previous - paid, share)


def event_audit(bars: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each event: whether and why it applies, the bars around it, and its price and share steps.

    The previous bar is the last before the event's date, the effective one the first from it on. Events of other
    categories, of unknown symbols, and without one of the two bars are kept with a skip reason and NULL steps. Two
    supported events of a symbol on one date, and steps that are not positive, raise an error.
    """
    known = bars.select("symbol", F.col("day").alias("date"), F.struct("day", "close", "volume").alias("bar"), F.lit(False).alias("is_event"))
    asked = events.select("symbol", "date", "category_code", *(F.col(c).cast("double") for c in ("c1", "c2", "c3", "c4")), F.lit(True).alias("is_event"))
    line = known.unionByName(asked, allowMissingColumns=True).withColumns(
        {
            "p": F.last("bar", ignorenulls=True).over(_oldest_first()),
            "e": F.last("bar", ignorenulls=True).over(_newest_first()),
            "same": F.count(F.when(F.col("category_code").isin(*SUPPORTED), 1)).over(Window.partitionBy("symbol", "date")),
        }
    )
    supported = F.coalesce(F.col("category_code").isin(*SUPPORTED), F.lit(False))
    reason = (
        F.when(~supported, "unsupported_category")
        .when(F.col("p").isNull() & F.col("e").isNull(), "symbol_missing_from_daily")
        .when(F.col("p").isNull(), "no_previous_daily_row")
        .when(F.col("e").isNull(), "future_event")
        .otherwise("")
    )
    line = line.where("is_event").withColumn("skip_reason", reason).withColumn("applied", F.col("skip_reason") == "")
    share, after = _steps(F.col("p.close"))
    line = line.withColumns({"__share": F.when(F.col("applied"), share), "__after": F.when(F.col("applied"), after)})
    sound = F.coalesce((F.col("__share") > 0) & (F.col("__share") < float("inf")) & (F.col("__after") > 0) & (F.col("__after") < float("inf")), F.lit(False))

    def applied(x: Column) -> Column:
        return F.when(F.col("applied"), x)

    wrong = F.raise_error(F.concat(F.lit("event steps must be positive: "), F.col("symbol"))).cast("double")
    twice = F.raise_error(F.concat(F.lit("several events of a symbol on one date: "), F.col("symbol"))).cast("double")
    moved = F.col("p.volume") * F.col("__share")
    return line.select(
        "symbol",
        "date",
        "category_code",
        F.when(~F.col("applied"), "non_adjustment_event").when(F.col("category_code") == CASH, "cash_bonus_rights").otherwise("share_split_merge").alias("event_kind"),
        "applied",
        "skip_reason",
        applied(F.col("p.day")).alias("previous_day"),
        applied(F.col("e.day")).alias("effective_day"),
        applied(F.col("p.close")).alias("previous_close"),
        applied(F.col("e.close")).alias("effective_close"),
        F.when(supported & (F.col("same") > 1), twice).when(F.col("applied") & ~sound, wrong).otherwise(F.col("__share")).alias("share_step"),
        F.try_divide("__after", "p.close").alias("price_step"),
        F.col("__after").alias("ex_close"),
        applied(F.try_divide("e.close", "p.close") - 1).alias("raw_event_return"),
        applied(F.try_divide("e.close", "__after") - 1).alias("adjusted_event_return"),
        applied(F.when(F.col("p.volume") > 0, F.try_divide("e.volume", "p.volume"))).alias("raw_volume_ratio"),
        applied(F.when(moved > 0, F.try_divide(F.col("e.volume"), moved))).alias("adjusted_volume_ratio"),
    )


def adjusted_bars(bars: DataFrame, audit: DataFrame) -> DataFrame:
    """Bars with prices times the steps of all later events, anchored at the newest bar, and volumes times share steps.

    Adds price_factor, share_factor, adj_* prices, adj_volume, raw_return, adj_return (against the previous bar that there
    is) and applied_event_count. The factors are running products along the reversed time line.
    """
    rows = bars.select("symbol", F.col("day").alias("date"), *FIELDS, F.lit(False).alias("is_event"))
    steps = audit.where("applied").select("symbol", "date", "price_step", "share_step", F.lit(True).alias("is_event"))
    line = rows.unionByName(steps, allowMissingColumns=True).withColumns(
        {f"{x}_factor": F.coalesce(F.product(f"{x}_step").over(_newest_first()), F.lit(1.0)) for x in ("price", "share")}
    )
    out = line.where("not is_event").drop("is_event", "price_step", "share_step").withColumnRenamed("date", "day")
    out = out.withColumns({f"adj_{p}": F.col(p) * F.col("price_factor") for p in PRICES} | {"adj_volume": F.col("volume") * F.col("share_factor")})
    before = Window.partitionBy("symbol").orderBy("day")
    out = out.withColumns({"raw_return": F.try_divide("close", F.lag("close").over(before)) - 1, "adj_return": F.try_divide("adj_close", F.lag("adj_close").over(before)) - 1})
    counts = audit.where("applied").groupBy("symbol", F.col("effective_day").alias("day")).agg(F.count("*").alias("applied_event_count"))
    return out.join(counts, ["symbol", "day"], "left").withColumn("applied_event_count", F.coalesce("applied_event_count", F.lit(0)))


def _bad(x: Column) -> Column:
    """Missing, NaN or infinite."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


def quality(adjusted: DataFrame, audit: DataFrame, threshold: float = 0.2, lot: float = 100.0) -> DataFrame:
    """Counts of suspicious rows for each symbol. lot: shares in a unit of volume, for the price that flows imply."""
    o, h, l, c = (F.col(a) for a in ADJUSTED)
    traded = tradable()
    implied = F.try_divide("amount", F.col("volume") * lot)
    found = adjusted.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_if(F.abs("raw_return") > threshold).alias("raw_jumps"),
        F.count_if(F.abs("adj_return") > threshold).alias("adjusted_jumps"),
        F.max(F.abs("raw_return")).alias("max_raw_return"),
        F.max(F.abs("adj_return")).alias("max_adjusted_return"),
        F.count_if(_any([_bad(x) | (x <= 0) for x in (o, h, l, c)])).alias("invalid_price_rows"),
        F.count_if(h < F.greatest(o, c)).alias("invalid_high_rows"),
        F.count_if(l > F.least(o, c)).alias("invalid_low_rows"),
        F.count_if(_bad(F.col("adj_volume")) | (F.col("adj_volume") < 0)).alias("invalid_volume_rows"),
        F.count_if(_bad(F.col("amount")) | (F.col("amount") < 0)).alias("invalid_amount_rows"),
        F.count_if(traded & ((implied < F.col("low") * 0.98) | (implied > F.col("high") * 1.02))).alias("invalid_implied_price_rows"),
        F.count_if((F.col("volume") == 0) != (F.col("amount") == 0)).alias("flow_zero_mismatch_rows"),
        F.count_if(~traded).alias("nontradable_rows"),
    )
    events = audit.where("applied").groupBy("symbol").agg(F.count("*").alias("applied_events"), F.count_if(F.col("category_code").isin(*SPLITS)).alias("share_events"))
    out = found.join(events, "symbol", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("applied_events", "share_events")})


#: Counts of which any but zero closes the gate.
GATED = (
    "adjusted_jumps", "invalid_price_rows", "invalid_high_rows", "invalid_low_rows", "invalid_volume_rows",
    "invalid_amount_rows", "invalid_implied_price_rows", "flow_zero_mismatch_rows",
)


def gate_failures(found: DataFrame, audit: DataFrame) -> DataFrame:
    """(check, failures) of the checks that fail; no row means that the data may pass."""
    sums = found.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in GATED]).unpivot([], [*GATED], "check", "failures")
    skipped = audit.agg(F.count_if(F.col("category_code").isin(*SUPPORTED) & ~F.col("applied") & ~F.col("skip_reason").isin(*EXPECTED_SKIPS)).alias("failures"))
    return sums.unionByName(skipped.select(F.lit("unexpected_event_skips").alias("check"), "failures")).where("failures <> 0")


def anomalies(adjusted: DataFrame, threshold: float = 0.2) -> DataFrame:
    """The bars whose raw or adjusted return exceeds the threshold either way."""
    return adjusted.where((F.abs("raw_return") > threshold) | (F.abs("adj_return") > threshold))


def relative_bars(adjusted: DataFrame) -> DataFrame:
    """Adjusted prices over the previous bar's adjusted close, less one; NULL on a first bar or after a close of 0."""
    out = adjusted.withColumn("__before", F.lag("adj_close").over(Window.partitionBy("symbol").orderBy("day")))
    ratio = {r: F.when(F.col("__before") > 0, F.try_divide(a, "__before")) - 1 for r, a in zip(RELATIVE, ADJUSTED)}
    return out.withColumns(ratio).drop("__before")


def relative_quality(relative: DataFrame) -> DataFrame:
    """One row: how many whole relative bars have a high or low inside the body, or a price at or below zero."""
    o, h, l, c = (F.col(r) for r in RELATIVE)
    whole = ~_any([_bad(x) for x in (o, h, l, c)])
    return relative.agg(
        F.count_if(whole & (h < F.greatest(o, c))).alias("invalid_high_rows"),
        F.count_if(whole & (l > F.least(o, c))).alias("invalid_low_rows"),
        F.count_if(whole & _any([x <= -1.0 for x in (o, h, l, c)])).alias("impossible_price_rows"),
    )
