"""Corporate events on small series with known results."""

from datetime import date

import pytest

from barloom.operators import adjustment

BARS = "symbol string, day date, open double, high double, low double, close double, volume double, amount double"
EVENTS = "symbol string, date date, category_code int, c1 double, c2 double, c3 double, c4 double"
DAYS = [date(2024, 1, d) for d in (2, 3, 8)]


def bars(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, d, c, c + 0.1, c - 0.1, c, 1000.0, c * 1000) for d, c in zip(DAYS, closes)], BARS)


def events(spark, *rows):
    return spark.createDataFrame([*rows], EVENTS)


def adjusted(spark, closes, *rows):
    source = bars(spark, closes)
    audit = adjustment.event_audit(source, events(spark, *rows))
    return adjustment.adjusted_bars(source, audit).orderBy("day").collect(), audit.collect()


@pytest.mark.parametrize(
    "closes, event, want",
    [
        ([100.0, 102.0, 51.0], (11, None, None, 2.0, None), [50.0, 51.0, 51.0]),
        ([50.0, 51.0, 102.0], (12, None, None, 0.5, None), [100.0, 102.0, 102.0]),
        ([9.0, 10.0, 9.0], (1, 10.0, 0.0, 0.0, 0.0), [8.1, 9.0, 9.0]),
        ([20.0, 20.0, 10.0], (1, 0.0, 0.0, 10.0, 0.0), [10.0, 10.0, 10.0]),
    ],
)
def test_prices_before_an_event(spark, closes, event, want):
    rows, audit = adjusted(spark, closes, ("A", date(2024, 1, 6), *event))
    assert [r["adj_close"] for r in rows] == pytest.approx(want)
    assert [r["applied_event_count"] for r in rows] == [0, 0, 1]
    assert (audit[0]["previous_day"], audit[0]["effective_day"]) == (DAYS[1], DAYS[2])


def test_event_on_a_trading_day_takes_the_bar_before(spark):
    rows, _ = adjusted(spark, [100.0, 50.0, 51.0], ("A", DAYS[1], 11, None, None, 2.0, None))
    assert [r["adj_close"] for r in rows] == [50.0, 50.0, 51.0]


def test_skips(spark):
    early, late, odd, unknown = date(2024, 1, 1), date(2024, 2, 1), date(2024, 1, 6), date(2024, 1, 6)
    _, audit = adjusted(
        spark, [1.0, 2.0, 3.0],
        ("A", early, 11, None, None, 2.0, None), ("A", late, 11, None, None, 2.0, None), ("A", odd, 5, None, None, None, None), ("B", unknown, 1, 1.0, 0.0, 0.0, 0.0),
    )
    found = {(r["symbol"], r["date"]): r["skip_reason"] for r in audit}
    assert found == {("A", early): "no_previous_daily_row", ("A", late): "future_event", ("A", odd): "unsupported_category", ("B", unknown): "symbol_missing_from_daily"}
    assert not any(r["applied"] or r["price_step"] for r in audit)


@pytest.mark.parametrize("rows", [[(11, 0.0)], [(11, None)], [(11, 2.0), (12, 0.5)]])
def test_wrong_events_raise(spark, rows):
    with pytest.raises(Exception, match="event"):
        adjusted(spark, [1.0, 2.0, 3.0], *[("A", DAYS[2], k, None, None, c3, None) for k, c3 in rows])


def test_gate_names_what_fails(spark):
    source = bars(spark, [1.0, 1.0, 2.0])
    audit = adjustment.event_audit(source, events(spark))
    whole = adjustment.adjusted_bars(source, audit)
    found = adjustment.gate_failures(adjustment.quality(whole, audit, lot=1.0), audit)
    assert [tuple(r) for r in found.collect()] == [("adjusted_jumps", 1)]
    empty = adjustment.adjusted_bars(source.limit(0), audit)
    assert adjustment.gate_failures(adjustment.quality(empty, audit), audit).collect() == []


def test_second_vendor_needs_both_values(spark):
    flow = spark.createDataFrame([("A", DAYS[0], 13.0, 1.4703), ("A", DAYS[1], None, 2.0), ("A", DAYS[2], 0.0, 0.0)], "symbol string, day date, vol double, amount double")
    found = adjustment.reconcile_flow(bars(spark, [1.0, 2.0, 3.0]), flow).orderBy("day").collect()
    assert [(r["volume"], round(r["amount"], 6), r["tradable"]) for r in found] == [(13.0, 1470.3, True), (1000.0, 2000.0, True), (0.0, 0.0, False)]
    assert found[2]["implied_price"] is None
    with pytest.raises(Exception, match="several rows"):
        adjustment.reconcile_flow(bars(spark, [1.0]), flow.union(flow)).collect()
