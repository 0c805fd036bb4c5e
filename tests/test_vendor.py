"""Vendor rows, inventory and reports on small inputs with known results."""

import json
from datetime import date

import pytest

from barloom.operators import inventory, reports
from barloom.sources import storage, vendor

ROWS = "date string, symbol string, open string, high string, low string, close string, volume string, amount string"


def test_jsonl_reads_rows_and_names_a_bad_line(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"symbol": "510300", "open": 1.5}\n\n{"symbol": "159915"}\n')
    bad.write_text('{"symbol": "510300"}\n{"symbol": broken\n')
    found = vendor.read_jsonl(spark, str(good), "symbol string, open double").collect()
    assert {(r["symbol"], r["open"]) for r in found} == {("510300", 1.5), ("159915", None)}
    with pytest.raises(Exception, match="broken"):
        vendor.read_jsonl(spark, str(bad), "symbol string, open double").collect()


def test_universe_must_be_complete(spark, tmp_path):
    path = tmp_path / "u.json"
    path.write_text(json.dumps([{"symbol": "a", "name": "x"}, {"symbol": "b", "name": "y"}]))
    assert vendor.universe(spark, str(path), ("symbol", "name")).count() == 2
    for wrong in ([{"symbol": "a"}, {"symbol": "a"}], [{"symbol": "a"}, {"symbol": ""}]):
        path.write_text(json.dumps(wrong))
        with pytest.raises(ValueError, match="universe"):
            vendor.universe(spark, str(path))


def test_bars_are_made_uniform(spark):
    rows = spark.createDataFrame(
        [("2010-01-04 15:00:00", "510300", "1.0", "x", "0.9", "1.0", "", "5"), ("2009-12-31", "159915", "1", "1", "1", "1", "1", "1")], ROWS
    )
    (bar,) = vendor.normalise_bars(rows, "raw").collect()
    assert (bar["day"], bar["exchange_symbol"], bar["open"], bar["high"], bar["volume"]) == (date(2010, 1, 4), "sh510300", 1.0, None, None)
    for wrong in ("31.12.2009", "", None):
        with pytest.raises(Exception, match="no date"):
            vendor.normalise_bars(rows.withColumn("date", vendor.F.lit(wrong).cast("string")), "raw").collect()
    named = vendor.normalise_bars(rows.withColumns({"name": vendor.F.lit("N"), "bucket": vendor.F.lit("B")}), "raw").collect()
    assert (named[0]["name"], named[0]["bucket"]) == ("N", "B") and "category" not in named[0]
    with pytest.raises(Exception, match="no exchange"):
        vendor.normalise_bars(rows.withColumn("symbol", vendor.F.lit("910000")), "raw").collect()
    with pytest.raises(ValueError, match="without"):
        vendor.normalise_bars(rows.drop("close"), "raw")


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "symbol string, open double")
    storage.write_csv(df, str(tmp_path / "c"))
    storage.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(spark.read.csv(str(tmp_path / "c"), header=True, schema="symbol string, open double").collect()) == sorted(df.collect())
    assert sorted(vendor.read_jsonl(spark, str(tmp_path / "j"), "symbol string, open double").collect()) == sorted(df.collect())


def test_scope_order(spark):
    names = ["plain", "ABROAD fund", "abroad and global", "global", "allowed abroad"]
    kind, reason = inventory.scope(inventory.F.col("n"), ("abroad", "fund"), ("global",), ("allowed",))
    found = spark.createDataFrame([(n,) for n in names], "n string").select(kind, reason).collect()
    assert [tuple(r) for r in found] == [("candidate", ""), ("exclude", "abroad;fund"), ("exclude", "abroad"), ("review", "global"), ("candidate", "explicit_allow")]


def test_tails_have_one_trade_at_least(spark):
    closed = spark.createDataFrame([("f", t, "A", p, 10, "gain") for t, p in enumerate([0.3, -0.1, 0.2])], "formula string, t long, symbol string, pnl double, holding_days int, reason string")
    found = {r["tail"]: r["total_pnl"] for r in reports.tail_attribution(closed, ["formula"]).collect()}
    assert found == {"left": -0.1, "right": 0.3}


def test_gaps_between_tables(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 1.5), (3, 2.0)], "k int, x double")
    (row,) = reports.largest_gaps(a, b, ["k"], ["x"]).collect()
    assert (row["name"], row["max_gap"], row["unmatched"]) == ("x", 0.5, 2)


def _executions(spark):
    """The plans of all that has been executed, checkpoints and writes included."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(found.size())]


def test_one_scan_of_line_items(spark):
    from barloom import queries

    tables = "/root/testdata/sf0.001"
    for name in ("formula_values", "signal_quality", "adjustment_gate", "inventory_products", "inventory_order", "candidate_summary"):
        before = len(_executions(spark))
        queries.queries()[name](spark, tables).collect()
        scans = [plan for plan in _executions(spark)[before:] if "lineitem.parquet" in plan]
        assert len(scans) == 1 and scans[0].count("lineitem.parquet") <= 2, name  # its location is told in the first and the final plan


def test_the_scan_counter_counts(spark):
    before = len(_executions(spark))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines.count()
    lines.groupBy("l_partkey").count().collect()
    assert len([plan for plan in _executions(spark)[before:] if "lineitem.parquet" in plan]) == 2
