"""Raw vendor rows: JSON lines, the universe, and bars and events made uniform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .star import FIELDS

START = "2010-01-01"
#: First digits of codes by exchange, and the event categories that change a fund's equity.
PREFIXES = {"sh": ("5", "6"), "sz": ("0", "1", "3")}
RIGHTS, EQUITY = 1, (2, 3, 5, 7, 8, 9, 10)
EVENT_VALUES = ("c1", "c2", "c3", "c4")
CARRIED = ("name", "category", "bucket")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON-lines files. A line that is no such row raises an error with its file and text; blank ones are passed
    over. Lines have no numbers in files that are read in parts, so the text stands for them."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    row = F.from_json("value", f"{schema}, _wrong string", {"columnNameOfCorruptRecord": "_wrong"})
    found = lines.select(row.alias("row"), F.input_file_name().alias("file"), "value")
    error = F.raise_error(F.concat(F.lit("not a row of the schema in "), F.col("file"), F.lit(": "), F.col("value"))).cast("boolean")
    sound = F.when(F.col("row").isNull() | F.col("row._wrong").isNotNull(), error).otherwise(True)
    return found.where(sound).select("row.*").drop("_wrong")


def universe(spark: SparkSession, path: str, required: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The assets of one JSON array. Missing or empty required fields, and a symbol twice, raise an error."""
    found = spark.read.option("multiLine", True).json(path)
    if lacking := [c for c in required if c not in found.columns]:
        raise ValueError(f"universe without {lacking}")
    empty = [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "") for c in required]
    n, distinct, *bad = found.agg(F.count("*"), F.countDistinct(required[0]), *empty).first()
    if n != distinct or any(bad):
        raise ValueError(f"universe of {n} rows has {distinct} different symbols and {sum(bad)} empty fields")
    return found


def exchange_symbol(symbol: Column) -> Column:
    """The symbol with its exchange in front, by its first digit; an error for others."""
    found = None
    for exchange, digits in PREFIXES.items():
        here = F.substring(symbol, 1, 1).isin(*digits)
        value = F.concat(F.lit(exchange), symbol)
        found = F.when(here, value) if found is None else found.when(here, value)
    return found.otherwise(F.raise_error(F.concat(F.lit("no exchange for "), F.coalesce(symbol, F.lit("null")))).cast("string"))


def number(name: str) -> Column:
    """The number that a field holds, missing where it holds none."""
    return F.expr(f"try_cast(`{name}` AS double)").alias(name)


def day_of(name: str) -> Column:
    """The day of a text with a date, and perhaps a time of day, which goes; an error with the text for any other, or none."""
    day = F.to_date(F.expr(f"try_cast(`{name}` AS timestamp)"))
    return F.coalesce(day, F.raise_error(F.concat(F.lit("no date: "), F.coalesce(F.col(name), F.lit("null")))).cast("date"))


def _need(rows: DataFrame, names: tuple[str, ...], what: str) -> None:
    if lacking := sorted({*names} - {*rows.columns}):
        raise ValueError(f"{what} without {lacking}")


def normalise_bars(rows: DataFrame, source: str, start: str | None = START) -> DataFrame:
    """(day, symbol, exchange_symbol, source, fields as numbers, and of name, category and bucket what there is) of rows
    from `start` on (None: all). Time of day goes; a date that is none is an error."""
    _need(rows, ("date", "symbol", *FIELDS), f"{source} bars")
    also = [c for c in CARRIED if c in rows.columns]
    out = rows.select(day_of("date").alias("day"), "symbol", exchange_symbol(F.col("symbol")).alias("exchange_symbol"), F.lit(source).alias("source"), *map(number, FIELDS), *also)
    return out.where(F.col("day") >= F.lit(start).cast("date")) if start else out


def normalise_events(rows: DataFrame) -> DataFrame:
    """Events with numbers and the flags is_rights and is_equity of their category."""
    _need(rows, ("date", "symbol", "category_code", *EVENT_VALUES), "events")
    code = F.expr("try_cast(category_code AS int)")
    out = rows.select(day_of("date").alias("date"), "symbol", code.alias("category_code"), *map(number, EVENT_VALUES))
    flags = {"is_rights": F.col("category_code") == RIGHTS, "is_equity": F.col("category_code").isin(*EQUITY)}
    return out.withColumns({n: F.coalesce(x, F.lit(False)) for n, x in flags.items()})


def ohlc_checks(bars: DataFrame, label: str) -> DataFrame:
    """Counts of rows of each symbol with a price at or below zero, a high or low inside the body, or missing flow."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    checks = {
        "invalid_price_rows": F.least(o, h, l, c) <= 0,
        "invalid_high_rows": h < F.greatest(o, c),
        "invalid_low_rows": l > F.least(o, c),
        "missing_flow_rows": F.col("volume").isNull() | F.col("amount").isNull(),
    }
    return bars.groupBy("symbol").agg(*[F.count_if(x).alias(f"{label}_{n}") for n, x in checks.items()])


def panel_report(symbols: DataFrame, raw: DataFrame, adjusted: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each of `symbols` (symbol): extents of the two sources, how they differ, events, whole cells, and checks.

    A cell is whole if all fields are there; coverage is over the days that any symbol has in `raw`.
    """
    whole = None
    for c in FIELDS:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    first = raw.groupBy("symbol").agg(
        F.min("day").alias("raw_first_day"), F.max("day").alias("raw_last_day"), F.count("*").alias("raw_rows"), F.max_by("close", "day").alias("raw_close"), F.count_if(whole).alias("whole_days")
    )
    second = adjusted.groupBy("symbol").agg(F.count("*").alias("adjusted_rows"), F.max_by("close", "day").alias("adjusted_close"))
    apart = raw.select("symbol", "day", F.lit(1).alias("a")).unionByName(adjusted.select("symbol", "day", F.lit(2).alias("a")))
    apart = apart.distinct().groupBy("symbol", "day").agg(F.count("*").alias("n")).where("n = 1").groupBy("symbol").agg(F.count("*").alias("day_mismatches"))
    happened = events.groupBy("symbol").agg(F.count("*").alias("events"), F.count_if("is_rights").alias("rights_events"))
    out = symbols.select("symbol")
    for part in (first, second, apart, happened, ohlc_checks(raw, "raw"), ohlc_checks(adjusted, "adjusted")):
        out = out.join(part, "symbol", "left")
    days = raw.agg(F.countDistinct("day").alias("days"))  # one row
    out = out.crossJoin(F.broadcast(days))
    counts = ("raw_rows", "adjusted_rows", "day_mismatches", "events", "rights_events", "whole_days")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    ratio = F.when(F.col("days") > 0, F.col("whole_days") / F.col("days")).otherwise(0.0)
    return out.withColumns({"latest_close_diff": F.abs(F.col("raw_close") - F.col("adjusted_close")), "coverage": ratio}).drop("raw_close", "adjusted_close", "days")


def set_differences(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """(names, side) of the distinct values that only one table has; no row means that both have the same."""
    both = left.select(*names, F.lit("left").alias("side")).unionByName(right.select(*names, F.lit("right").alias("side"))).distinct()
    return both.groupBy(*names).agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n = 1").drop("n")


def repeated(rows: DataFrame, names: list[str]) -> DataFrame:
    """(names, rows) of the keys that occur more than once."""
    return rows.groupBy(*names).agg(F.count("*").alias("rows")).where("rows > 1")


def first_of(rows: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`: one shuffle, of what is left after each task has kept its own first."""
    held = F.min(F.struct(*order, F.struct(*rows.columns).alias("_row"))).alias("x")
    return rows.groupBy(*names).agg(held).select("x._row.*")


def factor_returns(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """(symbol, day, adj_close, adj_return) of bars that have a factor (symbol, day, adj_factor)."""
    rows = bars.join(factors.select("symbol", "day", "adj_factor"), ["symbol", "day"]).withColumn("adj_close", F.col("close") * F.col("adj_factor"))
    before = F.lag("adj_close").over(Window.partitionBy("symbol").orderBy("day"))
    return rows.select("symbol", "day", "adj_close", (F.try_divide("adj_close", before) - 1).alias("adj_return"))


def return_differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """How two vendors' adjusted returns (symbol, day, adj_return) differ where both have one, for each symbol."""
    both = ours.join(theirs.select("symbol", "day", F.col("adj_return").alias("other")), ["symbol", "day"]).withColumn("gap", F.abs(F.col("adj_return") - F.col("other")))
    return both.where("gap is not null").groupBy("symbol").agg(
        F.count("*").alias("overlap_rows"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > 0.01).alias("gaps_over_1pct"), F.count_if(F.col("gap") > 0.05).alias("gaps_over_5pct")
    )
