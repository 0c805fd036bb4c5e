"""The table of formula attempts: canonical forms, scores, status, duplicates, buckets and summaries.

attempts: (attempt_index long, tokens array<string>), as many as there are; a hot form or selection stays spread, since
what marks duplicates is aggregated before it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import language
from ..sources.storage import kept, stored
from . import evaluation, likeness, scans, scoring

#: Token lengths of the buckets: up to 5, 10 and 15.
BUCKET = 5
SOUND = ("canonical_duplicate", "selection_duplicate", "accepted_unique")
QUANTILES = (0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0)
_FIELDS = [("reason", pa.string(), "string"), ("canonical_hash", pa.string(), "string"), ("canonical", pa.string(), "string"), ("program", pa.list_(pa.string()), "array<string>"), ("factors", pa.list_(pa.string()), "array<string>"), ("operators", pa.list_(pa.string()), "array<string>"), ("nodes", pa.int32(), "int"), ("depth", pa.int32(), "int"), ("repeats", pa.int32(), "int")]
DESCRIBED = ", ".join(f"{n} {ddl}" for n, _, ddl in _FIELDS)


def describe(tokens: list[str] | None) -> tuple:
    """What a token list is, as DESCRIBED: an empty reason for a formula, else why it is none."""
    try:
        tree = language.canonical(language.parse(tokens or []))
    except language.FormulaError as error:
        return error.reason, None, None, None, [], [], 0, 0, 0
    return "", language.digest(tree), language.text(tree), language.program(tree), sorted(language.factor_names(tree)), sorted(language.operator_names(tree)), *language.shape(tree), language.repeats(tree)


def described(rows: DataFrame) -> DataFrame:
    """`rows` (attempt_index, tokens array<string>) with token_len and what `describe` says, in Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [*zip(*map(describe, batch.to_pylist()))] or [[]] * len(_FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(found, _FIELDS)], [n for n, _, _ in _FIELDS])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    of = F.arrow_udf(run, f"struct<{', '.join(f'{n}: {ddl}' for n, _, ddl in _FIELDS)}>")
    return rows.select("attempt_index", "tokens", F.coalesce(F.size("tokens"), F.lit(0)).alias("token_len"), of("tokens").alias("x")).select("attempt_index", "tokens", "token_len", "x.*")


def score(tried: DataFrame, history: DataFrame) -> DataFrame:
    """`tried`, as `described`, with scores on the assets' histories (as `evaluation.histories`), status and rewards: each
    different formula is computed once."""
    tried = kept(tried)
    history = stored(history)  # a row for each asset
    span = max(1, evaluation.CELLS // max(1, history.count()))
    blocks, n = evaluation.in_blocks(tried.where("reason = ''").select("canonical_hash", "program").dropDuplicates(["canonical_hash"]))
    return resolved(tried, evaluation.scores(evaluation.signals(history, blocks, n, packed=True), blocks, span=span))


def resolved(tried: DataFrame, found: DataFrame) -> DataFrame:
    """Attempts with scores (by canonical hash), status, reward and effective_reward.

    In this order: no formula or no finite value, a day without enough values, a constant signal, low coverage, a canonical
    form that an earlier sound attempt has, a selection that an earlier one of those left has, or accepted. Only sound
    attempts have a reward; the effective one of others is the hard one.

    What is joined is as large as the attempts, so these are merges and no broadcasts; attempts without a form are spread.
    """
    form = F.coalesce("canonical_hash", F.col("attempt_index").cast("string")).alias("_form")
    rows = tried.select("*", form).join(found.withColumnRenamed("canonical_hash", "_form").hint("merge"), "_form", "left")
    broken = (F.col("reason") != "") | F.col("quality_reason").isNull() | (F.col("quality_reason") == "non_finite_result")
    flaw = (
        F.when(broken, "vm_invalid")
        .when(~F.coalesce("scorable", F.lit(False)), "insufficient_daily_signal")
        .when(F.col("quality_reason") == "constant_signal", "constant_signal")
        .when(F.col("quality_reason") == "low_coverage", "low_coverage")
    )
    sound = F.col("flaw").isNull()
    rows = rows.withColumn("flaw", flaw)
    # Duplicates are marked by the first index of their form and selection, from sums by key: no window over a hot key.
    firsts = rows.where(sound).groupBy("canonical_hash").agg(F.min("attempt_index").alias("_first"), F.first("selection_hash").alias("selection_hash"))
    chosen = firsts.groupBy("selection_hash").agg(F.min("_first").alias("_chosen"))
    marks = firsts.join(chosen.hint("merge"), "selection_hash").select(F.col("canonical_hash").alias("_form"), "_first", "_chosen")
    rows = rows.join(marks.hint("merge"), "_form", "left")
    index = F.col("attempt_index")
    status = F.coalesce("flaw", F.when(index > F.col("_first"), "canonical_duplicate").when(index > F.col("_chosen"), "selection_duplicate").otherwise("accepted_unique"))
    reward = F.when(sound, F.col("reward"))
    rows = rows.withColumns({"status": status, "reward": reward, "effective_reward": F.coalesce(reward, F.lit(scoring.HARD))})
    return rows.drop("_form", "_first", "_chosen", "flaw", "quality_reason", "scorable")


def sound(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isin(*SOUND))


def best_of_hash(rows: DataFrame) -> DataFrame:
    """Sound attempts by canonical form: the first index, how many there are, and the best by reward, then by length."""
    best = F.min_by(F.struct("token_len", "reward"), F.struct(-F.col("reward"), "token_len", "attempt_index")).alias("best")
    out = sound(rows).groupBy("canonical_hash").agg(F.min("attempt_index").alias("first_index"), F.count("*").alias("attempts"), best)
    return out.select("canonical_hash", "first_index", "attempts", "best.token_len", "best.reward")


def buckets(unique: DataFrame, size: int = 500) -> DataFrame:
    """The best `size` forms of each length bucket: by reward, then length, then hash."""
    bucket = F.floor((F.col("token_len") - 1) / BUCKET).cast("int")
    order = Window.partitionBy("bucket").orderBy(F.col("reward").desc(), "token_len", "canonical_hash")
    return unique.withColumn("bucket", bucket).withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def running_best(rows: DataFrame, width: int = scans.WIDTH) -> DataFrame:
    """(attempt_index, best_so_far, mean_best): the best sound reward so far, which starts at the hard one, and the area
    below that curve per attempt. Both are scans in two levels, so that no task holds all attempts."""
    ok = F.col("status").isin(*SOUND)
    best = rows.select("attempt_index", F.greatest(F.when(ok, F.col("reward")), F.lit(scoring.HARD)).alias("reward"))
    out = scans.running(best, "attempt_index", {"best_so_far": ("reward", "max")}, width=width)
    out = scans.running(out, "attempt_index", {"area": ("best_so_far", "sum")}, width=width)
    return out.select("attempt_index", "best_so_far", (F.col("area") / (F.col("attempt_index") + 1)).alias("mean_best"))


def reward_quantiles(rows: DataFrame) -> DataFrame:
    """One row for each status: attempts, mean, spread and interpolated quantiles of rewards."""
    names = [f"q{int(q * 100):02d}" for q in QUANTILES]
    sums = rows.groupBy("status").agg(F.count("*").alias("attempts"), F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("spread"))
    return sums.join(scans.quantiles(rows, ["status"], "reward", dict(zip(names, QUANTILES))), "status", "left")


def histograms(rows: DataFrame) -> DataFrame:
    """(kind, value, n): how often each status, token length and token occurs."""
    def counted(kind: str, value) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), value.alias("value"))

    every = counted("status", F.col("status")).unionByName(counted("length", F.col("token_len").cast("string"))).unionByName(counted("token", F.explode("tokens")))
    return every.groupBy("kind", "value").agg(F.count("*").alias("n"))


def search_summary(rows: DataFrame) -> DataFrame:
    """One row: attempts, share without a sound signal, different forms, best and mean sound reward."""
    ok = F.col("status").isin(*SOUND)
    return rows.agg(
        F.count("*").alias("attempts"),
        F.avg((~ok).cast("double")).alias("invalid_rate"),
        F.countDistinct(F.when(ok, F.col("canonical_hash"))).alias("forms"),
        F.max(F.when(ok, F.col("reward"))).alias("best_reward"),
        F.avg(F.when(ok, F.col("reward"))).alias("mean_reward"),
        F.try_divide(F.covar_pop(F.when(ok, F.col("reward")), F.when(ok, F.col("token_len"))), F.stddev_pop(F.when(ok, F.col("reward"))) * F.stddev_pop(F.when(ok, F.col("token_len")))).alias("length_correlation"),
    )


def factor_usage(rows: DataFrame) -> DataFrame:
    """Accepted formulas by factor: how many use it, and their mean and best reward."""
    used = rows.where(F.col("status") == "accepted_unique").select(F.explode("factors").alias("factor"), "reward")
    return used.groupBy("factor").agg(F.count("*").alias("formulas"), F.avg("reward").alias("mean_reward"), F.max("reward").alias("best_reward"))


def reward_by_length(rows: DataFrame) -> DataFrame:
    """Accepted formulas by token length: how many, and their mean, best and worst reward."""
    used = rows.where(F.col("status") == "accepted_unique")
    return used.groupBy("token_len").agg(F.count("*").alias("formulas"), F.avg("reward").alias("mean_reward"), F.max("reward").alias("best_reward"), F.min("reward").alias("worst_reward"))


def complexity(rows: DataFrame) -> DataFrame:
    """(feature, formulas, mean, least, most, reward_correlation) over accepted formulas: tokens, nodes, depth, different
    factors, operators and repeated parts; the correlation is missing for fewer than two or without spread."""
    used = rows.where(F.col("status") == "accepted_unique").select("reward", F.col("token_len").alias("tokens"), "nodes", "depth", F.size("factors").alias("factors"), F.size("operators").alias("operators"), "repeats")
    names = ("tokens", "nodes", "depth", "factors", "operators", "repeats")
    long = used.select("reward", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("long").alias("x")) for n in names])).alias("e")).select("reward", "e.*")
    related = F.try_divide(F.covar_pop("x", "reward"), F.stddev_pop("x") * F.stddev_pop("reward"))
    return long.groupBy("feature").agg(F.count("*").alias("formulas"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), related.alias("reward_correlation"))


def operator_usage(rows: DataFrame) -> DataFrame:
    """Accepted formulas by operator: how many use it, how often in all, and their mean reward."""
    used = rows.where(F.col("status") == "accepted_unique").select("attempt_index", "reward", F.explode("operators").alias("operator"))
    one = used.groupBy("attempt_index", "operator").agg(F.count("*").alias("n"), F.first("reward").alias("reward"))
    return one.groupBy("operator").agg(F.count("*").alias("formulas"), F.sum("n").alias("uses"), F.avg("reward").alias("mean_reward"))


def with_signals(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """`rows` with the columns of `signals` (canonical_hash, ...); a hash that has none is an error with its text."""
    there = signals.withColumn("_there", F.lit(True))
    found = rows.join(there.hint("merge"), "canonical_hash", "left")
    sure = F.coalesce("_there", F.raise_error(F.concat(F.lit("no signal for "), F.coalesce("canonical_hash", F.lit("null")))).cast("boolean"))
    return found.where(sure).drop("_there")


HARD_REWARDS = (-5.0, -0.1, -0.01, -0.005)


def invalid_sensitivity(rows: DataFrame, batch: int = 256, last: int = 20, hard: tuple[float, ...] = HARD_REWARDS) -> DataFrame:
    """(hard_reward, scope, batches, invalid_count, invalid_advantage, valid_advantage, invalid_share, valid_spread): how much
    attempts without a reward weigh, depending on the reward that they are given instead.

    Attempts come in batches by index. An advantage is an attempt's reward less the mean of the others of its batch, in
    standard deviations of the batch. Batches without an invalid attempt are left out; scope is `all` or the `last` ones.
    Numbers are means over batches: invalid attempts, the size of invalid and of valid advantages, the share of invalid ones in
    the sum of sizes, and the spread of valid rewards against all. A batch of one attempt that is invalid is an error.
    """
    per = rows.groupBy(F.floor(F.col("attempt_index") / batch).alias("batch")).agg(F.count("*").alias("n"), F.collect_list("reward").alias("valid"))  # `batch` rewards at most
    per = per.withColumn("bad", F.col("n") - F.size("valid")).where("bad > 0")
    recent = per.select("batch").orderBy(F.col("batch").desc()).limit(last)
    per = per.join(recent.withColumn("recent", F.lit(True)), "batch", "left")
    per = per.select("*", F.explode(F.array(*map(F.lit, hard))).alias("h"))
    total = lambda f: F.aggregate("valid", F.lit(0.0), lambda a, x: a + f(x))
    per = per.withColumns({"sum": total(lambda x: x) + F.col("bad") * F.col("h"), "ok": F.size("valid")})
    mean = F.col("sum") / F.col("n")
    per = per.withColumns({"sd": F.sqrt((total(lambda x: F.pow(x - mean, 2)) + F.col("bad") * F.pow(F.col("h") - mean, 2)) / F.col("n")), "m": F.try_divide(total(lambda x: x), F.col("ok"))})
    one = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.raise_error(F.lit("a batch of one attempt has no others")).cast("long"))
    # x less the mean of the others, (sum - x) / (n - 1), is (n x - sum) / (n - 1).
    size = lambda x: F.abs(F.col("n") * x - F.col("sum")) / one / (F.col("sd") + 1e-5)
    per = per.withColumns({"invalid": F.col("bad") * size(F.col("h")), "sound": total(size), "valid_sd": F.sqrt(F.try_divide(total(lambda x: F.pow(x - F.col("m"), 2)), F.col("ok")))})
    scope = F.explode(F.when(F.col("recent"), F.array(F.lit("all"), F.lit(f"last_{last}"))).otherwise(F.array(F.lit("all")))).alias("scope")
    per = per.select(
        F.col("h").alias("hard_reward"), scope, "bad", (F.col("invalid") / F.col("bad")).alias("i"), F.try_divide("sound", "ok").alias("v"),
        F.coalesce(F.try_divide(F.col("invalid"), F.col("invalid") + F.col("sound")), F.lit(0.0)).alias("share"), (F.col("valid_sd") / (F.col("sd") + 1e-5)).alias("spread"),
    )
    return per.groupBy("hard_reward", "scope").agg(
        F.count("*").alias("batches"), F.avg("bad").alias("invalid_count"), F.avg("i").alias("invalid_advantage"), F.avg("v").alias("valid_advantage"), F.avg("share").alias("invalid_share"), F.avg("spread").alias("valid_spread")
    )


def similarity(targets: DataFrame, names: list[str], min_assets: int = 10, min_days: int = 252, clip: float = 1e-7) -> DataFrame:
    """(a, b, days, sufficient, rho) of each pair of signal columns of `targets`; see `likeness.pairs`. a comes before b in
    `names`."""
    blocks = targets.sparkSession.createDataFrame([(0, [(f"{i:06d} {n}", [n]) for i, n in enumerate(names)])], "block int, formulas array<struct<canonical_hash: string, program: array<string>>>")
    values = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names])
    found = likeness.pairs(targets.select(F.lit(0).alias("block"), "t", "asset_idx", values.alias("signals")), blocks, 1, min_assets, min_days, clip)
    return found.where("days > 0").withColumns({c: F.substring(c, 8, 1 << 20) for c in "ab"})


def covered(targets: DataFrame, names: list[str], min_assets: int = 10, min_days: int = 252) -> DataFrame:
    """(formula, days, sufficient): on how many days a signal has enough values to be compared."""
    rows = scoring.unpivoted(targets, names).groupBy("formula", "t").agg(F.count("signal").alias("n"))
    out = rows.groupBy("formula").agg(F.count_if(F.col("n") >= min_assets).alias("days"))
    return out.withColumn("sufficient", F.col("days") >= min_days)
