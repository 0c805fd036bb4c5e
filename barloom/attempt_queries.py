"""Registered queries on formula attempts: one random formula for each supplier, scored on the brand weeks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attempt_sql, sql
from .attempt_sql import KNOWN, PAIRS, Attempts, greedy
from .market_queries import _batch_sql, formula_ctes
from .operators import candidates, evaluation, likeness, scoring
from .plans import display, language, older, walks
from .queries import _USED, _VALUES, HORIZON, START, _signal, query, rounded, tree
from .sources import ledger, star
from .sources.storage import kept, shared_folder, stored
from .streaming import attempts as arrivals

SEED = 11
_SQL = "WITH RECURSIVE " + Attempts(SEED).ctes(_batch_sql, formula_ctes)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_index, tokens) of a walk for each supplier. Every tenth loses its last token, and every tenth repeats an
    earlier walk, so that there are token lists that are no formulas, and duplicates."""
    rows = star.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("attempt_index"))
    i = F.col("attempt_index")
    found = rows.withColumn("tokens", walks.formulas(F.when(i % 10 == 7, i - 5).otherwise(i), SEED))
    return found.withColumn("tokens", F.when(i % 10 == 3, F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(1)))).otherwise(F.col("tokens")))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = star.brand_panel(spark, sf_dir)
    return evaluation.histories(panel, scoring.forward_targets(panel, START, None, HORIZON))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every attempt, with rewards rounded, so that ties in them don't depend on the order of sums."""
    found = candidates.score(candidates.described(attempts(spark, sf_dir)), _history(spark, sf_dir))
    return kept(rounded(found, "reward", "effective_reward"))


def _int(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


@query(f"""{_SQL} SELECT attempt_index, token_len, canonical_hash, nodes, depth, repeats, operators, status, reward, effective_reward, round(coverage, 8) + 0.0 AS coverage, CASE WHEN ok THEN selection_hash END AS selection_hash FROM attempts""")
def candidate_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _int(rounded(_scored(spark, sf_dir), "coverage"), "attempt_index")
    ok = F.col("status").isin(*candidates.SOUND)
    return found.select("attempt_index", "token_len", "canonical_hash", "nodes", "depth", "repeats", F.array_join("operators", ";").alias("operators"), "status", "reward", "effective_reward", "coverage", F.when(ok, F.col("selection_hash")).alias("selection_hash"))


@query(f"{_SQL} SELECT * FROM best")
def candidate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int(candidates.best_of_hash(_scored(spark, sf_dir)), "first_index")


@query(f"""{_SQL} SELECT canonical_hash, token_len, reward, CAST((token_len - 1) // 5 AS INTEGER) AS bucket, row_number() OVER (PARTITION BY (token_len - 1) // 5 ORDER BY reward DESC, token_len, canonical_hash) AS place FROM best QUALIFY place <= 5""")
def candidate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.buckets(candidates.best_of_hash(_scored(spark, sf_dir)), 5).select("canonical_hash", "token_len", "reward", "bucket", "place")


@query(f"""{_SQL}, so AS (SELECT attempt_index, greatest(-5.0::DOUBLE, coalesce(max(CASE WHEN ok THEN reward END) OVER (ORDER BY attempt_index), -5.0::DOUBLE)) AS best_so_far FROM attempts)
SELECT attempt_index, best_so_far, round(sum(best_so_far) OVER (ORDER BY attempt_index) / (attempt_index + 1), 8) + 0.0 AS mean_best FROM so""")
def candidate_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int(rounded(candidates.running_best(_scored(spark, sf_dir)), "mean_best"), "attempt_index")


_Q = [f"q{int(q * 100):02d}" for q in candidates.QUANTILES]


@query(f"""{_SQL} SELECT status, count(*) AS attempts, round(avg(reward), 8) + 0.0 AS mean, round(stddev_pop(reward), 8) + 0.0 AS spread, {', '.join(f'round(quantile_cont(reward, {q}), 8) + 0.0 AS {n}' for q, n in zip(candidates.QUANTILES, _Q))}
FROM attempts GROUP BY status""")
def candidate_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.reward_quantiles(_scored(spark, sf_dir)), "mean", "spread", *_Q)


@query(f"""{_SQL} SELECT 'status' AS kind, status AS value, count(*) AS n FROM attempts GROUP BY status UNION ALL SELECT 'length', CAST(token_len AS VARCHAR), count(*) FROM attempts GROUP BY token_len
UNION ALL SELECT 'token', token, count(*) FROM (SELECT unnest(string_split(tokens, ' ')) AS token FROM attempts WHERE tokens <> '') GROUP BY token""")
def candidate_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.histograms(_scored(spark, sf_dir))


@query(f"""{_SQL} SELECT count(*) AS attempts, round(avg(CASE WHEN ok THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 8) + 0.0 AS invalid_rate, count(DISTINCT CASE WHEN ok THEN canonical_hash END) AS forms, max(CASE WHEN ok THEN reward END) AS best_reward,
  round(avg(CASE WHEN ok THEN reward END), 8) + 0.0 AS mean_reward, round(corr(reward, token_len) FILTER (ok), 8) + 0.0 AS length_correlation FROM attempts""")
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.search_summary(_scored(spark, sf_dir)), "invalid_rate", "mean_reward", "length_correlation")


@query(f"""{_SQL} SELECT factor, count(*) AS formulas, round(avg(reward), 8) + 0.0 AS mean_reward, max(reward) AS best_reward FROM (SELECT unnest(string_split(factors, ';')) AS factor, reward FROM attempts WHERE status = 'accepted_unique' AND factors <> '')
GROUP BY factor""")
def candidate_factor_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.factor_usage(_scored(spark, sf_dir)), "mean_reward")


@query(f"""{_SQL} SELECT token_len, count(*) AS formulas, round(avg(reward), 8) + 0.0 AS mean_reward, max(reward) AS best_reward, min(reward) AS worst_reward FROM attempts WHERE status = 'accepted_unique' GROUP BY token_len""")
def candidate_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.reward_by_length(_scored(spark, sf_dir)), "mean_reward")


@query(f"""{_SQL},
u AS (SELECT reward, token_len, nodes, depth, repeats, len(list_filter(string_split(factors, ';'), lambda x: x <> '')) AS nf, len(list_filter(string_split(operators, ';'), lambda x: x <> '')) AS no FROM attempts WHERE status = 'accepted_unique'),
long AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, CAST({c} AS BIGINT) AS x, reward FROM u" for n, c in (('tokens', 'token_len'), ('nodes', 'nodes'), ('depth', 'depth'), ('factors', 'nf'), ('operators', 'no'), ('repeats', 'repeats')))})
SELECT feature, count(*) AS formulas, round(avg(x), 8) + 0.0 AS mean, min(x) AS least, max(x) AS most, round(CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(reward) > 0 THEN corr(x, reward) END, 8) + 0.0 AS reward_correlation FROM long GROUP BY feature""")
def candidate_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.complexity(_scored(spark, sf_dir)), "mean", "reward_correlation")


@query(f"""{_SQL}, o AS (SELECT attempt_index, reward, unnest(string_split(operators, ';')) AS operator FROM attempts WHERE status = 'accepted_unique' AND operators <> '')
SELECT operator, count(*) AS formulas, CAST(sum(n) AS BIGINT) AS uses, round(avg(reward), 8) + 0.0 AS mean_reward FROM (SELECT attempt_index, operator, count(*) AS n, min(reward) AS reward FROM o GROUP BY ALL) GROUP BY operator""")
def candidate_operator_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(candidates.operator_usage(_scored(spark, sf_dir)), "mean_reward")


# Likeness of the best forms of each bucket, and what is kept of them


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, pairs) of the best forms of each bucket that have enough days to be compared."""
    history = stored(_history(spark, sf_dir))
    tried = kept(candidates.described(attempts(spark, sf_dir)))
    scored = rounded(candidates.score(tried, history), "reward")
    items = kept(candidates.buckets(candidates.best_of_hash(scored)).select("canonical_hash", "token_len", "reward"))
    programs = tried.where("reason = ''").select("canonical_hash", "program").dropDuplicates(["canonical_hash"])
    blocks, n = evaluation.in_blocks(programs.join(items.select("canonical_hash").hint("merge"), "canonical_hash"))
    found = stored(evaluation.signals(history, blocks, n))
    enough = likeness.covered(found, blocks).where("sufficient").select("canonical_hash")
    items = kept(items.join(enough, "canonical_hash", "left_semi"))
    return items, kept(rounded(likeness.among(likeness.pairs(found, blocks, n), items), "rho"))


@query(f"{_SQL}, {PAIRS} SELECT a, b, days, sufficient, rho FROM pairs")
def candidate_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)[1].select("a", "b", "days", "sufficient", "rho")


_CONFLICT = "(NOT n.sufficient OR n.rho >= 0.995)"


@query(f"""{_SQL}, {PAIRS}, {greedy('kept', _CONFLICT)},
block AS (SELECT greatest(n.pa, n.pb) AS place, arg_min(CASE WHEN n.pa < n.pb THEN n.a ELSE n.b END, least(n.pa, n.pb)) AS blocker, arg_min(n.sufficient, least(n.pa, n.pb)) AS told
  FROM near n JOIN kept k ON k.place = least(n.pa, n.pb) AND k.stays WHERE {_CONFLICT} GROUP BY 1)
SELECT e.canonical_hash, k.stays, CASE WHEN k.stays THEN '' WHEN told THEN 'signal_duplicate' ELSE 'insufficient_overlap' END AS reason, CASE WHEN NOT k.stays THEN blocker END AS blocker
FROM eligible e JOIN kept k ON k.place = e.place LEFT JOIN block ON block.place = e.place""")
def candidate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likeness.deduplicated(*_compared(spark, sf_dir))


@query(f"""{_SQL}, {PAIRS}, {greedy('kept', _CONFLICT)}, uniques AS (SELECT e.* FROM eligible e JOIN kept k ON k.place = e.place WHERE k.stays), {greedy('led', '(n.sufficient AND n.rho >= 0.9)', 'uniques')},
joined AS (SELECT greatest(n.pa, n.pb) AS place, arg_min(CASE WHEN n.pa < n.pb THEN n.a ELSE n.b END, least(n.pa, n.pb)) AS leader FROM near n JOIN led k ON k.place = least(n.pa, n.pb) AND k.stays WHERE n.sufficient AND n.rho >= 0.9 GROUP BY 1)
SELECT u.canonical_hash, CASE WHEN l.stays THEN u.canonical_hash ELSE leader END AS leader, l.stays AS leads FROM uniques u JOIN led l ON l.place = u.place LEFT JOIN joined j ON j.place = u.place""")
def candidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, pairs = _compared(spark, sf_dir)
    stays = kept(likeness.deduplicated(items, pairs).where("stays").select("canonical_hash"))
    unique = items.join(stays, "canonical_hash", "left_semi")
    return likeness.clustered(unique, likeness.among(pairs, stays))


_TOP = "(n.sufficient AND n.rho >= 0.995)"


@query(f"""{_SQL}, {PAIRS}, top AS (SELECT * FROM eligible ORDER BY place LIMIT 50), {greedy('kept', _TOP, 'top')},
stop AS (SELECT greatest(n.pa, n.pb) AS place, min(least(n.pa, n.pb)) AS at FROM near n JOIN kept k ON k.place = least(n.pa, n.pb) AND k.stays WHERE {_TOP} GROUP BY 1),
tried_pairs AS (SELECT r.place, k.place AS other FROM kept r LEFT JOIN stop s ON s.place = r.place JOIN kept k ON k.stays AND k.place < r.place AND k.place <= coalesce(s.at, r.place)),
c AS (SELECT count(*) AS comparisons, coalesce(count_if(NOT n.sufficient), 0) AS insufficient FROM tried_pairs p JOIN near n ON greatest(n.pa, n.pb) = p.place AND least(n.pa, n.pb) = p.other)
SELECT count(*) AS formulas, coalesce(count_if(NOT stays), 0) AS duplicates, coalesce(round(count_if(NOT stays) / nullif(count(*), 0), 8), 0) + 0.0 AS duplicate_rate, (SELECT comparisons FROM c) AS comparisons, (SELECT insufficient FROM c) AS insufficient FROM kept""")
def candidate_top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(likeness.top_duplicates(*_compared(spark, sf_dir)), "duplicate_rate")


_HARD = f"(VALUES {', '.join(f'({h}::DOUBLE)' for h in candidates.HARD_REWARDS)}) AS hard(h)"
_SIZE = 32


@query(f"""{_SQL}, ba AS (SELECT attempt_index // {_SIZE} AS b, reward FROM attempts), e AS (SELECT b, h, reward, coalesce(reward, h) AS x FROM ba, {_HARD}),
g AS (SELECT b, h, count(*) AS n, sum(x) AS s, stddev_pop(x) AS sd, stddev_pop(reward) AS vsd, count(*) - count(reward) AS bad FROM e GROUP BY b, h),
adv AS (SELECT e.b, e.h, e.reward, abs((x - (s - x) / (n - 1)) / (sd + 1e-5)) AS a FROM e JOIN g ON g.b = e.b AND g.h = e.h WHERE bad > 0),
per AS (SELECT a.b, a.h, avg(a) FILTER (reward IS NULL) AS i, avg(a) FILTER (reward IS NOT NULL) AS v, CASE WHEN sum(a) > 1e-9 THEN coalesce(sum(a) FILTER (reward IS NULL), 0) / sum(a) ELSE 0 END AS share FROM adv a GROUP BY a.b, a.h),
whole AS (SELECT p.*, bad, vsd / (sd + 1e-5) AS spread, dense_rank() OVER (ORDER BY p.b DESC) AS late FROM per p JOIN g ON g.b = p.b AND g.h = p.h),
scoped AS (SELECT *, 'all' AS scope FROM whole UNION ALL SELECT *, 'last_2' FROM whole WHERE late <= 2)
SELECT h AS hard_reward, scope, count(*) AS batches, round(avg(bad), 8) + 0.0 AS invalid_count, round(avg(i), 6) + 0.0 AS invalid_advantage, round(avg(v), 6) + 0.0 AS valid_advantage, round(avg(share), 8) + 0.0 AS invalid_share, round(avg(spread), 6) + 0.0 AS valid_spread FROM scoped GROUP BY h, scope""")
def candidate_invalid_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates.invalid_sensitivity(_scored(spark, sf_dir), _SIZE, 2)
    return rounded(rounded(found, "invalid_count", "invalid_share"), "invalid_advantage", "valid_advantage", "valid_spread", digits=6)


# Texts of formulas


def _text(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


_TOKENS = [attempt_sql.tokens_of(SEED, i) for i in range(KNOWN)]
_SHOWN = ", ".join(f"({i}, {_text(a)}, {_text(b)}, '{';'.join(r)}')" for i, (a, b, r) in enumerate(map(attempt_sql.shown, _TOKENS)))
_SHOWN_SQL = f"WITH listed(attempt_index, infix, simplified_infix, rules) AS (VALUES {_SHOWN}), shown AS (SELECT l.* FROM listed l JOIN supplier ON s_suppkey = attempt_index)"


@query(f"{_SHOWN_SQL} SELECT * FROM shown")
def attempt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attempts(spark, sf_dir).select(F.col("attempt_index").cast("int"), display.shown(F.col("tokens")).alias("x"))
    return found.select("attempt_index", "x.infix", "x.simplified_infix", F.array_join("x.rules", ";").alias("rules"))


@query(f"{_SHOWN_SQL} SELECT rule, count(*) AS uses, count(DISTINCT attempt_index) AS formulas FROM (SELECT attempt_index, unnest(string_split(rules, ';')) AS rule FROM shown WHERE rules <> '') GROUP BY rule")
def attempt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attempts(spark, sf_dir).select("attempt_index", F.explode(display.shown(F.col("tokens"))["rules"]).alias("rule"))
    per = found.groupBy("rule", "attempt_index").agg(F.count("*").alias("n"))
    return per.groupBy("rule").agg(F.sum("n").alias("uses"), F.count("*").alias("formulas"))


_LENGTHS, _DEEPEST = (3, 12), 4
_OLDER = ", ".join(f"({i}, '{' '.join(t)}', '{older.infix(older.parse(t))}')" for i, t in enumerate(attempt_sql.older_walked(SEED, i, older.INPUTS, older.UNARY, older.BINARY, _LENGTHS, _DEEPEST) for i in range(KNOWN)))


@query(f"WITH listed(attempt_index, tokens, infix) AS (VALUES {_OLDER}) SELECT attempt_index, tokens FROM listed JOIN supplier ON s_suppkey = attempt_index")
def older_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.col("s_suppkey")
    found = walks.weighted_formulas(row, SEED, older.INPUTS, older.UNARY, older.BINARY, _LENGTHS, _DEEPEST)
    return star.table(spark, sf_dir, "supplier").select(row.cast("int").alias("attempt_index"), F.array_join(found, " ").alias("tokens"))


_RATIOS = {"spread_share": "high low SUB close DIV", "turnover_change": "amount volume DIV RET5", "over_zero": "close open SUB CONST_0 DIV", "flow_surprise": "amount MA20 amount SUB amount STD10 DIV NEG"}


@query(f"""WITH {sql.BRAND}, {sql.PANEL}, q AS (SELECT *, CASE WHEN volume <> 0 THEN amount / volume END AS price FROM panel)
SELECT asset_idx, t, round(CASE WHEN close <> 0 THEN (high - low) / close END, 8) + 0.0 AS spread_share, round(CASE WHEN lag(price, 5) {sql.W} <> 0 THEN price / lag(price, 5) {sql.W} - 1 END, 8) + 0.0 AS turnover_change,
  CAST(NULL AS DOUBLE) AS over_zero, round(-(({sql.mean('amount', 20)} - amount) / nullif({sql.full('amount', 10, 'stddev_pop')}, 0)), 6) + 0.0 AS flow_surprise FROM q""")
def older_formula_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = older.plan(star.brand_panel(spark, sf_dir), {n: t.split() for n, t in _RATIOS.items()}).select("asset_idx", "t", *_RATIOS)
    return rounded(rounded(out, "spread_share", "turnover_change", "over_zero"), "flow_surprise", digits=6)


# Splits by date, and both scorers side by side

SPLITS = {"train": ("1993-06-01", "1996-12-31"), "validation": ("1997-01-01", "1997-12-31"), "last": ("1998-01-01", None)}


def _split_sql(name: str, start: str, end: str | None) -> str:
    inside = f"day >= DATE '{start}'" + (f" AND day <= DATE '{end}'" if end else "")
    first, last = f"(SELECT min(t) FROM panel WHERE {inside})", f"(SELECT max(t) FROM panel WHERE {inside})"
    ctes = sql.TARGETS.replace("FROM panel\n", f"FROM panel WHERE t <= {last}\n", 1).replace("t >= 60", f"t >= {first}")
    return f"SELECT '{name}' AS split, asset_idx, t, buy_t, sell_t, round(fwd_ret, 8) + 0.0 AS fwd_ret, round(baseline_ret, 8) + 0.0 AS baseline_ret, CAST(top_k AS BIGINT) AS top_k FROM (WITH {ctes} SELECT * FROM targets)"


@query(f"WITH {sql.BRAND}, {sql.PANEL} " + " UNION ALL ".join(_split_sql(n, *days) for n, days in SPLITS.items()))
def split_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.split_targets(kept(star.brand_panel(spark, sf_dir)), SPLITS, HORIZON)
    return rounded(found.select("split", "asset_idx", "t", "buy_t", "sell_t", "fwd_ret", "baseline_ret", "top_k"), "fwd_ret", "baseline_ret")


_BOTH = {n: _VALUES[n] for n in ("clv_intraday", "reversal", "trend_sign", "turn")}


def _both_sql() -> str:
    new = _batch_sql(sql.with_factors(sql.BRAND, _USED), _BOTH)
    each = " UNION ALL ".join(f"SELECT '{n}' AS formula, *, {x} AS os FROM factored" for n, x in _BOTH.items())
    return f"""WITH {new},
n AS (SELECT formula, coalesce(bool_and(eligible_count >= top_k), false) AS valid, count(*) AS days, avg(absolute_return) AS a, avg(absolute_return - baseline_return) AS e FROM daily GROUP BY formula),
osig AS ({each}),
omoved AS (SELECT *, lead(open, 1) OVER w AS ob, lead(open, 11) OVER w AS ox, lead(tradable, 1) OVER w AS ok_b, lead(tradable, 11) OVER w AS ok_s FROM osig WINDOW w AS (PARTITION BY formula, asset_idx ORDER BY t)),
oavail AS (SELECT *, count(*) OVER (PARTITION BY formula, t) AS ac FROM omoved WHERE tradable AND ok_s IS NOT NULL),
oelig AS (SELECT *, count(*) OVER (PARTITION BY formula, t) AS ec FROM oavail WHERE ac >= 10 AND ok_b AND ok_s AND os IS NOT NULL AND ob > 0 AND ox IS NOT NULL),
orank AS (SELECT *, least(ec, least(4, greatest(2, CAST(ceil(ac * 0.2::DOUBLE) AS INTEGER)))) AS k, row_number() OVER (PARTITION BY formula, t ORDER BY os DESC, asset_idx) AS rk FROM oelig WHERE ec >= 2),
oday AS (SELECT formula, t, avg(ox / ob - 1) AS r FROM orank WHERE rk <= k GROUP BY formula, t),
o AS (SELECT formula, count(*) AS days, avg(r) AS a FROM oday GROUP BY formula)
SELECT formula, valid, n.days AS corrected_days, round(CASE WHEN valid THEN n.a END, 8) + 0.0 AS corrected_absolute_return, round(CASE WHEN valid THEN e ELSE -5.0::DOUBLE END, 8) + 0.0 AS corrected_excess_return,
  o.days AS older_days, round(o.a, 8) + 0.0 AS older_absolute_return, round(CASE WHEN valid THEN n.a END - o.a, 8) + 0.0 AS absolute_return_difference FROM n FULL JOIN o USING (formula)"""


@query(_both_sql())
def scorer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = kept(language.plan(star.brand_panel(spark, sf_dir), {n: tree(n) for n in _BOTH}))
    found = scoring.scorer_comparison(panel, scoring.forward_targets(panel, START, None, HORIZON), [*_BOTH], HORIZON)
    return rounded(found, "corrected_absolute_return", "corrected_excess_return", "older_absolute_return", "absolute_return_difference")


# Attempts as they arrive, and their ledger

_ARRIVE, _ROUNDS = 25, 3


def _followed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a stream that has followed all attempts, which arrive by index, `_ARRIVE` at a time.

    The stream ends and goes on `_ROUNDS` times at most. A round brings a range of arrivals, and its rows stay in as many
    files as they are in; a round for each arrival would make the number of jobs grow with the attempts.
    """
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    sound = F.col("status").isin(*candidates.SOUND)
    rows = kept(_scored(spark, sf_dir).select("attempt_index", "canonical_hash", F.when(sound, F.col("selection_hash")).alias("selection_hash"), "token_len", "reward", sound.alias("sound"), F.when(~sound, F.col("status")).alias("flaw")))
    last = rows.agg(F.max("attempt_index")).first()[0]
    step = _ARRIVE * -(-(last + 1) // (_ARRIVE * _ROUNDS)) if last is not None else 1
    for first in range(0, 1 if last is None else last + 1, step):
        rows.where(F.col("attempt_index").between(first, first + step - 1)).write.mode("append").parquet(f"{folder}/in")
        arrivals.follow(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", _ARRIVE).awaitTermination()
    return f"{folder}/out"


@query(f"{_SQL} SELECT attempt_index, status, reward FROM attempts")
def attempt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int(arrivals.statuses(spark, _followed(spark, sf_dir)), "attempt_index")


@query(f"""{_SQL} SELECT canonical_hash, count(*) AS attempts, min(attempt_index) AS first_index, min(attempt_index) FILTER (ok) AS first_sound, count(*) FILTER (ok) AS sound,
  arg_min(token_len, (-reward, token_len, attempt_index)) FILTER (ok) AS token_len, arg_min(reward, (-reward, token_len, attempt_index)) FILTER (ok) AS reward, arg_min(attempt_index, (-reward, token_len, attempt_index)) FILTER (ok) AS best_index
FROM attempts WHERE canonical_hash IS NOT NULL GROUP BY canonical_hash""")
def attempt_stream_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int(arrivals.forms(spark, _followed(spark, sf_dir)), "first_index", "first_sound", "best_index")


@query(f"""{_SQL}, b AS (SELECT *, attempt_index // {_ARRIVE} AS batch FROM attempts)
SELECT CAST(batch AS INTEGER) AS batch, min(attempt_index) AS first, max(attempt_index) AS last, count(*) AS attempts, count_if(status = 'accepted_unique') AS accepted_unique, count_if(status = 'canonical_duplicate') AS canonical_duplicate, count_if(status = 'selection_duplicate') AS selection_duplicate,
  count(reward) AS sound, round(avg(reward), 8) + 0.0 AS mean_reward, max(reward) AS best_reward, greatest(-5.0::DOUBLE, coalesce(max(max(reward)) OVER (ORDER BY batch), -5.0::DOUBLE)) AS best_so_far FROM b GROUP BY batch""")
def attempt_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _int(rounded(arrivals.metrics(spark, _followed(spark, sf_dir)), "mean_reward"), "first", "last")


_CODES = "[" + ", ".join(f"'{s}'" for s in ledger.STATUS) + "]"


@query(f"{_SQL} SELECT attempt_index, CAST(list_position({_CODES}, status) - 1 AS INTEGER) AS status, token_len, canonical_hash, CASE WHEN ok THEN selection_hash END AS selection_hash, round(CAST(CAST(reward AS FLOAT) AS DOUBLE), 8) + 0.0 AS reward FROM attempts")
def attempt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).removeprefix('file:')}/ledger-{uuid.uuid4().hex}"
    sound = F.col("status").isin(*candidates.SOUND)
    ids = F.transform("tokens", lambda t: F.array_position(F.array(*map(F.lit, language.TOKENS)), t).cast("int") - 1)
    code = F.array_position(F.array(*map(F.lit, ledger.STATUS)), F.col("status")).cast("int") - 1
    rows = _scored(spark, sf_dir).select("attempt_index", F.lit(0).alias("training_step"), code.alias("status"), ids.alias("token_ids"), "canonical_hash", F.when(sound, F.col("selection_hash")).alias("selection_hash"),
        F.col("reward").cast("float"), F.col("effective_reward").cast("float").alias("training_reward"), F.col("coverage").cast("float"), F.lit(None).cast("float").alias("finite_std"))
    ledger.write(rows, folder)
    found = _int(ledger.read(spark, folder), "attempt_index")
    return rounded(found.select("attempt_index", "status", F.size("token_ids").alias("token_len"), "canonical_hash", "selection_hash", F.col("reward").cast("double")), "reward")
