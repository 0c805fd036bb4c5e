"""Quality rules with risk-controlled cutoffs, with DataFrame functions alone.

Every rule measures a text by whole numbers and has cutoffs from loose to tight; a text's level is how many of them it
trips, which are the tightest ones, so that a cutoff is a least level. The labelled texts of a stratum are split in two. On the first half each rule proposes, for each of a rising
series of tolerances, the cutoff that rejects most bad texts among those that reject no larger part of the good ones. All
rules together at one tolerance are a configuration; configurations reject ever more. On the second half, the holdout,
they are tested from the first on: the chance that so few good texts, or fewer, are rejected where the true rate is
`risk` is an exact binomial probability, and as long as it is at most `doubt` divided by the number of strata (Bonferroni),
the configuration is certified; the first one that is not ends the series, so that the order needs no further correction.
With probability 1 - `doubt` no stratum has a certified configuration that rejects more than `risk` of its good texts.
Of certified ones that which rejects most bad texts is chosen, the loosest of equal ones.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import join_hot, stored

BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words a text needs, and the largest part of words in repeated windows, in per cent.
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Rules with their cutoffs from loose to tight; a text trips a cutoff c if the condition holds.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "long_words": ("10 * word_chars > {c} * n_words", (400, 200, 150, 120, 100, 90, 80, 75, 72, 70, 68, 66, 64, 62, 60)),
    "short_words": ("10 * word_chars < {c} * n_words", (10, 20, 25, 30, 34, 36, 38, 40, 41, 42, 43, 44, 45)),
    "symbols": ("100 * n_symbols > {c} * word_chars", (50, 40, 30, 25, 20, 15, 10, 8, 6, 5, 4, 3, 2, 1)),
    "repeated_lines": ("100 * n_dup_lines > {c} * n_lines", (90, 80, 70, 60, 50, 40, 35, 30, 25, 20)),
    "repeated_words": ("100 * n_repeat_words > {c} * n_words", (28, 25, 22, 20, 18, 15, 12, 10)),
}
#: Parts of the good texts, in thousandths, that a rule may reject where it proposes a cutoff.
TOLERANCES = (0, 2, 5, 10, 20, 30)
RISK, DOUBT = 0.05, 0.1


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with `value` computed once however often f has it."""
    return F.transform(F.array(value), f)[0]


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more; `words` has no nulls.

    Windows are ordered by hash and position, so that equal ones are neighbours, and neighbours are compared word by word.
    """

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, i: F.when(i + 1 < F.size(starts), F.least(F.get(starts, i + 1) - p, F.lit(WINDOW))).otherwise(WINDOW))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def among(sorted_: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (F.slice(words, a["p"], WINDOW) == F.slice(words, b["p"], WINDOW))

        met = F.filter(sorted_, lambda x, i: ((i > 0) & same(F.get(sorted_, i - 1), x)) | ((i + 1 < F.size(sorted_)) & same(x, F.get(sorted_, F.when(i + 1 < F.size(sorted_), i + 1).otherwise(0)))))
        return _let(F.array_sort(F.transform(met, lambda x: x["p"])), covered)

    def found(hashes: Column) -> Column:
        several = _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p")))), among)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(several)

    def windows(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(parts, i, WINDOW)))

    several = _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), found)
    return F.when(F.size(words) >= WINDOW, several).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of every row: a
    map over whole texts. stratum is the column's text behind `=`, or empty for null and without a column."""
    stratum = F.lit("") if stratum_col is None else F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).alias("r")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    found = rows.select(
        "doc_id",
        "stratum",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.char_length(F.translate("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "stratum", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"))
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def levels() -> Column:
    """An array with the number of tripped cutoffs of each rule; cutoffs are nested, so the last so many are tripped."""
    of = [f"size(filter(array({', '.join(map(str, cutoffs))}), c -> {condition.format(c='c')}))" for condition, cutoffs in RULES.values()]
    return F.expr(f"array({', '.join(of)})")


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial X with n trials of `rate`, summed in logarithms; 1 where k is above the mean."""
    odds = log(rate) - log(1 - rate)
    start = F.struct((n * log(1 - rate)).cast("double").alias("term"), (n * log(1 - rate)).cast("double").alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["sum"] - top))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * rate, 1.0).otherwise(F.exp(F.aggregate(steps, start, add, lambda a: a["sum"])))


def cutoffs(found: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, tolerance, chosen: the least level of each rule that rejects, rejected_good, good, rejected_bad, bad, p_value) of the
    strata with a certified configuration; counts are those of the holdout.

    found: as `measured`; texts that fail the base rules are no part of it. labels: `label_col` 1 or more is good; of several
    labels of an id the best counts, null ids and labels none. All labelled texts count, in numbers by level.
    """
    good = F.col("good")
    known = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) >= 1).alias("good")).where("doc_id is not null and good is not null")
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"))
    held_out = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1) >= "8"
    # Ids meet in a shuffle of numbers; neither side has a bound. An id's rows are counted together, so a hot id is one row.
    each = found.where(~F.col("base_failed")).groupBy("doc_id", "stratum", levels().alias("levels")).agg(F.count("*").alias("n"))
    seen = each.join(known.hint("merge"), "doc_id").groupBy("stratum", held_out.alias("held_out"), "good", "levels").agg(F.sum("n").alias("n"))
    seen, _ = stored(seen)

    first = seen.where(~F.col("held_out")).select("stratum", "good", "n", F.posexplode("levels").alias("rule", "level"))
    sizes = seen.where(~F.col("held_out")).groupBy("stratum").agg(F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("all_good"))
    by_level = first.where("level > 0").groupBy("stratum", "good", "rule", "level").agg(F.sum("n").alias("n"))
    tripped = by_level.select("stratum", "good", "rule", "n", F.explode(F.sequence(F.lit(1), F.col("level"))).alias("j")).groupBy("stratum", "rule", "j").agg(
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("goods"), F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)).alias("bads")
    )
    series = F.explode(F.array(*map(F.lit, TOLERANCES))).alias("tolerance")
    allowed = tripped.join(sizes, "stratum").select("*", series).where("bads > 0 and 1000 * goods <= tolerance * all_good")
    proposed = allowed.groupBy("stratum", "tolerance", "rule").agg(F.max_by("j", F.struct("bads", "j")).alias("j"))
    configured = proposed.groupBy("stratum", "tolerance").agg(F.map_from_entries(F.collect_list(F.struct("rule", "j"))).alias("at"))  # a row for each rule at most
    never = 1 << 30
    chosen = F.array(*[F.coalesce(F.try_element_at("at", F.lit(i)), F.lit(never)) for i in range(len(RULES))])
    configured = configured.select("stratum", "tolerance", chosen.alias("chosen"))

    tried = seen.where("held_out").join(configured, "stratum")
    hit = F.exists(F.arrays_zip("levels", "chosen"), lambda x: x["levels"] >= x["chosen"])

    def counted(which: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long").alias(name)

    tests = tried.groupBy("stratum", "tolerance", "chosen").agg(counted(good & hit, "rejected_good"), counted(good, "good"), counted(~good & hit, "rejected_bad"), counted(~good, "bad"))
    strata = seen.where("held_out and good").select("stratum").distinct().count()
    tests = tests.withColumn("p_value", binomial_tail(F.col("rejected_good"), F.col("good"), risk))
    # Configurations are nested, so the probabilities rise along the series: what passes has no failure before it.
    passed = tests.where(F.col("p_value") <= doubt / max(1, strata))
    best = passed.groupBy("stratum").agg(F.max_by(F.struct("tolerance", "chosen", "rejected_good", "good", "rejected_bad", "bad", "p_value"), F.struct("rejected_bad", -F.col("tolerance"))).alias("x"))
    return best.select("stratum", "x.*")


def verdicts(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, tolerance) of every
    row. kept is false where the base rules fail or a certified cutoff of the stratum is tripped.

    Words are runs of other signs than ASCII white space. A stratum without enough labels for a certificate has no cutoffs
    (tolerance null), so the base rules alone decide. Null and empty texts have no words and fail. Null ids and repeated
    rows are returned as they came, an empty table gives an empty one, and without labels only the base rules hold.
    Other columns are left out, whatever their names.
    """
    found, _ = stored(measured(docs, id_col, text_col, stratum_col))
    limits = cutoffs(found, labels, label_col, id_col, risk, doubt).select("stratum", "tolerance", "chosen")
    sizes = found.groupBy("stratum").agg(F.count("*").alias("n"))
    limits = sizes.join(limits, "stratum", "left").select("stratum", "n", "tolerance", "chosen")
    marked = join_hot(found, limits, "stratum", found.count())
    tripped = F.exists(F.arrays_zip(levels().alias("levels"), F.col("chosen")), lambda x: x["levels"] >= x["chosen"])
    kept = ~F.col("base_failed") & ~F.coalesce(tripped, F.lit(False))
    return marked.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum", "tolerance")
