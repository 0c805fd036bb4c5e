"""Random formulas as rows: the same for any partitions, legal, and drawn as often as their chances say."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import attempt_sql
from barloom.plans import language, older, walks


def test_rows_do_not_depend_on_partitions(spark):
    def made(parts):
        rows = spark.range(500).repartition(parts)
        return {r["id"]: (r["a"], r["b"]) for r in rows.select("id", walks.formulas(F.col("id"), 5).alias("a"), walks.weighted_formulas(F.col("id"), 5, older.INPUTS, older.UNARY, older.BINARY).alias("b")).collect()}

    one = made(1)
    assert one == made(7) and len({tuple(a) for a, _ in one.values()}) > 250
    for i in range(0, 500, 17):
        assert one[i] == (attempt_sql.walked(5, i), attempt_sql.older_walked(5, i, older.INPUTS, older.UNARY, older.BINARY, (3, 12), 4))


@pytest.mark.parametrize("longest", [1, 2, 5, language.LONGEST])
def test_walks_are_formulas(longest):
    found = walks.walk(3, np.arange(-2000, 2000), longest)
    for row in found:
        tokens = [language.TOKENS[t] for t in row if t >= 0]
        assert 1 <= len(tokens) <= longest and language.parse(tokens)


def test_actions_are_drawn_evenly():
    n = 60_000
    found = walks.walk(8, np.arange(n))
    first = Counter(found[:, 0].tolist())
    legal = language.legal(language.START, language.LONGEST)
    assert first.keys() == {language.IDS[t] for t in legal}
    assert all(abs(c / n - 1 / len(legal)) < 0.006 for c in first.values())
    # Behind one fixed factor the end is one action of all that are legal.
    one = found[found[:, 0] == language.IDS["CLV"]]
    actions = len(language.legal((1, None, None), language.LONGEST - 1)) + 1
    assert abs((one[:, 1] < 0).mean() - 1 / actions) < 0.02


def test_weights_of_the_older_generator():
    n = 40_000
    inputs, unary, binary = len(older.INPUTS), len(older.UNARY), len(older.BINARY)
    found = walks.weighted_walk(2, np.arange(n), inputs, unary, binary, (3, 12), 4)
    names = [*older.INPUTS, *older.UNARY, *older.BINARY]
    for row in found[:2000]:
        older.parse([names[t] for t in row if t >= 0])
    lengths = Counter((found >= 0).sum(axis=1).tolist())
    assert min(lengths) >= 3 and max(lengths) <= 12 + 3
    assert (found[:, 0] < inputs).all()  # an empty stack takes an operand
    # The second token, where four or more follow: an operand weighs 0.35, a unary operator 0.40, and no binary one fits.
    target = 3 + (walks.uniforms(2, np.arange(n), 0) * 10).astype(int)
    second = found[target >= 6, 1]
    share = (second < inputs).mean()
    assert abs(share - 0.35 * inputs / (0.35 * inputs + 0.40 * unary)) < 0.01 and (second < inputs + unary).all()


def test_attempts_beyond_those_that_the_sql_lists(spark, tmp_path):
    """The SQL lists the first 100 attempts; the queries return one for each supplier, as the second implementation has it."""
    from barloom import attempt_queries, attempt_sql
    from barloom.plans import older

    n = 3 * attempt_sql.KNOWN
    spark.range(n).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    shown = [attempt_sql.shown(attempt_sql.tokens_of(attempt_queries.SEED, i)) for i in range(n)]
    found = {r["attempt_index"]: (r["infix"], r["simplified_infix"], r["rules"]) for r in attempt_queries.attempt_texts(spark, str(tmp_path)).collect()}
    assert found == {i: (a, b, ";".join(rules)) for i, (a, b, rules) in enumerate(shown)}
    uses = {r["rule"]: (r["uses"], r["formulas"]) for r in attempt_queries.attempt_rules(spark, str(tmp_path)).collect()}
    assert uses == {x: (sum(s[2].count(x) for s in shown), sum(x in s[2] for s in shown)) for x in {x for s in shown for x in s[2]}}
    tokens = {r["attempt_index"]: r["tokens"] for r in attempt_queries.older_attempts(spark, str(tmp_path)).collect()}
    assert tokens == {i: " ".join(attempt_sql.older_walked(attempt_queries.SEED, i, older.INPUTS, older.UNARY, older.BINARY, (3, 12), 4)) for i in range(n)}
