"""Liquidity of products: equal products are equal to the last bit, whatever their rows' order, and codes with many rows."""

import random
import statistics
from fractions import Fraction

import pytest

from barloom.operators import inventory

DAYS = "code long, day long, amount double, volume double, close double"


def _days(spark, amounts):
    """Each code's amounts, in an order of its own, over several partitions."""
    rows = []
    for code, own in amounts.items():
        rows += [(code, d, a, float(d % 7) if d % 5 else None, a and a / 3) for d, a in enumerate(random.Random(code).sample(own, len(own)))]
    random.Random(0).shuffle(rows)
    return rows, spark.createDataFrame(rows, DAYS).repartition(7)


@pytest.mark.parametrize("together", [1 << 18, 50, 0])
def test_equal_products_share_a_rank(spark, together):
    rng = random.Random(3)
    own = [round(rng.uniform(900, 100_000), 2) for _ in range(61)]
    amounts = {k: own for k in range(40)} | {k: own[:20] for k in range(40, 60)} | {60: [None, None], 61: [5.0, None, 7.0], 62: [1e300, 1.0, -1e300, 1e-12]}
    rows, days = _days(spark, amounts)
    found = {r["code"]: r for r in inventory.liquidity(days, together).collect()}
    assert {*found} == {*amounts}
    assert len({found[k]["avg_amount"] for k in range(40)}) == 1 and len({found[k]["avg_amount"] for k in range(40, 60)}) == 1
    for code, of in amounts.items():
        r, some = found[code], [a for a in of if a is not None]
        mine = sorted(x[1:] for x in rows if x[0] == code)
        assert (r["observations"], r["first_day"], r["last_day"], r["latest_close"]) == (len(of), 0, len(of) - 1, mine[-1][3])
        assert r["median_amount"] == (pytest.approx(statistics.median(some)) if some else None)
        volumes = [x[2] for x in mine if x[2] is not None]
        assert r["avg_volume"] == (pytest.approx(sum(volumes) / len(volumes)) if volumes else None)
        if code < 60:
            assert r["avg_amount"] == float(sum(Fraction(str(a)) for a in some)) / len(some)
    assert found[60]["avg_amount"] is None and found[61]["avg_amount"] == 6.0 and found[62]["avg_amount"] is not None
