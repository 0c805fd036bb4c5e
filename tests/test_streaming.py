"""Streams of attempts: after a stop and a restart as if all had come at once, and gaps are errors."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from barloom.streaming import attempts as arrivals

SCHEMA = "attempt_index long, canonical_hash string, selection_hash string, token_len int, reward double, sound boolean, flaw string"


def some(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        form = rng.choice([None, *"abcdefghij"])
        sound = form is not None and form not in "ij"
        rows.append((i, form, f"x{'abcdefgh'.index(form) // 2}" if sound else None, rng.randint(1, 9), round(rng.uniform(-1, 1), 1) if sound else None, sound, None if sound else "vm_invalid" if form is None else "low_coverage"))
    return rows


def expected(rows):
    forms, chosen, status, best = {}, {}, {}, {}
    for i, form, selection, length, reward, sound, flaw in rows:
        again, before = form in forms, selection in chosen
        forms.setdefault(form, []).append(i)
        if sound:
            chosen.setdefault(selection, i)
            key = (-reward, length, i)
            best[form] = min(best.get(form, key), key)
        status[i] = flaw or ("canonical_duplicate" if again else "selection_duplicate" if before else "accepted_unique")
    forms.pop(None, None)
    return status, {f: (len(at), at[0], -best[f][0] if f in best else None) for f, at in forms.items()}


def follow(spark, folder, rows, step):
    for at in range(0, len(rows), step):
        spark.createDataFrame(rows[at : at + step], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    arrivals.follow(stream, f"{folder}/out", f"{folder}/state").awaitTermination()


def test_a_restart_goes_on(spark, tmp_path):
    rows, folder = some(), str(tmp_path)
    follow(spark, folder, rows[:40], 20)
    follow(spark, folder, rows[40:], 20)
    status, forms = expected(rows)
    assert {r["attempt_index"]: r["status"] for r in arrivals.statuses(spark, f"{folder}/out").collect()} == status
    assert {r["canonical_hash"]: (r["attempts"], r["first_index"], r["reward"]) for r in arrivals.forms(spark, f"{folder}/out").collect()} == forms
    found = sorted(arrivals.metrics(spark, f"{folder}/out").collect(), key=lambda r: r["batch"])
    assert [(r["first"], r["last"], r["attempts"]) for r in found] == [(0, 19, 20), (20, 39, 20), (40, 59, 20)]
    for r in found:
        assert r["best_so_far"] == max([-5.0] + [x[4] for x in rows[: r["last"] + 1] if x[5]])
    # A batch that is run again replaces itself; one without metrics doesn't count.
    spark.createDataFrame([(999, "x", 1.0)], "attempt_index long, status string, reward double").write.parquet(f"{folder}/out/attempts/batch=77")
    assert arrivals.statuses(spark, f"{folder}/out").where("attempt_index = 999").count() == 0


@pytest.mark.parametrize("wrong", ["gap", "repeat", "start"])
def test_a_gap_is_an_error(spark, tmp_path, wrong):
    rows = some(12)
    rows = {"gap": rows[:5] + rows[6:], "repeat": rows[:6] + rows[5:], "start": rows[1:]}[wrong]
    with pytest.raises(StreamingQueryException, match="without a gap"):
        follow(spark, str(tmp_path), rows, 20)


def test_arrivals_don_t_make_batches(spark, tmp_path):
    """Metrics are of arrivals, however many a batch brings and where it cuts them."""
    rows, folder = some(103), str(tmp_path)
    best = lambda part: max([x[4] for x in part if x[5]], default=None)
    for part in (rows[:47], rows[47:]):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")
        arrivals.follow(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", 10).awaitTermination()
    assert len(list((tmp_path / "out" / "metrics").glob("batch=*"))) == 2
    status, forms = expected(rows)
    assert {r["attempt_index"]: r["status"] for r in arrivals.statuses(spark, f"{folder}/out").collect()} == status
    assert {r["canonical_hash"]: (r["attempts"], r["first_index"], r["reward"]) for r in arrivals.forms(spark, f"{folder}/out").collect()} == forms
    found = sorted(arrivals.metrics(spark, f"{folder}/out").collect(), key=lambda r: r["batch"])
    assert [r["batch"] for r in found] == [*range(11)]
    for r in found:
        part = rows[r["batch"] * 10 : r["batch"] * 10 + 10]
        sound = [x[4] for x in part if x[5]]
        assert (r["first"], r["last"], r["attempts"], r["sound"]) == (part[0][0], part[-1][0], len(part), len(sound))
        assert r["best_reward"] == best(part) and r["best_so_far"] == max(-5.0, best(rows[: r["last"] + 1]) or -5.0)
        assert r["mean_reward"] == (pytest.approx(sum(sound) / len(sound)) if sound else None)
        assert r["accepted_unique"] == sum(status[x[0]] == "accepted_unique" for x in part)
