"""Ball k-means and vector codes against brute force and SQL, and on odd vectors."""

import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException

from barloom.llm import ballmeans, queries, segmentcodes

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v int, x int, cluster int, key string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, 0, 0, 0, "k", 0) for i, v, label in rows], SCHEMA)


def sound(v, dims=None):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and (dims is None or len(v) == dims)


def floors(v, scale):
    return [math.floor(scale * float(np.float32(c))) for c in v]


def nearest(x, among):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(among))


def means(xs, own, before):
    out = []
    for i, c in enumerate(before):
        mine = [x for x, o in zip(xs, own) if o == i]
        out.append([sum(col) // len(mine) for col in zip(*mine)] if mine else c)
    return out


def some_vectors(n=150, dims=8, seed=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.3, 0.2, 0.7]) + rng.gauss(0, 0.05) for _ in range(dims)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(40)] + [rows[3], rows[3]]  # copies, and repeated rows
    rows += [(500, None, 1), (501, [], 1), (502, [0.1] * (dims - 1) + [None], 1), (503, [math.nan] * dims, 2), (504, [math.inf] * dims, 2), (505, [0.1] * (dims + 1), 3), (None, [0.5] * dims, 1)]
    rng.shuffle(rows)
    return rows


def balls_by_force(rows, k, rounds, scale, dims):
    kept = [(i, floors(v, scale)) for i, v, _ in rows if sound(v, dims)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [x for _, x in order[:k]]
    xs = [x for _, x in kept]
    for _ in range(rounds):
        centroids = means(xs, [nearest(x, centroids)[1] for x in xs], centroids)
    found = [nearest(x, centroids) for x in xs]
    inertia = [sum(d for d, c in found if c == i) for i in range(len(centroids))]
    seals = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if i is None else i), c, d, inertia[c], sum(inertia), seals[c]) for (i, _), (d, c) in zip(kept, found))


@pytest.mark.parametrize("k", [1, 7, 40, 1000])
def test_balls_equal_brute_force(spark, k):
    rows = some_vectors()
    found = ballmeans.clusters(vectors(spark, rows).repartition(3), k, 3, dims=8).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == balls_by_force(rows, k, 3, 256, 8)


def test_balls_compare_few_centroids_and_none_in_the_core():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-1000, 1000, (30, 4))
    x = centroids[rng.integers(0, 30, 400)] + rng.integers(-80, 80, (400, 4))
    own = ((x[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
    far = [math.sqrt(((x[own == i] - centroids[i]) ** 2).sum(axis=1).max(initial=0)) for i in range(30)]
    balls = ballmeans.Balls(centroids, far)
    assert sum(map(len, balls.near)) < 30 * 29 / 3  # most centroids are no neighbours
    wrong = rng.permutation(own)  # from any ball whose radius holds its members the nearest is found
    far = [math.sqrt(((x[wrong == i] - centroids[i]) ** 2).sum(axis=1).max(initial=0)) for i in range(30)]
    for start, radii in ((own, balls), (wrong, ballmeans.Balls(centroids, far))):
        cluster, distance = radii.assign(x, start)
        assert (cluster == own).all() and (distance == ((x - centroids[own]) ** 2).sum(axis=1)).all()


def test_large_components_stay_exact():
    top = ballmeans.widest(3)
    x = np.array([[top, -top, top], [-top, top, -top], [top, -top, top - 1]])
    cluster, distance = ballmeans.Balls(x[:2], [float("inf")] * 2).assign(x, np.zeros(3, np.int64))
    assert cluster.tolist() == [0, 1, 0] and distance.tolist() == [0, 0, 1]


def test_too_large_components_raise(spark):
    with pytest.raises(PySparkException, match="beyond"):
        ballmeans.clusters(vectors(spark, [(1, [3e38] * 8, 1)]), 2, 1, dims=8).collect()


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan] * 8, 1)]):
        assert ballmeans.clusters(vectors(spark, rows), 3, 2, dims=8).collect() == []
        assert segmentcodes.codes(vectors(spark, rows), 2, 4, 2).collect() == []


def codes_by_force(rows, parts, entries, rounds, scale, dims):
    kept = [(i, floors(v, scale), label) for i, v, label in rows if sound(v)]
    same = sorted((r for r in kept if len(r[1]) == dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dims // parts
    cut = [[x[p * w : (p + 1) * w] for _, x, _ in same] for p in range(parts)]
    books = [c[:entries] for c in cut]
    for _ in range(rounds):
        books = [means(c, [nearest(x, b)[1] for x in c], b) for c, b in zip(cut, books)]
    found = [[nearest(x, b) for x in c] for c, b in zip(cut, books)]
    out = [(i, "".join(f"{found[p][k][1]:02x}" for p in range(parts)), sum(found[p][k][0] for p in range(parts)), label) for k, (i, _, label) in enumerate(same)]
    out += [(i, None, None, label) for i, x, label in kept if len(x) != dims]
    seal = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {label: [r[2] for r in out if r[3] == label and r[2] is not None] for *_, label in out}
    return sorted((-1 if i is None else i, str(code), str(error), str(sum(total[label]) if total[label] else None), seal) for i, code, error, label in out)


@pytest.mark.parametrize(("parts", "entries"), [(2, 16), (4, 3), (8, 5), (1, 200)])
def test_codes_equal_brute_force(spark, parts, entries):
    rows = some_vectors(seed=parts)
    found = segmentcodes.codes(vectors(spark, rows).repartition(3), parts, entries, 3).collect()
    assert sorted((-1 if r[0] is None else r[0], str(r[1]), str(r[2]), str(r[3]), r[4]) for r in found) == codes_by_force(rows, parts, entries, 3, 4096, 8)


def test_bounds_spare_exact_distances_and_lose_none():
    rng = np.random.default_rng(8)
    entries = rng.integers(-3000, 3000, (64, 1)) + rng.integers(-200, 200, (64, 16))
    x = entries[rng.integers(0, 64, 500)] + rng.integers(-50, 50, (500, 16))
    x[:20] = (entries[1] + entries[2]) // 2
    code, distance, tried = segmentcodes.Codebook(entries).nearest(x)
    every = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert tried < every.size / 4


def test_ties_go_to_the_lower_entry():
    entries = np.array([[5, 5], [0, 0], [0, 0], [2, 0]])
    assert segmentcodes.Codebook(entries).nearest(np.array([[0, 0], [1, 0], [5, 5]]))[0].tolist() == [1, 1, 0]


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_codes", "op13_quality_rules"])
def test_query_equals_sql(spark, name):
    data = Path("/root/testdata/sf0.01")
    db = duckdb.connect()
    for path in data.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = queries.queries()[name](spark, str(data))
    names = sorted(found.columns)
    answer = db.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in answer.description].index(n) for n in names]
    assert sorted(str([row[i] for i in at]) for row in answer.fetchall()) == sorted(str([row[n] for n in names]) for row in found.collect())
