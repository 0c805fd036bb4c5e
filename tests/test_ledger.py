"""The binary ledger, manifests and canonical JSON lines."""

import hashlib
import json

import pytest

from barloom.sources import ledger, manifest, storage


def rows(spark, first, n):
    one = lambda i: (i, 3, 8 if i % 2 else 2, [i % 27, 5], f"{i:064x}", f"{i + 1:064x}" if i % 2 else None, i / 8 if i % 2 else None, -5.0, 0.5, None)
    return spark.createDataFrame([one(i) for i in range(first, first + n)], ledger.SCHEMA)


def shown(df):
    return sorted(map(tuple, df.collect()))


def test_a_ledger_round_trip(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    ledger.write(rows(spark, 0, 500).repartition(4), path)
    ledger.write(rows(spark, 500, 100), path, append=True)
    want = shown(rows(spark, 0, 600))
    assert want[0][4] == "0" * 64
    want[0] = (*want[0][:4], None, *want[0][5:])  # a hash of zeros stands for none
    assert shown(ledger.read(spark, path)) == want
    data = b"".join(open(f, "rb").read() for f, _ in ledger.parts(path))
    assert len(data) == 600 * 109
    for n in (None, 0, 1, 250, 600):
        assert ledger.prefix_digest(path, n) == hashlib.sha256(data[: (600 if n is None else n) * 109]).hexdigest()
    ledger.truncate(path, 450)
    assert shown(ledger.read(spark, path)) == want[:450] and ledger.prefix_digest(path) == hashlib.sha256(data[: 450 * 109]).hexdigest()
    monkeypatch.setattr(ledger, "SPLIT", 64)
    assert len(ledger._Reader(path).partitions()) >= 450 / 64
    with pytest.raises(ValueError, match="outside"):
        ledger.truncate(path, 451)


def test_a_ledger_has_no_gaps(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.write(rows(spark, 0, 10), path)
    for wrong in (rows(spark, 11, 5), rows(spark, 0, 5), rows(spark, 10, 4).unionByName(rows(spark, 15, 2))):
        with pytest.raises(Exception, match="follows"):
            ledger.write(wrong, path, append=True)
        assert ledger.read(spark, path).count() == 10
    with pytest.raises(Exception, match="open status"):
        ledger.write(rows(spark, 10, 2).withColumn("status", ledger.F.lit(0)), path, append=True)


def test_half_a_record_is_an_error(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.write(rows(spark, 0, 10), path)
    (file, _), *_ = ledger.parts(path)
    with open(file, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="inside a record"):
        ledger.read(spark, path).count()


def test_attempts_as_json(spark):
    (line,) = [r["value"] for r in ledger.to_json(rows(spark, 1, 1)).collect()]
    assert [*json.loads(line)] == sorted(json.loads(line)) and json.loads(line)["finite_std"] is None and ": " not in line


def test_manifest_names_every_change(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2"), ("sub/c", "3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    before = storage.kept(manifest.files(spark, str(tmp_path)))
    assert {(r["path"], r["size_bytes"], r["sha256"]) for r in before.collect()} == {(n, 1, hashlib.sha256(t).hexdigest()) for n, t in (("a", b"1"), ("b", b"2"), ("sub/c", b"3"))}
    assert manifest.differences(before, manifest.files(spark, str(tmp_path))).collect() == []
    (tmp_path / "a").unlink()
    (tmp_path / "b").write_text("5")
    (tmp_path / "sub/d").write_text("4")
    found = manifest.differences(before, manifest.files(spark, str(tmp_path)))
    assert {(r["path"], r["change"]) for r in found.collect()} == {("a", "missing"), ("b", "changed"), ("sub/d", "extra")}


def test_canonical_lines_are_written_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    df = spark.createDataFrame([(i, None if i % 3 else f"ü{i}") for i in range(50)], "k int, a string")
    assert storage.write_canonical_jsonl(df.repartition(7), path, ["k"])
    first = {f.name: f.read_bytes() for f in (tmp_path / "lines").glob("part-*")}
    assert not storage.write_canonical_jsonl(df.repartition(2), path, ["k"])  # equal rows in another order
    assert {f.name: f.read_bytes() for f in (tmp_path / "lines").glob("part-*")} == first
    lines = b"".join(first[n] for n in sorted(first)).decode().splitlines()
    assert [json.loads(x) for x in lines] == [{"a": None if i % 3 else f"ü{i}", "k": i} for i in range(50)] and lines[1] == '{"a":null,"k":1}'
    assert storage.write_canonical_jsonl(df.where("k < 40"), path, ["k"])


def test_parquet_sink_replaces_what_it_has(spark, tmp_path):
    path = str(tmp_path / "p")
    storage.write_parquet(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    storage.write_parquet(spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    storage.write_parquet(spark.createDataFrame([(9, "z")], "k int, v string"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(9, "z")]
