"""Manifests, files and streams."""

import json
import time

import numpy as np
import pytest

from tensorloom.sources import manifest, tensor_files
from tensorloom.streaming.deltas import stream_deltas, window_sizes

DOC = {"abc": "a.abc", "components": [
    {"path": "o/p//.geom/P", "type": "float32_t", "samples": 3, "size": 2, "extent": 3, "bin": "o-p--.geom-P.bin"},
    {"path": "o/p//name", "type": "string", "samples": 3, "extent": 1},
    {"path": "o/q//w", "type": "64", "samples": 3, "extent": 1},
]}


@pytest.fixture()
def components(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(DOC, indent=1))
    return manifest.read(spark, f"file://{tmp_path}/m.json")


def test_manifest(components):
    rows = components.orderBy("ordinal").collect()
    assert [(r["archive"], r["mpu"], r["type"], r["size"], r["bits"]) for r in rows] == [("a.abc", 0.01, "float32_t", 2, 32), ("a.abc", 0.01, "string", 1, None), ("a.abc", 0.01, "float64_t", 1, 64)]
    assert rows[2]["bin"] == "o-q--w.bin"
    assert [r["path"] for r in manifest.numeric(components).collect()] == ["o/p//.geom/P", "o/q//w"]  # strings do not stop a manifest
    assert manifest.look_up(components, "x/o-q--w.bin").first()["path"] == "o/q//w"
    assert manifest.look_up(components, "none").count() == 0
    again = manifest.parse(manifest.to_json(components), "json")
    assert sorted(again.collect()) == sorted(components.collect())


def test_files(spark, components, tmp_path):
    x, w = np.arange(18, dtype=np.float32).reshape(3, 2, 3), np.array([1.5, 2, 2.5])
    (tmp_path / "bins").mkdir()
    rows = spark.createDataFrame([("o-p--.geom-P.bin", bytearray(x.tobytes())), ("o-q--w.bin", bytearray(w.tobytes()))], "bin string, content binary")
    tensor_files.write(rows, str(tmp_path / "bins"))
    t = tensor_files.read(spark, f"file://{tmp_path}/bins", components)
    got = {(r["series"], r["sample"], r["vertex"], r["coord"]): r["value"] for r in t.collect()}
    assert len(got) == 21 and got["o/p//.geom/P", 2, 1, 0] == 15 and got["o/q//w", 1, 0, 0] == 2
    back = {r["series"]: bytes(r["content"]) for r in tensor_files.contents(t, 32).collect()}
    assert back["o/p//.geom/P"] == x.tobytes()
    files = spark.createDataFrame([("o-p--.geom-P.bin", 72), ("o-q--w.bin", 23)], "bin string, length long")
    assert {r["path"] for r in manifest.misshapen(manifest.numeric(components), files).collect()} == {"o/q//w"}
    (tmp_path / "bins" / "o-q--w.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="5 bytes"):
        tensor_files.read(spark, f"file://{tmp_path}/bins", components).collect()


def test_difference(spark):
    row = "path string, kind string, nsamples int, constant boolean, type string, dims string, hash string"
    a = spark.createDataFrame([("p", "array", 3, False, "string", "1", "x"), ("q", "array", 1, True, "f", "1", "x"), ("r", "scalar", 1, False, "f", "1", "x")], row)
    b = spark.createDataFrame([("p", "array", 3, False, "string", "1", "y"), ("q", "array", 9, True, "f", "1", "x"), ("s", "scalar", 1, False, "f", "1", "x")], row)
    assert sorted((r["path"], r["change"]) for r in manifest.difference(a, b).collect()) == [("p", "~"), ("r", "-"), ("s", "+")]
    assert manifest.difference(a, a).count() == 0


def test_tables_are_dropped(spark):
    from tensorloom import tables

    first = tables.made()
    a, b = tables.shared_table(spark.range(3), "a"), tables.shared_table(spark.range(4), "b")
    tables.drop_between(spark, first, tables.made() - 1)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.collect()


def test_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([("a", None, "a"), ("b", "a", "b")], "id string, parent string, name string")
    assert manifest.paths(nodes).count() == 2
    with pytest.raises(ValueError):
        manifest.paths(nodes.unionByName(spark.createDataFrame([("a", "b", "a")], nodes.schema)))


def test_paths_of_any_depth(spark):
    n = 70
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None, "x") for i in range(n)], "id string, parent string, name string")
    rows = manifest.paths(chain).collect()
    assert len(rows) == n and max(r["depth"] for r in rows) == n - 1 and max(len(r["path"]) for r in rows) == 2 * n - 1


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(v, f"2024-01-01 00:0{i}:00", i, float(v + i * i)) for v in (1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vertex long, ts string, id long, value double").withColumn("ts", F.to_timestamp("ts"))
    for k in (0, 1):  # two files, so that two batches share state
        df.where(f"id div 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_deltas(source, 0.5).writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["vertex"], r["id"]): r["delta"] for r in spark.table("deltas").collect()}
    want = {}
    for v in (1, 2):
        before = 0
        for i in range(6):
            now = round((v + i * i) / 0.5)
            want[v, i], before = now - before, now
    assert got == want
    assert window_sizes(spark.table("deltas"), "5 minutes").agg(F.sum("n")).first()[0] == 12


def test_command_line(spark, tmp_path, capsys):
    from tensorloom.__main__ import main

    a, b, out = tmp_path / "a", tmp_path / "b", tmp_path / "out"
    a.mkdir()
    (a / "manifest.json").write_text(json.dumps(DOC))
    (a / "o-p--.geom-P.bin").write_bytes(b"x" * 72)
    (a / "o-q--w.bin").write_bytes(b"y" * 24)
    new = tmp_path / "new.bin"
    new.write_bytes(b"z" * 24)
    assert main(["parse", str(a)]) == 0 and capsys.readouterr().out.count("\n") == 3
    assert main(["separate", str(a), str(out), "-t", "float64_t"]) == 0 and [f.name for f in out.iterdir()] == ["o-q--w.bin"]
    assert main(["combine", str(a), str(b), "--override", "o/q//w", str(new)]) == 0
    assert (b / "o-q--w.bin").read_bytes() == b"z" * 24 and (b / "o-p--.geom-P.bin").read_bytes() == b"x" * 72
    assert main(["compare", str(a), str(a)]) == 0
    capsys.readouterr()
    assert main(["compare", str(a), str(b)]) == 1 and capsys.readouterr().out.split() == ["~", "o/q//w"]
    assert main(["compare", str(a), str(b), "-q"]) == 1 and capsys.readouterr().out == ""
    assert main(["compare", str(a), str(b), "-v"]) == 1 and capsys.readouterr().out.count("float64_t") == 2
    single = tmp_path / "single"
    assert main(["separate", str(a), str(single), "-p", "o/p//.geom/P"]) == 0 and [f.name for f in single.iterdir()] == ["o-p--.geom-P.bin"]
    assert main(["separate", str(a), str(single), "-p", "none"]) == 1
    (a / "o-q--w.bin").write_bytes(b"y")
    assert main(["separate", str(a), str(out)]) == 1
