"""Folders of map files."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from maskworks.operators import anonymize as masking
from maskworks.sources import mapfiles, mapstore

WORD = "-".join(["quiet", "harbour", "morning"])
FEW = 300


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.json").write_bytes(content if isinstance(content, bytes) else content.encode())


def test_files_of_all_kinds_are_rows(spark, tmp_path):
    mapfiles.register(spark)
    good = mapstore.export_map(spark, {"__CLS__1": "Zażółć", "__P2__": "b"}, WORD, iterations=FEW)
    file = json.loads(good)
    legacy = {k: v for k, v in json.loads(mapstore.export_map(spark, {"__VAR__1": "old"}, WORD, iterations=mapstore.LEGACY_ITERATIONS)).items() if k != "kdf"}
    hostile = mapstore.export_map(spark, {"__proto__": "x"}, WORD, iterations=FEW)
    put(
        tmp_path / "in",
        good=good, legacy=json.dumps(legacy), plain='{"__VAR__1": "a", "__VAR__2": "b"}', hostile=hostile, other=mapstore.export_map(spark, {"__VAR__1": "x"}, WORD + "s", iterations=FEW),
        rounds=json.dumps(file | {"kdf": {"name": mapstore.KDF_NAME, "iterations": 10**9}}), version=json.dumps(file | {"v": 2}), bent=json.dumps(file | {"salt": "%%"}),
        cut=good[:20], listed="[]", bytes=b"\xff\xfe", value='{"__VAR__1": 4}', empty="", deep="[" * 100_000,
        short=json.dumps(file | {"data": base64.b64encode(b"xy").decode()}),
    )
    (tmp_path / "in" / "note.txt").write_text("no map")
    files = spark.read.format("mapfiles").option("filesPerTask", 4).load(str(tmp_path / "in"))
    assert files.rdd.getNumPartitions() == 4
    rows = {r["path"].rsplit("/", 1)[1].removesuffix(".json"): r for r in mapfiles.opened(files, F.lit(WORD)).collect()}
    assert len(rows) == 15
    maps = {n: {e["placeholder"]: e["name"] for e in r["symbols"]} for n, r in rows.items() if r["error"] is None}
    assert maps == {"good": {"__CLS__1": "Zażółć", "__P2__": "b"}, "legacy": {"__VAR__1": "old"}, "plain": {"__VAR__1": "a", "__VAR__2": "b"}}
    assert [e["ord"] for e in rows["plain"]["symbols"]] == [0, 1]
    assert {n: rows[n]["kind"] for n in maps} == {"good": "encrypted", "legacy": "legacy", "plain": "plain"}
    assert "placeholder" in rows["hostile"]["error"] and "passphrase" in rows["other"]["error"] and "passphrase" in rows["short"]["error"]
    assert "iterations" in rows["rounds"]["error"] and rows["version"]["error"] == "not an encrypted map file" and "damaged" in rows["bent"]["error"]
    assert {rows[n]["error"] for n in ("cut", "empty", "deep")} == {"not JSON"} and rows["bytes"]["error"] == "not UTF-8"
    assert all(r["symbols"] is None for r in rows.values() if r["error"])
    assert mapfiles.opened(files, F.lit(None).cast("string")).where("error is null").count() == 1


def test_many_maps_out_and_back(spark, tmp_path):
    mapfiles.register(spark)
    docs = spark.range(1000).select("id", F.format_string("class Thing%d { run(other%d) {} }", "id", "id").alias("text"))
    maps = masking.anonymize(docs, language="typescript", texts=False).select(F.format_string("map %d", "id").alias("name"), "symbols")
    folder = str(tmp_path / "out")
    mapfiles.sealed(maps, F.lit(WORD), FEW).write.format("mapfiles").mode("append").save(folder)
    assert not list((tmp_path / "out").glob("*.part")) and (tmp_path / "out" / "map-7.json").is_file()
    assert mapstore.import_map(spark, (tmp_path / "out" / "map-7.json").read_text(), WORD) == {"__CLS__1": "Thing7", "__FN__1": "run", "__VAR__1": "other7"}
    back = mapfiles.opened(spark.read.format("mapfiles").load(folder), F.lit(WORD))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.json", 1), "-", " ")
    both = back.select(name.alias("name"), "error", F.col("symbols").alias("got")).join(maps, "name")
    assert both.count() == 1000 and both.where("error is not null or got <> symbols").count() == 0


def test_odd_writes(spark, tmp_path):
    mapfiles.register(spark)
    one = spark.range(1).select(F.lit("../../up").alias("name"), masking.entries_of({"__CLS__1": "A"}).alias("symbols"))
    mapfiles.sealed(one, F.lit(WORD), FEW).write.format("mapfiles").mode("append").save(str(tmp_path / "a"))
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["up.json"]
    for again in (one, one.withColumn("name", F.lit("x")).union(one.withColumn("name", F.lit("x")))):
        with pytest.raises(Exception):  # noqa: B017
            mapfiles.sealed(again, F.lit(WORD), FEW).write.format("mapfiles").mode("append").save(str(tmp_path / "a"))
        assert [p.name for p in (tmp_path / "a").iterdir()] == ["up.json"]
    for bad, word in ((one.withColumn("name", F.lit(None).cast("string")), WORD), (one, "short")):
        with pytest.raises(Exception):  # noqa: B017
            mapfiles.sealed(bad, F.lit(word), FEW).write.format("mapfiles").mode("append").save(str(tmp_path / "b"))
    assert not (tmp_path / "b").exists() or not list((tmp_path / "b").glob("*.json"))
    (tmp_path / "none").mkdir()
    assert mapfiles.opened(spark.read.format("mapfiles").load(str(tmp_path / "none")), F.lit(WORD)).collect() == []
