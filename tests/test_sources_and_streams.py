"""Map store, encrypted files, streaming."""

import json
import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskworks.operators import anonymize as masking
from maskworks.operators import restore
from maskworks.sources import mapstore
from maskworks.streaming import session
from maskworks.streaming.session import mask_stream

WORD = "-".join(["quiet", "harbour", "morning"])


def test_store_saves_lists_and_deletes(spark, tmp_path):
    store = mapstore.MapStore(spark, str(tmp_path / "maps"))
    assert store.load().count() == 0
    one = spark.range(1).select(masking.entries_of({"__CLS__1": "A"}).alias("symbols"))
    store.save("first ", one)
    store.save("second", one)
    rows = store.load().collect()
    assert [r["name"] for r in rows] == ["second", "first"] and rows[0]["identifier_count"] == 1
    store.delete(rows[0]["id"])
    assert [r["name"] for r in store.recent().collect()] == ["first"] and store.get(rows[0]["id"]).count() == 0
    with pytest.raises(ValueError):
        store.save("  ", one)
    assert mapstore.file_name("a  b\tc") == "a-b-c"


def test_store_reads_one_bucket_and_lets_writers_meet(spark, tmp_path):
    store = mapstore.MapStore(spark, str(tmp_path / "maps"))
    one = spark.range(1).select(masking.entries_of({"__CLS__1": "A"}).alias("symbols"))
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda i: store.save(f"map {i}", one), range(12)))
        list(pool.map(lambda i: store.delete(ids[i]) if i < 6 else store.save(f"late {i}", one), range(12)))
    store.delete("no such map")
    assert sorted(r["name"] for r in store.load().collect()) == sorted([f"map {i}" for i in range(6, 12)] + [f"late {i}" for i in range(6, 12)])
    got = store.get(ids[7])
    assert [r["name"] for r in got.collect()] == ["map 7"] and store.get(ids[0]).count() == 0 and store.get("no such map").count() == 0
    assert {f"bucket={mapstore.bucket_of(ids[7])}"} == {p.split("/maps/")[1].split("/")[0] for p in got.inputFiles()}
    bad = next((tmp_path / "maps" / f"bucket={mapstore.bucket_of(ids[7])}").glob("*/*.parquet"))
    bad.with_name(f".{bad.name}.crc").unlink(missing_ok=True)
    bad.write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        store.load().collect()
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        store.get(ids[7]).collect()


def test_texts_are_whole_files_that_are_not_blank(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text(" \n\t")
    (tmp_path / "c.txt").write_text("")
    assert [(r["path"].rsplit("/", 1)[1], r["text"]) for r in mapstore.read_texts(spark, str(tmp_path)).collect()] == [("a.txt", "one\ntwo\n")]


def test_encrypted_files(spark):
    symbols = {"__CLS__1": "Zażółć", "__P2__": "b"}
    content = mapstore.export_map(spark, symbols, WORD, iterations=500)
    assert mapstore.import_map(spark, content, WORD) == symbols and "Za" not in content
    with pytest.raises(ValueError):
        mapstore.import_map(spark, content, "another-passphrase")
    file = json.loads(content)
    for change in ({"v": 2}, {"alg": "x"}, {"kdf": {"name": "x", "iterations": 1}}, {"kdf": {"name": mapstore.KDF_NAME, "iterations": 10**9}}, {"kdf": {"name": mapstore.KDF_NAME, "iterations": 1.5}}):
        with pytest.raises(ValueError):
            mapstore.import_map(spark, json.dumps(file | change), WORD)
    assert mapstore.kdf_iterations(None) == 100_000


@pytest.mark.parametrize("bad", ["short", " " * 12, "a" * 12, "abcdefghijklm", "mlkjihgfedcba", "Password1234", "1234567890"])
def test_weak_passphrases(bad):
    with pytest.raises(mapstore.WeakPassphraseError):
        mapstore.check_passphrase(bad)


@pytest.mark.parametrize("bad", [[], None, 3, {"__proto__": "x"}, {"__CLS__1": 4}, {"__CLS__1": "x" * 10_001}, {f"__CLS__{i}": "x" for i in range(50_001)}])
def test_hostile_maps(bad):
    with pytest.raises(mapstore.InvalidMapError):
        mapstore.parse_symbols(bad)


def test_stream_shares_a_growing_map(spark, tmp_path):
    source, out, maps = (str(tmp_path / x) for x in ("in", "out", "maps"))
    make = lambda rows, n: spark.createDataFrame(rows, "id int, scope string, text string").coalesce(1).write.parquet(f"{source}/{n}")
    stream = lambda: spark.readStream.schema("id int, scope string, text string").parquet(f"{source}/*")
    make([(1, "s", "class AlphaOne {}"), (2, "t", "class BetaTwo {}"), (3, "s", "new GammaThree(AlphaOne)")], 1)
    mask_stream(stream(), "scope", "text", out, maps, str(tmp_path / "c")).awaitTermination()
    make([(4, "s", "new GammaThree(); new DeltaFour(); class AlphaOne {}"), (5, "t", "new AlphaOne()")], 2)
    mask_stream(stream(), "scope", "text", out, maps, str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(out)
    back = restore.restore(rows, "anonymized", strip="none")
    assert back.where("restored <> text").count() == 0 and rows.count() == 5
    entries = rows.select("scope", F.explode("symbols").alias("e")).select("scope", "e.placeholder", "e.name").distinct()
    assert entries.groupBy("scope", "name").count().where("count > 1").count() == 0
    assert entries.groupBy("scope", "placeholder").count().where("count > 1").count() == 0


def _write(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")


def _fold(spark, rows):
    """The rows of each scope masked one after another with a growing map, in the order of their places."""
    out, maps = {}, {}
    for number, scope, text, clears in rows:
        if clears:
            maps[scope] = {}
        docs = spark.createDataFrame([(text,)], "text string").withColumn("kept", masking.entries_of(maps.get(scope, {})))
        r = masking.anonymize(docs, known="kept", language="typescript").first()
        maps[scope] = {e["placeholder"]: e["name"] for e in r["symbols"]}
        out[number] = r["anonymized"]
    return out, maps


def test_stream_equals_a_fold_with_null_scopes_clears_and_restarts(spark, tmp_path):
    schema = "id long, scope string, text string, wipes boolean"
    batches = [
        [(1, "s", "class AlphaOne { barName() {} }", False), (2, None, "let barName = AlphaTwo;", None), (3, "s", "new GammaThree(AlphaOne)", False), (4, "t", None, False)],
        [(5, None, "let zedLongerName = barName;", False), (6, "s", "class __CLS__7 {} new DeltaFour(); class AlphaOne {}", False), (7, "t", "x", False)],
        [(8, "s", "new LastOne(DeltaFour, barName)", False), (9, None, "AlphaTwo(zedLongerName)", True), (10, None, "AlphaTwo(barName)", False), (11, "t", "new AlphaOne()", False)],
    ]
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    for n, rows in enumerate(batches):
        _write(spark, tmp_path / "in", n, rows, schema)
        # Each batch is a run of its own, which goes on from the checkpoint.
        mask_stream(stream(), "scope", "text", str(tmp_path / "out"), str(tmp_path / "maps"), str(tmp_path / "c"), place="id", clears="wipes", language="typescript").awaitTermination()
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, maps = _fold(spark, [r for rows in batches for r in rows])
    assert {k: r["anonymized"] for k, r in got.items()} == want and got[4]["symbols"] == []
    assert {r["epoch"] for k, r in got.items() if k not in (9, 10)} == {0} and got[9]["epoch"] == got[10]["epoch"] == 1
    held = {}
    for r in session.entries_at(spark, str(tmp_path / "maps")).collect():
        held.setdefault((r["scope"], r["epoch"]), {})[r["placeholder"]] = r["name"]
    assert held[None, 1] == maps[None] and held["s", 0] == maps["s"] and set(held[None, 0].values()) == {"barName", "AlphaTwo", "zedLongerName"}

    # Replies, late ones to the first epoch included, are restored with the map of their time.
    replies = [(1, None, 0, "say __VAR__1 and __FN__1 __VAR__9 x__VAR__1"), (2, None, 1, "say __FN__1(__VAR__1)"), (3, "s", 0, "__CLS__1; __REDACTED_JWT_1__"), (4, "none", 0, "__CLS__1"), (5, "s", 0, None), (6, "s", None, "__CLS__1")]
    _write(spark, tmp_path / "replies", 0, replies, "id long, scope string, epoch int, text string")
    back = spark.readStream.schema("id long, scope string, epoch int, text string").parquet(f"{tmp_path}/replies/*")
    session.restore_stream(back, "scope", "text", str(tmp_path / "maps"), str(tmp_path / "back"), str(tmp_path / "c2"), epoch="epoch").awaitTermination()
    out = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "back")).collect()}

    def plain(scope, epoch, text):
        found = held.get((scope, epoch), {})
        return re.sub(r"(?<!\w)__[A-Z][A-Z0-9_]*__[0-9]*(?!\w)", lambda m: found.get(m[0], m[0]), text)

    for i, scope, epoch, text in replies:
        assert out[i]["restored"] == (None if text is None else plain(scope, epoch, text)), i
    assert out[1]["resolved"] and "__VAR__9" in out[1]["unresolved"] and out[3]["unresolved"] == [] and out[4]["unresolved"] == ["__CLS__1"]
    late = session.restored(spark.createDataFrame([(None, "__VAR__1 __VAR__1")] * 2, "scope string, text string"), session.entries_at(spark, str(tmp_path / "maps")), "scope")
    assert [r["restored"] for r in late.collect()] == [" ".join([held[None, 1].get("__VAR__1", held[None, 0].get("__VAR__1"))] * 2)] * 2


def test_stream_reads_nothing_from_before_its_batch(spark, tmp_path):
    schema = "id int, scope string, text string"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    run = lambda: mask_stream(stream(), "scope", "text", str(tmp_path / "out"), str(tmp_path / "maps"), str(tmp_path / "c")).awaitTermination()
    _write(spark, tmp_path / "in", 1, [(1, "s", "class AlphaOne {}")], schema)
    run()
    for old in ("out", "maps"):
        (tmp_path / old).rename(tmp_path / f"gone-{old}")
    _write(spark, tmp_path / "in", 2, [(2, "s", "new AlphaOne(new BetaTwo())")], schema)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).first()["anonymized"] == "new __CLS__1(new __CLS__2())"


def test_idle_scope_is_cleared(spark, tmp_path):
    schema = "id int, scope string, text string, at timestamp"
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    for n, minutes in enumerate((0, 5, 30)):
        _write(spark, tmp_path / "in", n, [(n, "s", f"class AlphaOne {{}} class Only{n}{'x' * n} {{}}", at(minutes)), (10 + n, "t", "class AlphaOne {}", at(9 * n))], schema)
        docs = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        mask_stream(docs, "scope", "text", str(tmp_path / "out"), str(tmp_path / "maps"), str(tmp_path / "c"), idle=timedelta(minutes=10), at="at", place="id").awaitTermination()
    rows = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [rows[i]["epoch"] for i in (0, 1, 2, 10, 11, 12)] == [0, 0, 1, 0, 0, 0]
    assert rows[1]["anonymized"].startswith("class __CLS__1 {} class __CLS__3") and rows[2]["anonymized"] == "class __CLS__1 {} class __CLS__2 {}"


def test_entries_that_cannot_be_read_fail(spark, tmp_path):
    maps = tmp_path / "maps" / "part=0" / "bucket=1"
    maps.mkdir(parents=True)
    (maps / "part-0.parquet").write_bytes(b"no parquet file")
    assert session.entries_at(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)parquet"):
        session.entries_at(spark, str(tmp_path / "maps")).collect()
