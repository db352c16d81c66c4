import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillwork.functions.contracts import canonical
from quillwork.sources import readers, sinks, store


def test_jsonl_splits_at_newline_alone(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t":"a b\u0085c d"}\n{"t":"e"}\n', encoding="utf-8")
    assert [r.t for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "t string").collect()] == ["a b\u0085c d", "e"]


def test_envelopes(spark, tmp_path):
    payload = {"b": 1, "a": "é"}
    good = {"payload": payload, "sha256": hashlib.sha256(canonical(payload).encode()).hexdigest()}
    (tmp_path / "x.json").write_text(json.dumps(good))
    (tmp_path / "y.json").write_text(json.dumps(good | {"payload": {"b": 2}}))
    got = {r.file[-6:]: r.intact for r in readers.envelopes(spark, f"{tmp_path}/*.json").collect()}
    assert got == {"x.json": True, "y.json": False}
    bare = spark.createDataFrame([('{"payload":{"k":1}}',), ('{"k":1}',)], "v string").select(readers.unwrapped(F.col("v")).alias("v"))
    assert {r.v for r in bare.collect()} == {'{"k":1}'}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"c']), (2, [])], "i int, l array<string>")
    sinks.flat_export(df, f"{tmp_path}/e")
    got = readers.strings_csv(spark, f"{tmp_path}/e", ["i", "l"]).orderBy("i").collect()
    assert [(r.i, json.loads(r.l)) for r in got] == [("1", ["a", 'b"c']), ("2", [])]


def test_feed_counts_are_checked(spark, tmp_path):
    for n, name in ((2, "good"), (3, "bad")):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump({"totalResults": n, "vulnerabilities": [{"id": "a"}, {"id": "b"}]}, f)
    assert readers.feed(spark, f"{tmp_path}/good.json.gz", "struct<id:string>").select("item.id").count() == 2
    with pytest.raises(Exception, match="feed count differs"):
        readers.feed(spark, f"{tmp_path}/bad.json.gz", "struct<id:string>").collect()


def test_metadata_and_digests(spark, tmp_path):
    got = spark.createDataFrame([("size:10\r\nsha256:AB\r\n",)], "t string").select(readers.metadata(F.col("t"))).first()[0]
    assert got == {"size": "10", "sha256": "AB"}
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert readers.digests(spark, f"{tmp_path}/f.bin").first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_write_once_and_sections(spark, tmp_path):
    df = spark.range(3)
    sinks.write_once(df, f"{tmp_path}/w")
    with pytest.raises(Exception):
        sinks.write_once(df, f"{tmp_path}/w")
    sinks.append_section(df, f"{tmp_path}/s", "a")
    sinks.append_section(df, f"{tmp_path}/s", "b")
    assert spark.read.parquet(f"{tmp_path}/s").where("section = 'b'").count() == 3
    with pytest.raises(Exception):
        sinks.append_section(df, f"{tmp_path}/s", "a")
    assert sinks.markdown(df, "T").splitlines()[2:5] == ["| id |", "|---|", "| 0 |"]
    with pytest.raises(ValueError):
        sinks.markdown(df, "T", most=2)
    assert sinks.content_path("/x", "a", "b") == f"/x/{hashlib.sha256(b'a/b').hexdigest()}"


def test_records_whose_digest_differs_stop_the_query(spark, tmp_path):
    for name, payload in (("a", {"k": 1}), ("b", {"k": 2})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"payload": payload, "sha256": hashlib.sha256(canonical(payload).encode()).hexdigest()}))
    assert sorted(r.k for r in store.records(spark, f"{tmp_path}/*.json", "k int").collect()) == [1, 2]
    (tmp_path / "c.json").write_text(json.dumps({"payload": {"k": 3}, "sha256": "0" * 64}))
    with pytest.raises(Exception, match="digest differs"):
        store.records(spark, f"{tmp_path}/*.json", "k int").collect()


def test_put_is_once(spark, tmp_path):
    df = spark.range(5)
    assert store.put(df, f"{tmp_path}/p") and not store.put(df.orderBy(F.desc("id")), f"{tmp_path}/p")
    with pytest.raises(ValueError):
        store.put(spark.range(6), f"{tmp_path}/p")


def test_manifests_are_checked_before_rows_are_given_out(spark, tmp_path):
    rows = []
    for name in ("x.jsonl", "y.jsonl", "beside.jsonl"):
        text = "".join(json.dumps({"k": i, "s": name}) + "\n" for i in range(3))
        (tmp_path / name).write_text(text)
        rows.append((name, hashlib.sha256(text.encode()).hexdigest(), 3))
    good = spark.createDataFrame(rows[:2], store.MANIFEST)
    assert store.verified_lines(spark, str(tmp_path), good, "k int, s string").count() == 6
    assert store.verified_lines(spark, str(tmp_path), good.limit(0), "k int, s string").isEmpty()
    for wrong in ([(rows[0][0], "0" * 64, 3)], [(rows[0][0], rows[0][1], 4)]):
        with pytest.raises(ValueError, match="x.jsonl"):
            store.verified_lines(spark, str(tmp_path), spark.createDataFrame(wrong, store.MANIFEST), "k int, s string")


def test_profiles_are_restored_by_reference(spark):
    advisories = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "id string, v int")
    profiles = spark.createDataFrame([(1, ["B", "A", "B"]), (2, []), (3, ["C"])], "profile_id int, advisories array<string>")
    got = {r.profile_id: [(a.id, a.v) for a in r.advisories] for r in store.restored(profiles, advisories).collect()}
    assert got == {1: [("B", 2), ("A", 1), ("B", 2)], 2: [], 3: [("C", 3)]}
    with pytest.raises(Exception, match="no advisory Z"):
        store.restored(spark.createDataFrame([(1, ["Z"])], "profile_id int, advisories array<string>"), advisories).collect()


def test_a_panel_has_its_stated_size(spark):
    cells = spark.createDataFrame([(1, "a"), (1, "b")], "p int, c string")
    assert store.panel(cells, 2, ["p", "c"]).count() == 2
    for n, unique in ((3, ["p", "c"]), (2, ["p"])):
        with pytest.raises(ValueError):
            store.panel(cells, n, unique)


def test_scratch_goes(spark, tmp_path):
    """Folders of the engine are deleted together, others are left alone."""
    from quillwork.operators import lineage

    before = list(lineage._own)
    lineage._own.clear()
    try:
        path = lineage.scratch(spark, "test")
        spark.range(3).write.parquet(path)
        spark.range(3).write.parquet(f"{tmp_path}/kept")
        assert spark.read.parquet(path).count() == 3
        lineage.drop_scratch()
        assert not os.path.exists(path) and os.path.exists(f"{tmp_path}/kept") and not lineage._own
    finally:
        lineage._own.extend(before)


def test_evaluation_folders(spark, tmp_path):
    """Two sections of one run: an item that both scored counts once, and a difference is seen."""
    from quillwork.functions.contracts import canonical

    def put(section, name, key, prediction, damaged=False):
        payload = {"key": key, "prompt_sha256": "p1", "row": {"profile_id": key.rsplit("/", 1)[1], "prediction": prediction, "valid": True}}
        (tmp_path / section / "evaluations").mkdir(parents=True, exist_ok=True)
        digest = "0" if damaged else hashlib.sha256(canonical(payload).encode()).hexdigest()
        (tmp_path / section / "evaluations" / name).write_text(json.dumps({"payload": payload, "sha256": digest}))

    put("campaign", "a.json", "sealed/org/model:1/test/x/item_1", ["b", "a"])
    put("campaign", "b.json", "sealed/org/model:1/validation/x/item_1", [])
    put("campaign", "c.json", "main/org/model:1/T1/R1/r0/incumbent/item_1", [])
    put("campaign", "d.json", "sealed/org/model:1/test/x/item_2", ["c"])
    put("extension", "a.json", "sealed/org/model:1/test/x/item_1", ["b", "a"])
    put("extension", "b.json", "sealed/org/model:1/test/x/item_2", ["d"])
    rows = readers.evaluations(spark, str(tmp_path), ["campaign", "extension"])
    assert sorted((r.section, r.executor, r.prompt, r.item) for r in rows.collect()) == [(s, "org/model:1", "p1", i) for s in ("campaign", "extension") for i in ("item_1", "item_2")]
    assert {r.item: (r.row.prediction, r.same) for r in readers.once_scored(rows).collect()} == {"item_1": (["b", "a"], True), "item_2": (["c"], False)}
    put("campaign", "e.json", "sealed/org/model:1/test/x/item_3", [], damaged=True)
    with pytest.raises(Exception, match="a damaged envelope"):
        readers.evaluations(spark, str(tmp_path), ["campaign", "extension"]).collect()
