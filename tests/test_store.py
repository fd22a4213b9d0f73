"""The store, its files and streams, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.model import OPERATION
from palimpsest.operators import forest, history
from palimpsest.sources import files, jsonl
from palimpsest.store import Store, StoreError
from palimpsest.streaming import fold

from test_history import random_log

LINES = [
    {"thread_id": "t", "checkpoint_id": "root", "checkpoint_no": 0, "parent_checkpoint_id": None, "messages": [{"role": "user", "content": "é"}]},
    {"thread_id": "t", "checkpoint_id": "a", "checkpoint_no": 1, "parent_checkpoint_id": "root", "messages": ["x", 2.0]},
    {"thread_id": "t", "checkpoint_id": "b", "checkpoint_no": 1, "parent_checkpoint_id": "root", "messages": [None]},
    {"thread_id": "t", "checkpoint_id": "a1", "checkpoint_no": 3, "parent_checkpoint_id": "a", "messages": [{"k": [1]}]},
    {"thread_id": "u", "checkpoint_id": "root", "checkpoint_no": 0, "messages": [True]},
]


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    s = Store(spark, f"{d}/s")
    assert s.import_jsonl(write(d / "in.jsonl", LINES)) == {"checkpoint_count": 5, "message_value_count": 6, "stopped_at": None, "error": None, "failures": 0}
    return s


def test_reads(store):
    assert store.get("t", "a1") == '{"messages":[{"role":"user","content":"é"},"x",2.0,{"k":[1]}]}'
    assert store.read_range("t", "a1", 13, 6) == store.get("t", "a1").encode()[13:19]
    for args, kind in ((("t", "zz"), "NotFound"),):
        with pytest.raises(StoreError) as e:
            store.get(*args)
        assert e.value.kind == kind
    with pytest.raises(StoreError):
        store.read_range("t", "a1", 0, 10_000)
    g = store.geometry().first()
    assert (g["thread_count"], g["root_count"], g["leaf_count"], g["branch_point_count"], g["maximum_fanout"], g["maximum_depth"]) == (2, 2, 3, 1, 2, 3)
    assert "palimpsest_checkpoints 5" in store.metrics_text()
    assert [r["checkpoint_id"] for r in store.list(2).collect()] == ["a1", "root"]


def test_writes(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.put("t", "root", 0, None, ['"m"'])
    s.put("t", "c", 1, "root", ['"n"', "1"])
    for args, kind in ((("t", "c", 2, None, ["1"]), "Conflict"), (("t", "d", 2, "no", ["1"]), "NotFound"), (("t", "e", 2, None, []), "Invalid")):
        with pytest.raises(StoreError) as e:
            s.put(*args)
        assert e.value.kind == kind
    assert s.seal() == 1
    s.put("t", "d", 2, "c", ["2"])
    assert s.stats()["hot_checkpoints"] == 1 and s.get("t", "d") == '{"messages":["m","n",1,2]}'
    report = s.fsck()
    assert report.pop("hot_physical_bytes") > 0 and report.pop("sealed_segment_count") > 0
    assert report == {
        "format_version": 1, "store_id": None, "sealed_generation": 1, "checkpoint_count": 3, "version_count": 6, "hot_logical_bytes": 1, "trailing_nonzero_bytes": 0,
        "repeated_ids": 0, "failures": 0, "missing_parents": 0, "later_parents": 0}
    s.export(f"{tmp_path}/out")
    other = Store(spark, f"{tmp_path}/other")
    assert other.import_export(f"{tmp_path}/out") == 3 and other.get("t", "d") == s.get("t", "d")
    assert s.prune("t", "c") == 2 and s.status("t", "d") == "Deleted"
    with pytest.raises(StoreError) as e:
        s.put("t", "c", 1, "root", ["1"])
    assert e.value.kind == "Deleted"
    assert s.seal() == 2 and s.stats()["checkpoints"] == 1 and s.reclaim()


def refused(kind, f, *args, **more):
    with pytest.raises(StoreError) as e:
        f(*args, **more)
    return e.value.kind == kind


def test_channels(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.put("t", "i", 0, None, [], identity='{"a":"1"}')
    s.put("t", "j", 1, "i", [], identity="7", result='"done"')
    s.put("u", "m", 0, None, ['"x"'], result="[1]")
    s.put("u", "n", 1, "m", ['"y"'])
    want = {"i": '{"identity":{"a":"1"},"messages":[]}', "j": '{"identity":7,"messages":[],"result":"done"}', "m": '{"identity":null,"messages":["x"],"result":[1]}', "n": '{"messages":["x","y"]}'}
    assert {r["checkpoint_id"]: r["state"] for r in s.states().collect()} == want
    assert refused("Invalid", s.put, "t", "k", 2, "i", ['"m"']) and refused("Invalid", s.put, "t", "k", 2, None, ['"m"'], identity="1")
    assert s.verify() == {"checked": 4, "failures": 0}
    s.seal()
    s.export(f"{tmp_path}/out")
    other = Store(spark, f"{tmp_path}/other")
    assert other.import_export(f"{tmp_path}/out") == 4 and {r["checkpoint_id"]: r["state"] for r in other.states().collect()} == want


def test_requests_and_bounds(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    s.put("t", "a", 0, None, ['"m"'], request_id="r")
    s.put("t", "a", 0, None, ['"m"'], request_id="r")  # delivered again
    assert s.rows().count() == 1 and refused("RequestConflict", s.put, "t", "a", 0, None, ['"n"'], request_id="r")
    assert refused("Precondition", s.seal_through, 0) and s.seal_through(1) == 1 == s.seal_through(1)
    s.put("t", "a", 0, None, ['"m"'], request_id="r")  # known after a seal
    more = lambda i, text: spark.createDataFrame([("t", i, 1, "a", [text])], "thread_id string, checkpoint_id string, checkpoint_no long, parent_checkpoint_id string, messages array<string>")
    assert [s.append_bounded(more(f"b{i}", '"12345678"'), 25, 30) for i in range(4)] == [False, False, True, False]
    assert refused("TooLarge", s.append_bounded, more("c", '"' + "x" * 40 + '"'), 25, 30) and refused("Invalid", s.append_bounded, more("c", "1"), 30, 25)
    assert s.generation() == 2 and s.rows().count() == 5
    with s.reading():
        assert refused("Precondition", s.reclaim)
    assert s.reclaim()
    s.prune("t", "a")
    s.seal()
    assert refused("Deleted", s.put, "t", "a", 0, None, ['"m"'], request_id="r")
    assert [tuple(r) for r in s.sorted_tombstones().orderBy("pos").collect()] == [(i, "t", c) for i, c in enumerate(["a", "b0", "b1", "b2", "b3"])]
    text = s.metrics_text()
    assert text.count("# TYPE") == 25 and "palimpsest_durable_appends_total 5\n" in text and "palimpsest_versions 0\n" in text


@pytest.mark.parametrize("bad, error", [
    ("{nope", "invalid JSON"), ("[1]", "checkpoint body must be a JSON object"), (LINES[1] | {"x": 1}, "unknown field x"), (LINES[1] | {"messages": []}, "messages must contain at least one newly appended value"),
    (LINES[1] | {"messages": 3}, "messages must be a JSON array"), (LINES[1] | {"thread_id": ""}, "thread_id must be a non-empty string"), (LINES[1] | {"checkpoint_id": 7}, "checkpoint_id must be a non-empty string"),
    (LINES[1] | {"checkpoint_no": "1"}, "checkpoint_no must be an unsigned integer"), (LINES[1] | {"checkpoint_no": -1}, "checkpoint_no must be an unsigned integer"), (LINES[1] | {"checkpoint_no": 1 << 33}, "checkpoint_no exceeds u32"),
    (LINES[1] | {"parent_checkpoint_id": 5}, "parent_checkpoint_id must be a string or null"), (LINES[1] | {"parent_checkpoint_id": "later"}, "parent checkpoint not found"), (LINES[0], "duplicate checkpoint"),
])
def test_import_stops(spark, tmp_path, bad, error):
    kept, report = jsonl.import_jsonl(jsonl.numbered_lines(spark, write(tmp_path / "x.jsonl", [LINES[0], "", bad, LINES[4]])))
    assert report.first().asDict() == {"checkpoint_count": 1, "message_value_count": 1, "stopped_at": 3, "error": error}
    assert [r["checkpoint_id"] for r in kept.collect()] == ["root"]


def test_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/d/part")
    (tmp_path / "d" / "source_manifest.json").write_text(json.dumps({"files": [{"path": "gone.parquet"}]}))
    with pytest.raises(Exception):
        files.manifest_paths(spark, f"{tmp_path}/d")
    with pytest.raises(ValueError):
        files.scan(spark, f"{tmp_path}/d/part", ["id", "other"])
    assert files.storage(spark, f"{tmp_path}/d/part").first()["files"] >= 1
    nodes = spark.createDataFrame([("i", "a", None), ("i", "b", "x"), ("i", "a", None)], "instance_id string, checkpoint_id string, parent_checkpoint_id string")
    assert {r["fault"] for r in files.topology_faults(nodes).collect()} == {"Duplicate", "MissingParent"}
    w = files.fork_workload(spark, 2, 3, 1000, 100)
    assert w.count() == 8 and forest.geometry(w.withColumn("bytes", F.octet_length("message")), "bytes").first()["maximum_fanout"] == 3
    line = {"format_version": 1, "source": "s", "resolved_revision": "r", "instance_id": "i", "attempts": [{"attempt_id": "1", "solved": True, "source_row_fingerprint": "f", "checkpoint_path": ["a", "b"]}],
            "nodes": [{"checkpoint_id": "a", "parent_checkpoint_id": None, "sequence_no": 0, "operations": [], "logical_state_len": 5, "logical_state_sha256": "", "observations": 1}], "stats": {}}
    f = files.frozen(spark, write(tmp_path / "f.jsonl", [line]))
    assert f["paths"].count() == 2 and f["nodes"].first()["logical_state_len"] == 5


def test_sidecar_and_manifest(spark, tmp_path):
    a = spark.createDataFrame([("i", "2", True, "f", "t"), ("i", "1", None, None, "u")], "instance_id string, attempt_id string, solved boolean, source_row_fingerprint string, tip_checkpoint_id string")
    files.write_attempt_refs(a, f"{tmp_path}/refs")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/refs").collect()] == [
        '{"attempt_id":"1","instance_id":"i","solved":null,"source_row_fingerprint":null,"tip_checkpoint_id":"u"}', '{"attempt_id":"2","instance_id":"i","solved":true,"source_row_fingerprint":"f","tip_checkpoint_id":"t"}']
    lines = spark.createDataFrame([(k, f"line {k}", "ab"[k % 2]) for k in range(50)], "key long, line string, part string")
    first = {r["part"]: r for r in files.partition_manifest(lines, "part").collect()}
    assert first["a"]["lines"] == 25 and first["b"]["bytes"] == sum(len(f"line {k}") for k in range(1, 50, 2))
    assert first == {r["part"]: r for r in files.partition_manifest(lines.repartition(5), "part").collect()}
    other = {r["part"]: r for r in files.partition_manifest(lines.replace("line 3", "line x", ["line"]), "part").collect()}
    assert other["a"] == first["a"] and other["b"]["sha256"] != first["b"]["sha256"]


def test_cycles_end(spark):
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, None)], "thread long, node long, parent long")
    assert forest.depths(nodes).count() == 3


def test_stream_is_batch(spark, tmp_path):
    log = random_log(7, n=60, histories=3)
    rows = spark.createDataFrame([tuple(o[f] for f in OPERATION.fieldNames()) for o in log], OPERATION)
    for i, part in enumerate((rows.filter("seq % 1000 < 25"), rows.filter("seq % 1000 between 20 and 59"))):  # some come twice
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        out = fold.stream_replay(spark.readStream.schema(OPERATION).parquet(f"{tmp_path}/log"))
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    cols = ["history_id", "seq", "outcome", "error", "len", "sha256"]
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()), key=str)
    assert got == sorted(map(tuple, history.replay(rows).select(*cols).collect()), key=str)


def test_mirror(spark, tmp_path):
    schema = "thread_id string, messages array<string>"
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for rows in ([("a", ["1"]), ("b", ["x", "y"])], [("a", ["1", "2", "3"]), ("b", ["changed", "y"])], [("a", ["1", "2", "3"])]):
        put(*rows)
        fold.mirror(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/m", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/m").orderBy("batch").collect()
    assert [m for r in got if r["thread_id"] == "a" for m in r["delta"]] == ["1", "2", "3"]
    assert [m for r in got if r["thread_id"] == "b" for m in r["delta"]] == ["x", "y"]
    assert [r["thread_id"] for r in spark.read.parquet(f"{tmp_path}/m/_refused/batch=1").collect()] == ["b"]
