"""Tables: changes, versions, schema changes, compaction, routes and streams."""

import json
import random
import threading
import time
import urllib.request

import pytest

from quillsift.functions import analysis
from quillsift.plans import service
from quillsift.plans.engine import Engine
from quillsift.plans.routes import route
from quillsift.sources.store import VersionTaken
from quillsift.streaming.ingest import OPS, changes, ingest

FIELDS = {"id": "primary", "name": "whole", "age": "number", "about": "words", "born": "time", "raw": "pure"}


def body(**over):
    d = {"name": "n", "age": 1, "about": "a b", "born": "2019-05-11", "raw": "r"} | over
    return json.dumps({k: v for k, v in d.items() if v is not ...})


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"))
    e.create_database("db")
    e.create_table("db", "t", FIELDS)
    return e


def apply(engine, *ops):
    df = engine.spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], OPS)
    return [(r["status"], r["doc_id"], r["error"]) for r in engine.apply("db", "t", df).orderBy("seq").collect()]


def live(engine):
    return {r["key"]: r["doc_id"] for r in engine.table("db", "t").shown(engine.table("db", "t").live()).collect()}


def test_order_within_a_batch(engine):
    got = apply(
        engine, ("insert", "1", body()), ("insert", "1", body()), ("delete", "1", None), ("delete", "1", None), ("update", "1", body()),
        ("insert", "1", body(age=2)), ("update", "1", body(age=3)), ("insert", "2", body(age=...)), ("insert", "2", body()), ("update", "2", body(age="x")), ("nope", "1", None),
    )
    assert [g[1] for g in got] == [0, None, None, None, None, 1, 2, 3, 4, 5, None]
    assert [g[0] for g in got] == ["ok", "failed", "ok", "ok", "failed", "ok", "ok", "failed", "ok", "failed", "failed"]
    assert live(engine) == {"1": 2, "2": 4}
    assert engine.table("db", "t").snapshot()[1]["next_doc_id"] == 6
    assert engine.get("db", "t", "1")["detail"]["age"] == 3


def test_validity_by_type(engine):
    bad = [body(name=88), body(age="1"), body(age=None), body(age=True), body(born="x"), body(born=...), body(about=None), "[1]", "{", None, body(raw=1.5)]
    assert {g[2] for g in apply(engine, *[("insert", f"b{i}", b) for i, b in enumerate(bad)])} == {"the document is invalid"}
    assert live(engine) == {}
    good = [body(age=2.9), body(born=7), body(name=...), body(extra=[1])]
    assert {g[0] for g in apply(engine, *[("insert", f"g{i}", b) for i, b in enumerate(good)])} == {"ok"}
    detail = [engine.get("db", "t", f"g{i}")["detail"] for i in range(3)]
    assert (detail[0]["age"], detail[0]["born"], detail[1]["born"], detail[2]["name"]) == (2, 1557532800, 7, "")


def test_keys(engine):
    own = json.loads(body())
    assert apply(engine, ("insert", "1", json.dumps(own | {"id": "2"})), ("insert", "1", json.dumps(own | {"id": 1})), ("update", None, body()))[0][0] == "failed"
    assert engine.insert("db", "t", "1", own | {"id": "1"}) == "1"
    made = engine.insert("db", "t", "_auto", own)
    assert len(made) > 8 and engine.get("db", "t", made)["detail"]["id"] == made
    assert engine.get("db", "t", "nobody") is None
    with pytest.raises(ValueError, match="the key exists"):
        engine.insert("db", "t", "1", own)


def test_random_changes_against_a_model(engine):
    rng, model, next_id = random.Random(5), {}, 0
    for _ in range(3):
        ops, want = [], []
        for _ in range(40):
            op, key, ok = rng.choice(["insert", "update", "delete"]), str(rng.randrange(8)), rng.random() < 0.8
            ops.append((op, key, None if op == "delete" else body(age=1 if ok else ...)))
            if op == "delete":
                model.pop(key, None)
                want.append(("ok", None))
            elif (op == "insert") == (key in model):
                want.append(("failed", None))
            else:
                want.append(("ok" if ok else "failed", next_id))
                if ok:
                    model[key] = next_id
                next_id += 1
        assert [g[:2] for g in apply(engine, *ops)] == want
        assert live(engine) == model
    engine.table("db", "t").compact(1 << 40)
    assert live(engine) == model
    assert engine.table("db", "t").snapshot()[1]["next_doc_id"] == next_id


def test_schema_change_and_compaction(engine):
    apply(engine, ("insert", "1", body(about="x y")), ("insert", "2", body()))
    engine.add_field("db", "t", "tag", "whole")
    engine.add_field("db", "t", "rank", "number")
    engine.drop_field("db", "t", "raw")
    apply(engine, ("insert", "3", body(about="x", tag="new", rank=5)))
    tag = lambda v: [{"field": "tag", "type": "=", "str": v}]
    find = lambda **r: sorted(x["key"] for x in engine.search("db", "t", r).collect())
    assert engine.get("db", "t", "1")["detail"]["tag"] == "" and "raw" not in engine.get("db", "t", "1")["detail"]
    assert find(filters=tag("new")) == ["3"] and find(filters=tag("")) == []
    with pytest.raises(ValueError):
        find(filters=[{"field": "raw", "type": "=", "str": "r"}])
    assert find(fieldName="about", value="x") == ["1", "3"]
    t = engine.table("db", "t")
    assert t.compact(100) == [[0, 1]]
    assert find(filters=tag("")) == ["1", "2"]
    assert find(filters=[{"field": "rank", "type": ">", "int": 0}]) == ["3"]
    t.build_index()
    assert t.index() is not None and find(fieldName="about", value="x") == ["1", "3"] and find(value="new") == ["3"]
    apply(engine, ("insert", "4", body(about="x", tag="", rank=1)))
    assert t.index() is None and find(fieldName="about", value="x") == ["1", "3", "4"]
    assert t.build_index() == 1 and find(fieldName="about", value="x") == ["1", "3", "4"]
    apply(engine, ("delete", "1", None))
    assert find(fieldName="about", value="x") == ["3", "4"]
    assert engine.table("db", "t").get_by_id(2).first()["key"] == "3"
    assert [(s["n_rows"], s["n_live"]) for s in engine.status()[0]["tables"][0]["segments"]] == [(3, 2), (1, 1)]


def test_hidden_key_and_reopening(engine, spark, tmp_path):
    engine.create_table("db", "u", {"name": "whole"})
    key = engine.insert("db", "u", "_auto", {"name": "x"})
    again = Engine(spark, str(tmp_path / "root"))
    assert again.get("db", "u", key) == {"key": key, "detail": {"name": "x"}}
    with pytest.raises(ValueError):
        again.create_database("db")
    with pytest.raises(ValueError):
        again.create_table("db", "u", {"name": "whole"})
    again.drop_table("db", "u")
    with pytest.raises(ValueError):
        again.get("db", "u", key)
    again.close()
    with pytest.raises(RuntimeError):
        again.get("db", "t", key)


def test_two_writers_of_one_version(engine):
    t = engine.table("db", "t")
    version, meta = t.snapshot()
    t.commit(version, meta)
    with pytest.raises(Exception, match="(?i)exist"):
        t.commit(version, meta)


def test_routes(engine):
    go = lambda m, p, b=None: route(engine, m, p, None if b is None else json.dumps(b))
    doc = json.loads(body())
    assert go("POST", "/d2")[1]["code"] == 0 and go("POST", "/d2")[1]["code"] == 1
    assert go("POST", "/d2/t", [{"name": "id", "type": "primary"}, {"name": "about", "type": "words"}])[1]["code"] == 0
    assert go("POST", "/d2/t/1", doc)[1]["data"] == "1"
    assert go("PUT", "/d2/t/1", {"about": "hello world"})[1]["code"] == 0
    found = go("GET", "/_search", {"database": "d2", "table": "t", "fieldName": "about", "value": "hello"})[1]["data"]
    assert found == {"docs": [{"key": "1", "detail": {"id": "1", "about": "hello world"}}], "total": 1}
    assert go("PATCH", "/d2/t", {"type": "addField", "field": {"name": "x", "type": "whole"}})[1]["code"] == 0
    assert go("GET", "/d2/t/1")[1]["data"]["detail"]["x"] == ""
    assert go("PATCH", "/d2/t", {"type": "delField", "field": {"name": "x"}})[1]["code"] == 0
    assert go("PATCH", "/d2/t", {"type": "else", "field": {"name": "x"}})[1]["code"] == 2
    assert go("DELETE", "/d2/t/1")[1]["code"] == 0 and go("GET", "/d2/t/1")[1]["data"] is None
    assert go("GET", "/_search", {"database": "d2", "table": "t"})[1]["data"] == {"docs": None, "total": 0}
    assert go("DELETE", "/d2/t")[1]["code"] == 0 and go("DELETE", "/d2")[1]["code"] == 0
    assert go("GET", "/a/b/c/d")[0] == 404 and go("HEAD", "/a")[0] == 501
    assert route(engine, "POST", "/x/y/z", "{")[1]["code"] == 2
    assert {d["database"] for d in go("GET", "/_status")[1]} == {"db"}


def test_stream_applies_each_change_once(engine, spark, tmp_path):
    rows = [json.dumps({"seq": i, "op": "insert", "key": str(i), "body": body()}) for i in range(20)]
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(rows[5 * k : 5 * k + 5]))
    run = lambda: ingest(engine, "db", "t", changes(spark, str(tmp_path / "in"), 2), str(tmp_path / "cp"), "s", available_now=True).awaitTermination()
    run()
    run()
    assert len(live(engine)) == 20
    assert engine.table("db", "t").snapshot()[1]["streams"] == {"s": 1}
    again = spark.createDataFrame([(0, "delete", "1", None)], OPS)
    assert engine.apply("db", "t", again, ("s", 1)).count() == 0 and len(live(engine)) == 20


def found(engine, **request):
    rows = engine.search("db", "t", {"fieldName": "about", "value": "x"} | request).collect()
    return sorted(r["key"] for r in rows), rows[0]["total"] if rows else 0


def test_index_after_compaction_gives_each_hit_once(engine):
    t = engine.table("db", "t")
    for k in range(5):
        apply(engine, ("insert", str(k), body(about="x y")), ("insert", f"n{k}", body()))
        t.build_index()
    apply(engine, ("delete", "1", None), ("update", "2", body(about="y")), ("update", "n3", body(about="x")))
    t.build_index()
    want = (["0", "3", "4", "n3"], 4)
    assert found(engine) == want
    assert t.compact(1 << 40) == [list(range(6))]
    meta = t.snapshot()[1]
    assert len(meta["indexes"]) == 1 and meta["tombstones"] == [] and t.index(meta) is not None and found(engine) == want
    assert t.build_index() == 0 and found(engine) == want
    apply(engine, ("insert", "9", body(about="x")))
    assert t.index() is None and t.build_index() == 1
    assert found(engine) == (["0", "3", "4", "9", "n3"], 5) and found(engine, offset=0, size=2)[1] == 5
    t.compact(1 << 40)
    ids = [r["doc_id"] for r in t.index().where("field = 'about' and term = 'x'").collect()]
    assert len(ids) == len(set(ids)) == 5


def test_an_index_that_covers_a_part_of_a_merged_segment(engine):
    t = engine.table("db", "t")
    apply(engine, ("insert", "1", body(about="x")))
    t.build_index()
    apply(engine, ("insert", "2", body(about="x")))
    t.compact(1 << 40)
    assert t.index() is None and found(engine) == (["1", "2"], 2)
    assert t.build_index() == 1 and t.index() is not None and found(engine) == (["1", "2"], 2)


def test_an_index_of_another_segmenter_is_not_used(engine, spark):
    apply(engine, ("insert", "1", body(about="我爱北京")))
    t = engine.table("db", "t")
    t.build_index()
    other = Engine(spark, engine.root, segmenter=analysis.dictionary_segmenter(["北京"]), merge_at_start=False)
    search = lambda e: [r["key"] for r in e.search("db", "t", {"fieldName": "about", "value": "北京"}).collect()]
    assert search(engine) == [] and t.index(segmenter=other.segmenter) is None and search(other) == ["1"]
    t.build_index(other.segmenter)
    assert t.index() is not None and t.index(segmenter=other.segmenter) is not None and search(engine) == [] and search(other) == ["1"]
    assert analysis.segmenter_name(analysis.dictionary_segmenter(["b", "a"])) == analysis.segmenter_name(analysis.dictionary_segmenter(["a", "b"]))


def test_upkeep_by_number_of_segments(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"), max_segments=3, keep_seconds=0)
    engine.create_database("db")
    engine.create_table("db", "t", FIELDS)
    for k in range(6):
        apply(engine, ("insert", str(k), body()), ("delete", str(k - 1), None))
    t = engine.table("db", "t")
    meta = t.snapshot()[1]
    assert len(meta["segments"]) <= 4 and list(live(engine)) == ["5"]
    t.compact(1 << 40)
    t.vacuum(0)
    meta = t.snapshot()[1]
    assert len(meta["segments"]) == 1 and meta["tombstones"] == [] and t.status().first()["n_rows"] == 1
    assert [len(t.files.folders(f"{t.path}/{k}")) for k in ("segments", "tombstones", "postings")] == [1, 0, 0] and len(t.files.names(f"{t.path}/_meta")) == 1
    apply(engine, ("insert", "6", body()), ("delete", "5", None))
    again = Engine(spark, engine.root)  # merges as it starts
    assert len(again.table("db", "t").snapshot()[1]["segments"]) == 1 and list(live(again)) == ["6"]


def test_a_segment_on_its_own_is_purged_when_much_of_it_is_dead(engine):
    apply(engine, *[("insert", str(k), body()) for k in range(4)])
    t = engine.table("db", "t")
    apply(engine, ("delete", "0", None))
    assert t.compact(1) == [] and t.last_dead() == 0
    apply(engine, ("delete", "1", None))
    assert t.compact(1) == [[0]] and t.snapshot()[1]["tombstones"] == [] and t.status().first()["n_rows"] == 2 and live(engine) == {"2": 2, "3": 3}


def test_vacuum_spares_recent_versions_and_writes_under_way(engine):
    apply(engine, ("insert", "1", body()))
    apply(engine, ("insert", "2", body()))
    t = engine.table("db", "t")
    old = t.snapshot()[1]
    t.compact(100)
    stray = t.folder("segments")
    t.files.mkdirs(stray)
    assert t.vacuum(3600) == [] and t.live(old).count() == 2
    gone = t.vacuum(0)
    assert stray in gone and {s["path"] for s in old["segments"]} <= set(gone) and len(live(engine)) == 2 and t.vacuum(0) == []


def test_equal_numbers_are_taken_in_a_defined_order(engine, spark):
    rows = [(1, "insert", "a", body(age=2)), (1, "insert", "a", body(age=2)), (1, "delete", "a", None), (1, "insert", "b", body(age=1)), (1, "update", "b", body(age=2)), (1, "update", "b", body(age=3))]
    seen = set()
    for k in range(2):
        engine.create_table("db", f"t{k}", FIELDS)
        random.Random(k).shuffle(rows)
        out = engine.apply("db", f"t{k}", spark.createDataFrame(rows, OPS))
        t = engine.table("db", f"t{k}")
        now = sorted((r["key"], r["age"], r["doc_id"]) for r in t.shown(t.live()).collect())
        seen.add((tuple(sorted((r["op"], r["key"], r["status"], r["doc_id"] or -1) for r in out.collect())), tuple(now)))
    assert len(seen) == 1 and [n[0] for n in now] == ["a", "b"]


def test_threads_write_in_groups_and_lose_nothing(engine):
    def work(k):
        for n in range(6):
            replies.append(route(engine, "POST", f"/db/t/{k}-{n % 5}", body()))

    replies, began = [], time.time()
    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    took = time.time() - began
    codes = [r[1]["code"] for r in replies]
    assert codes.count(0) == 40 and codes.count(1) == 8 and len(live(engine)) == 40
    assert engine.table("db", "t").snapshot()[0] < 40, took  # fewer versions than changes


def test_a_lost_version_is_tried_again(engine, monkeypatch):
    from quillsift.sources.store import Table

    commit, lost = Table.commit, []

    def losing(self, version, meta):
        if len(lost) < 2:
            lost.append(version)
            raise VersionTaken("taken")
        commit(self, version, meta)

    monkeypatch.setattr(Table, "commit", losing)
    assert engine.insert("db", "t", "1", json.loads(body())) == "1" and len(lost) == 2 and live(engine) == {"1": 0}
    monkeypatch.setattr(Table, "commit", lambda *_: (_ for _ in ()).throw(VersionTaken("taken")))
    monkeypatch.setattr("quillsift.plans.engine.RETRIES", 1)
    assert route(engine, "POST", "/db/t/2", body())[1]["code"] == 1


def test_lookups_by_key_reach_the_scan(engine):
    apply(engine, ("insert", "1", body()))
    plan = engine.table("db", "t").get("1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(__key,1)" in plan


def test_outcomes_of_a_stream(engine, spark, tmp_path):
    rows = [{"seq": 1, "op": "insert", "key": "1", "body": body()}, {"seq": 2, "op": "insert", "key": "1", "body": body()}, {"seq": 3, "op": "nope", "key": "1", "body": None}]
    (tmp_path / "in").mkdir()
    for k, r in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(r))
    assert engine.table("db", "t").outcomes("s").collect() == []
    ingest(engine, "db", "t", changes(spark, str(tmp_path / "in")), str(tmp_path / "cp"), "s", available_now=True).awaitTermination()
    got = engine.table("db", "t").outcomes("s").orderBy("seq").collect()
    assert [(r["batch"], r["status"], r["error"]) for r in got] == [(0, "ok", None), (0, "failed", "the key exists"), (0, "failed", "unknown operation")]


def test_the_process_serves_and_stops(spark, tmp_path):
    with pytest.raises(ValueError):
        service.read_config("nope = 1")
    config = service.read_config(f"root = {tmp_path}/root  # where\n\nport = 9537\nmerge_at=10")
    assert config["merge_at"] == "10" and config["host"] == "127.0.0.1"
    stop, ready = threading.Event(), threading.Event()
    thread = threading.Thread(target=service.run, args=(spark, config, stop, ready))
    thread.start()
    assert ready.wait(60)
    ask = lambda method, path: json.load(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:9537{path}", method=method)))
    assert ask("POST", "/d")["code"] == 0 and ask("GET", "/_status") == [{"database": "d", "tables": []}]
    stop.set()
    thread.join(60)
    assert not thread.is_alive()
    with pytest.raises(OSError):
        ask("GET", "/_status")


def test_documents_are_moved_once_by_range_and_judged_without(engine, spark, monkeypatch):
    """3000 documents, all inserted again: in many ranges, the refused ones too, with texts only in the changes and the segment."""
    from quillsift.sources import dml

    monkeypatch.setattr(dml, "RANGE_BYTES", 4096)
    kept, texts, spread, moved, make = [], [], [], dml._documents, dml.written

    def write(df, tag):
        kept.append((tag, "about" in df.columns))
        return make(df, tag)

    def documents(*args):
        out = moved(*args)
        texts.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        spread.append(len(args[2]))
        return out

    monkeypatch.setattr(dml, "written", write)
    monkeypatch.setattr(dml, "_documents", documents)
    ops = spark.range(6000).selectExpr("6000 - id as seq", "'insert' as op", "cast(id % 3000 as string) as key", f"replace('{body(about='w-')}', 'w-', sha2(cast(id as string), 512)) as body")
    out = engine.apply("db", "t", ops)
    assert out.where("status = 'ok'").selectExpr("count(*)", "min(doc_id)", "max(doc_id)", "count(distinct doc_id)").first()[:] == (3000, 0, 2999, 3000)
    assert out.where("doc_id <> seq - 1").isEmpty() and out.where("error = 'the key exists'").count() == 3000
    t = engine.table("db", "t")
    wrong = t.live().where("about <> sha2(cast(3000 + cast(__key as int) as string), 512) or doc_id <> 2999 - cast(__key as int)")
    assert wrong.isEmpty() and t.live().count() == 3000
    assert [k for k, has in kept if has] == ["changes"] and texts == [1] and spread[0] > 8


def test_postings_of_merged_segments_are_not_shuffled(engine, monkeypatch):
    """Bucket by bucket, with the same rows, unless some are dead; of an id that is in two folders only the part that counts."""
    from quillsift.operators import postings

    t, plans, store = engine.table("db", "t"), [], postings._store
    monkeypatch.setattr(postings, "_store", lambda rows, *a: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or store(rows, *a))
    for k in range(3):
        apply(engine, *[("insert", f"{k}-{n}", body(about=f"x w{n} {k}")) for n in range(40)])
        t.build_index()
    every = lambda: sorted(tuple(r) for r in postings.unpacked(t.index()).select(*postings.COLUMNS).collect())
    before = every()
    plans.clear()
    assert t.compact(1 << 40) == [[0, 1, 2]]
    assert 1 < len(plans) <= 8 and not any("Exchange" in p for p in plans) and every() == before and len(t.snapshot()[1]["indexes"]) == 1
    stored = t.spark.read.parquet(t.snapshot()[1]["indexes"][0]["path"])
    assert stored.count() == len(before) - stored.where("cross is not null").count()
    assert found(engine)[1] == 120
    apply(engine, ("delete", "0-0", None))
    apply(engine, ("insert", "z", body(about="x")))
    t.build_index()
    t.compact(1 << 40)
    assert found(engine)[1] == 120 and 0 not in {r[3] for r in every()}
