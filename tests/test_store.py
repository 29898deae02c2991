import pytest
from pyspark.sql import functions as F

from factloom.sources import loaders
from factloom.sources.store import Change, Refused, Store, new_rows, retained


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "kb"))
    s.append("evidence", spark.createDataFrame([(i, f"f{i}") for i in range(5)], "id long, what string"), ["id"])
    return s


def claims(spark, rows):
    return spark.createDataFrame(rows, "id long, kind string, subject string, value string, origin string")


def test_evidence_is_append_only(spark, store):
    with pytest.raises(Refused):
        store.append("evidence", spark.createDataFrame([(3, "other")], "id long, what string"), ["id"])
    with pytest.raises(Refused):
        store.append("evidence", spark.createDataFrame([(9, "a"), (9, "b")], "id long, what string"), ["id"])
    store.append("evidence", spark.createDataFrame([(9, "a")], "id long, what string"), ["id"])
    assert store.read("evidence").count() == 6


def test_changes_write_what_they_change(spark, store, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "id long, v string")
    size = lambda part: spark.read.parquet(str(tmp_path / "kb" / "t" / part)).count()
    store.append("t", df([(i, "a") for i in range(100)]), ["id"])
    old = store.parts("t")
    store.append("t", df([(200, "b")]), ["id"])
    store.append_missing("t", df([(1, "x"), (201, "b")]), ["id"])
    assert store.parts("t")[:1] == old and [size(p) for p in store.parts("t")] == [100, 1, 1]
    store.upsert("t", df([(200, "c"), (300, "c")]), ["id"])
    assert store.parts("t")[:1] == old and [size(p) for p in store.parts("t")] == [100, 1, 2]
    assert store.read("t").count() == 103 and store.read("t").filter("id = 200").first().v == "c"
    # rows read before a change stay what they were, and a version of another writer is never replaced
    before, seen = store.read("t"), store.current("t")
    store.publish("t", df([(1, "z")]))
    assert before.count() == 103 and store.read("t").count() == 1
    with pytest.raises(Refused, match="another writer"):
        store._publish(Change("t", seen, [], df([(2, "z")])))
    # a version that a writer did not end does not count, and bars nobody
    (tmp_path / "kb" / "_versions" / "000000000099.json").write_text('{"t": ["part')
    assert store.read("t").first().v == "z"
    store.append("t", df([(2, "y")]), ["id"])
    assert store.read("t").count() == 2 and (tmp_path / "kb" / "_versions" / "000000000100.json").exists()


def test_writers_at_once(spark, store):
    """A number is given once; a writer goes on with the next one if nobody has changed its tables, and is refused otherwise."""
    df = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    store.publish("a", df(1))
    number, tables = store._state()
    assert not store._take(number, "{}\n") and store._state() == (number, tables)
    once, real = [], store._state

    def late():
        found = real()
        if not once:  # another writer comes between
            once.append(1)
            Store(spark, store.path).publish("b", df(7))
        return found

    change = store._added("a", df(2), ["id"])
    store._state = late
    store._publish(change)
    assert store.read("a").count() == 2 and store.read("b").count() == 1
    stale = store._added("a", df(3), ["id"])
    store.publish("a", df(9))
    with pytest.raises(Refused):
        store._publish(stale)


@pytest.mark.parametrize("fails_at", [1, 2])
def test_a_change_of_two_tables_is_whole(spark, store, monkeypatch, fails_at):
    """A writer dies after its first part, or after both, before the version: nothing of it is seen, and trying again gives it once."""
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    n = []

    def dies(self, number, text):
        raise RuntimeError("dead")

    import pyspark.sql.readwriter as rw

    write = rw.DataFrameWriter.parquet

    def part(self, path, *a, **k):
        n.append(path)
        if "/receipts/" in path and fails_at == 1:
            raise RuntimeError("dead")
        return write(self, path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(rw.DataFrameWriter, "parquet", part)
        if fails_at == 2:
            m.setattr(Store, "_take", dies)
        with pytest.raises(RuntimeError):
            store.import_job("log", rows, "id", "job")
    assert n and store.current("log") is None and store.current("receipts") is None
    assert store.import_job("log", rows, "id", "job") and not store.import_job("log", rows, "id", "job")
    assert store.read("log").count() == 2 and store.read("receipts").count() == 1
    with monkeypatch.context() as m:
        m.setattr(Store, "_take", dies)
        with pytest.raises(RuntimeError):
            store.assert_claims(claims(spark, [(1, "k", "s", "v", "model")]), spark.createDataFrame([(1, 0)], "inference_id long, evidence_id long"))
    assert store.current("inference") is None and store.current("inference_support") is None


def test_claims_need_citations_and_retraction_cascades(spark, store):
    support = lambda rows: spark.createDataFrame(rows, "inference_id long, evidence_id long")
    with pytest.raises(Refused):
        store.assert_claims(claims(spark, [(1, "k", "s", "v", "model")]), support([]))
    with pytest.raises(Refused):
        store.assert_claims(claims(spark, [(1, "k", "s", "v", "model")]), support([(1, 77)]))
    store.assert_claims(claims(spark, [(1, "k", "s", "v", "model"), (2, "k", "s", "v", "model"), (3, "k", "t", "v", "human"), (4, "k", "u", "v", "human")]), support([(1, 0), (2, 1)]))
    store.publish("inference_depends", spark.createDataFrame([(2, 1), (3, 2), (1, 3)], "inference_id long, depends_on_id long"))  # a cycle
    gone = store.retract(spark.createDataFrame([(1,)], "node long"), "poisoned")
    assert {r.id for r in gone.collect()} == {1, 2, 3}
    status = {r.id: (r.status, r.reason) for r in store.read("inference").collect()}
    assert status[4] == ("active", None) and status[2] == ("retracted", "poisoned")


def test_ratchet_upsert_and_jobs(spark, store):
    df = lambda rows: spark.createDataFrame(rows, "id long, ok boolean")
    assert store.ratchet("state", df([(1, True), (2, True)]), "ok")
    assert not store.ratchet("state", df([(1, True), (2, False), (3, False)]), "ok")
    assert store.ratchet("state", df([(1, True), (2, True), (3, False)]), "ok") and store.read("state").count() == 3
    store.upsert("kv", df([(1, False)]), ["id"])
    store.upsert("kv", df([(1, True), (2, None)]), ["id"])
    assert {(r.id, r.ok) for r in store.read("kv").collect()} == {(1, True), (2, None)}
    rows = df([(10, True), (20, False)])
    assert store.import_job("log", rows, "id", "a") and not store.import_job("log", rows, "id", "a") and store.import_job("log", rows, "id", "b")
    assert sorted(r.id for r in store.read("log").collect()) == [1, 2, 3, 4]
    assert new_rows(store.read("log"), 2).count() == 2


def test_commits_hydrate_and_compact(spark, store):
    rows = lambda x: spark.createDataFrame(x, "name string, payload string")
    store.commit(rows([("a", "1"), ("b", "2")]), "name", "payload", 1, None)
    store.commit(rows([("a", "1"), ("b", "3")]), "name", "payload", 2, 1)
    assert store.read("objects").count() == 3
    assert {(r.name, r.payload) for r in store.hydrate(2).collect()} == {("a", "1"), ("b", "3")}
    assert store.compact(spark.createDataFrame([(2,)], "commit_id long")) == 2
    damaged = store.read("objects").withColumn("payload", F.when(F.col("payload") == "3", "x").otherwise(F.col("payload")))
    store.publish("objects", damaged)
    with pytest.raises(Refused):
        store.hydrate(2)


def test_retention(spark):
    days = [(i, f"2024-01-{1 + i // 3:02d} 0{i % 3}:00:00") for i in range(9)]
    commits = spark.createDataFrame(days, "commit_id long, created string").withColumn("created", F.to_timestamp("created"))
    kept = retained(commits, 1, spark.createDataFrame([(0,)], "commit_id long"))
    assert sorted(r.commit_id for r in kept.collect()) == [0, 2, 5, 8]


def test_loaders(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "v": "a"}\nnot json\n{"id": 2}\n')
    assert loaders.json_lines(spark, str(tmp_path / "x.jsonl"), "id long, v string", ["id"]).count() == 2
    with pytest.raises(Refused):
        loaders.unique_by(spark.createDataFrame([(1,), (1,)], "id long"), ["id"], "panel")
    with pytest.raises(Refused):
        loaders.non_empty(spark.range(0), "nothing")
    (tmp_path / "s.txt").write_text("main = 0x80001000; // type:func\nbad line\ndata_1 = 0xFFFFFFFF;\n")
    syms = {r.name: (r.addr, r.kind) for r in loaders.symbols(spark, str(tmp_path / "s.txt")).collect()}
    assert syms == {"main": (0x80001000, "func"), "data_1": (0xFFFFFFFF, None)}
    (tmp_path / "m.map").write_text(" .text          0x80000400       0x1c build/a.o\n junk\n .data  0x80000500 0x10 build/b.o\n")
    assert {(r.object_path, r.size) for r in loaders.sections(spark, str(tmp_path / "m.map")).collect()} == {("build/a.o", 28), ("build/b.o", 16)}
    (tmp_path / "n.map").write_text("                0x80000000                early\n .text          0x80000400       0x1c build/a.o\n                0x80000400                main\n                0x80000410                helper\n *fill*  0x8000041c 0x4\n"
                                    " .data          0x80000500 0x10 build/b.o\n                0x80000500                table\n                0x1                _size = 0x10\n")  # fmt: skip
    assert sorted((r.name, r.addr, r.object_path, r.section) for r in loaders.map_symbols(spark, str(tmp_path / "n.map")).collect()) == [
        ("early", 0x80000000, None, None), ("helper", 0x80000410, "build/a.o", ".text"), ("main", 0x80000400, "build/a.o", ".text"), ("table", 0x80000500, "build/b.o", ".data")]
    files = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "name string, addr long")
    assert {r.name: r.status for r in loaders.symbol_identity(files).collect()} == {"a": "resolved", "b": "conflict", "c": "unresolved"}
    new = spark.createDataFrame([("g", 0, 10), ("g", 50, 60), ("h", 20, 30)], "grp string, lo long, hi long")
    good, refused = loaders.without_overlaps(new, spark.createDataFrame([(55, 5000)], "lo long, hi long"), "grp", "lo", "hi")
    assert [r.grp for r in good.collect()] == ["h"] and [r.grp for r in refused.collect()] == ["g"]
    nested = spark.createDataFrame([('{"a": {"k": "x", "z": [{"k": 5}]}, "k": null}',)], "j string")
    assert sorted(r.value for r in loaders.values_of_key(nested, "j", "k").collect()) == ["5", "null", "x"]
    assert loaders.generated(spark, 100, 7).collect() == loaders.generated(spark, 100, 7).collect()
    (tmp_path / "src" / "skip").mkdir(parents=True)
    (tmp_path / "src" / "a.c").write_text("int a;\nint b;")
    (tmp_path / "src" / "skip" / "b.c").write_text("no")
    assert [r.text for r in loaders.source_files(spark, str(tmp_path / "src"), "*.c", ["skip"]).collect()] == ["int a;\nint b;"]
    loaders.write_json_lines(spark.range(2), str(tmp_path / "out"))
    assert loaders.json_lines(spark, str(tmp_path / "out"), "id long").count() == 2
    assert "| 0 |" in loaders.report(spark.range(1), "t", 5)
