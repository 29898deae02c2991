from pyspark.sql import functions as F

from factloom.streaming import logs


def test_tail_state_and_late_lines(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    line = '{{"function": "{}", "status": "{}", "score": {}, "ts": "2024-01-01T0{}:00:00Z"}}\n'
    (src / "1.json").write_text(line.format("f", "ok", 1.5, 1) + "broken\n" + line.format("f", "ok", 2.5, 2))

    def keep(batch, _):
        seen.extend((r.function, r.score, r.previous) for r in batch.collect())

    def go():
        logs.run_to_end(logs.previous_scores(logs.tail(spark, str(src)).withColumn("place", F.lit(0))), str(tmp_path / "ck"), keep)

    go()
    assert seen == [("f", 1.5, None), ("f", 2.5, 1.5)]
    (src / "2.json").write_text(line.format("f", "ok", 4.0, 3) + line.format("g", "ok", 1.0, 3))
    go()
    assert sorted(seen[2:]) == [("f", 4.0, 2.5), ("g", 1.0, None)]


def test_windows_and_once_each(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = "".join(f'{{"function": "f", "status": "ok", "score": {i}, "ts": "2024-01-01T{h:02d}:00:00Z"}}\n' for i, h in enumerate([1, 1, 2, 5, 9]))
    (src / "1.json").write_text(rows)
    got, uniq = [], []
    logs.run_to_end(logs.windowed(logs.tail(spark, str(src))), str(tmp_path / "a"), lambda b, _: got.extend((r.start.hour, r.n) for r in b.collect()))
    assert {(1, 2), (2, 1), (5, 1)} <= {(h, n) for h, n in got}
    logs.run_to_end(logs.once_each(logs.tail(spark, str(src)), ["function", "ts"]), str(tmp_path / "b"), lambda b, _: uniq.extend(b.collect()))
    assert len(uniq) == 4


def test_state_machines(spark):
    cases = [(True, True, 0, 0, "wait"), (False, True, 0, 0, "restart"), (False, False, 0, 0, "finish"), (False, False, 1, 2, "retry"), (False, False, 1, 3, "stop")]
    rows = spark.createDataFrame(cases, "paused boolean, changed boolean, code int, failures int, want string")
    assert all(r.want == r.got for r in rows.withColumn("got", logs.retry_decision(*map(F.col, ("paused", "changed", "code", "failures")))).collect())
