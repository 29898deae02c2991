import io
import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from factloom.streaming import heartbeat, tail


def test_ranges_have_every_line_once():
    rnd = random.Random(1)
    for _ in range(60):
        raw = b"".join(bytes(rnd.choice(b"ab\xc3 ") for _ in range(rnd.randint(0, 9))) + b"\n" for _ in range(rnd.randint(0, 12)))
        want, at = [], 0
        for line in raw.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        for split in (1, 2, 5, 1000):
            got = [x for part in tail.ranges({}, {"f": [len(raw), 1]}, split) for x in tail.lines(io.BytesIO(raw + b"rest"), part)]
            assert got == want
    assert tail.last_line_end(io.BytesIO(b"a\nbc"), 4) == 2 and tail.last_line_end(io.BytesIO(b"abc"), 3) == 0
    # longer: only the new bytes; shorter or with another first line: anew
    assert [(r.start, r.end) for r in tail.ranges({"f": [4, 7]}, {"f": [9, 7]})] == [(4, 9)]
    assert [(r.start, r.end) for r in tail.ranges({"f": [9, 7]}, {"f": [4, 7]})] == [(0, 4)]
    assert [(r.start, r.end) for r in tail.ranges({"f": [4, 7]}, {"f": [9, 8], "g": [0, None]})] == [(0, 9)]


def test_carried_line_truncation_and_restart(spark, tmp_path):
    folder, seen = tmp_path / "logs", []
    folder.mkdir()
    log = folder / "a.log"

    def go():
        seen.clear()
        rows = tail.appended_lines(spark, str(folder), split_bytes=7)
        # a new query each time, so it goes on from its checkpoint
        rows.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend((os.path.basename(r.file), r.position, r.line) for r in b.collect())).start().awaitTermination()
        return sorted(seen)

    log.write_bytes("first\nsécond\nunfin".encode())
    assert go() == [("a.log", 0, "first"), ("a.log", 6, "sécond")]
    with log.open("ab") as f:
        f.write(b"ished\n\nnext")
    (folder / "b.log").write_bytes(b"other\n")
    (folder / "_hidden").write_bytes(b"not a log\n")
    assert go() == [("a.log", 14, "unfinished"), ("a.log", 25, ""), ("b.log", 0, "other")]
    assert go() == []
    log.write_bytes(b"first\nx\n")  # truncated
    assert go() == [("a.log", 0, "first"), ("a.log", 6, "x")]
    log.write_bytes(b"another beginning that is longer than before\nx\ny\n")  # replaced
    assert [r[2] for r in go()] == ["another beginning that is longer than before", "x", "y"]


def slow_changes(signs, limit, end):
    """Second by second."""
    out, state, last = [], None, None
    at = {}
    for t, _, status in sorted(signs):
        at.setdefault(t, []).append(status)
    for t in range(0, end + 1):
        # a sign that comes just at the limit keeps the worker alive
        if state == "alive" and t > last + limit:
            state = "lost"
            out.append((last + limit, "lost"))
        for status in at.get(t, []):
            now = "alive" if status in heartbeat.RUNNING else status
            if now != state:
                out.append((t, now))
            state, last = now, t
    return out


def test_steps_against_a_clock():
    rnd = random.Random(2)
    for _ in range(200):
        signs = sorted((rnd.randint(0, 60), k, rnd.choice(["running", "running", "retry", "done", "paused"])) for k in range(rnd.randint(1, 12)))
        cut = rnd.randint(0, len(signs))  # in two batches
        out, last, state = heartbeat.steps(None, None, [(t, s) for t, _, s in signs[:cut]], 7)
        more, last, state = heartbeat.steps(last, state, [(t, s) for t, _, s in signs[cut:]], 7)
        if state == "alive":
            more.append((last + 7, "lost"))
        assert out + more == slow_changes(signs, 7, 100)


def test_a_log_that_stops(spark, tmp_path):
    """No row comes any more, and an empty batch tells that the worker is lost, 45 seconds after its last sign."""
    folder, seen = tmp_path / "logs", []
    folder.mkdir()
    now = datetime.now(timezone.utc)
    stamp = lambda ago: (now - timedelta(seconds=ago)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    (folder / "a.log").write_text("".join(f'{{"worker": "{w}", "ts": "{stamp(ago)}", "status": "{s}"}}\n' for w, ago, s in [("w", 60, "running"), ("w", 25, "running"), ("d", 25, "running"), ("d", 24, "done")]))
    rows = tail.appended_lines(spark, str(folder)).select("position", F.from_json("line", "worker string, ts timestamp, status string").alias("r"))
    signs = rows.select("r.*", F.col("position").alias("place"))
    with heartbeat.timer_settings(spark):
        query = heartbeat.worker_states(signs).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").foreachBatch(lambda b, n: seen.extend((n, r.worker, r.state, r["at"]) for r in b.collect())).start()
    try:
        until = time.time() + 90
        while time.time() < until and not any(s[2] == "lost" for s in seen):
            time.sleep(0.5)
        assert query.exception() is None
    finally:
        query.stop()
    first = [s for s in seen if s[0] == 0]
    assert sorted(s[1:3] for s in first) == [("d", "alive"), ("d", "done"), ("w", "alive")]
    lost = [s for s in seen if s[0] > 0]
    assert [s[1:3] for s in lost] == [("w", "lost")]
    assert abs((lost[0][3].astimezone(timezone.utc) - (now - timedelta(seconds=25) + timedelta(seconds=45))).total_seconds()) < 0.01


@pytest.mark.parametrize("batches", [1, 3])
def test_recorded_log(spark, tmp_path, batches):
    rnd = random.Random(6)
    signs = {w: sorted((rnd.randint(0, 3000), k, rnd.choice(["running", "retry", "done"])) for k in range(25)) for w in "abc"}
    signs["a"] = [s for s in signs["a"] if s[0] < 2000] + [(2000, 99, "running")]  # its log stops
    folder = tmp_path / "logs"
    folder.mkdir()
    flat = sorted((t, k, w, s) for w, rows in signs.items() for t, k, s in rows)
    zero, seen = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for n in range(batches):
        part = flat[n * len(flat) // batches : (n + 1) * len(flat) // batches]
        with open(folder / "a.log", "a") as f:
            f.writelines(f'{{"worker": "{w}", "ts": "{(zero + timedelta(seconds=t)).isoformat()}", "status": "{s}", "place": {k}}}\n' for t, k, w, s in part)
        rows = tail.appended_lines(spark, str(folder)).select(F.from_json("line", "worker string, ts timestamp, status string, place long").alias("r")).select("r.*")
        with heartbeat.timer_settings(spark):
            heartbeat.worker_states(rows, 100, recorded=True).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend((r.worker, int(r["at"].timestamp() - zero.timestamp()), r.state) for r in b.collect())).start().awaitTermination()
    end = flat[-1][0]
    # a timer fires once the clock is past it
    want = sorted((w, t, s) for w, rows in signs.items() for t, s in slow_changes(rows, 100, end + 200) if t < end or s != "lost")
    assert sorted(seen) == want and any(s == "lost" and t == signs[w][-1][0] + 100 for w, t, s in want)
