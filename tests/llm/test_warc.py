import gzip
import hashlib
import json
import os
from collections import Counter, defaultdict

import pytest

from factloom.llm import warc

SHORT, LONG = "<p>short</p>", "<p>" + "long " * 60 + "é</p>"


def slow(rows):
    """page_id, payload_bytes, digest, type, refers_to by the definition."""
    out, groups = Counter(), defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    for payload, ids in groups.items():
        digest = hashlib.sha256(payload).hexdigest()
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            out[i, len(payload), digest, "revisit" if again else "response", ids[0] if again else None] += 1
    return out


def rows_of(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rows = [(i, f"http://x/{i % 7}", f"<b>{i}</b>" + "page text " * (i % 50)) for i in range(120)]
    rows += [(200 + i, "http://copy/", LONG) for i in range(40)] + [(300 + i, None, SHORT) for i in range(5)] + [(7, "http://x/again", LONG)]
    rows += [(None, "http://null id/\r\nWARC-Type: x", "n" * 300), (None, None, LONG), (500, "é", None), (501, "u", ""), (400, "same", LONG), (400, "same", LONG), (600, "big", "y" * 3_000_000)]
    return rows


def test_records_come_back(spark, rows):
    # columns of other names, and names that the operator has itself
    df = spark.createDataFrame([(*r, 1, "a", 2.5) for r in rows], "page_id long, url string, html string, at int, member string, shard double").repartition(5)
    out = warc.archived(df)
    assert rows_of(out) == slow(rows)
    urls = {r.page_id: r.url for r in out.collect()}
    assert urls[None] in (None, "http://null%20id/%0D%0AWARC-Type:%20x") and urls[500] == "%C3%A9" and urls[300] is None
    assert warc.archived(df.limit(0)).count() == 0
    assert rows_of(warc.archived(df.filter("page_id = 500"))) == slow([r for r in rows if r[0] == 500])


def test_files(spark, rows, tmp_path):
    # a record larger than a file that doesn't fill a shard by itself
    rows = [r for r in rows if r[0] != 600] + [(600, "big", "".join(hashlib.sha256(b"%d" % i).hexdigest() for i in range(120)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    paths = [str(tmp_path / name) for name in ("a", "b")]
    for path, dealt in zip(paths, (df, df.selectExpr("html", "page_id", "url"))):
        warc.write_archives(dealt, path, shards=3, roll_bytes=2000)
    names = sorted(os.listdir(paths[0]))
    assert "_temporary" not in names or not os.listdir(paths[0] + "/_temporary")
    archives = [n for n in names if n.endswith(".warc.gz")]
    manifest = [json.loads(line) for line in open(paths[0] + "/manifest.jsonl")]
    assert [m["name"] for m in manifest] == archives and sum(m["records"] for m in manifest) == len(rows)
    assert {n.split("-")[1] for n in archives} == {"000000", "000001", "000002"} and len(archives) > 5
    ids = []
    for m in manifest:
        raw = open(f"{paths[0]}/{m['name']}", "rb").read()
        # the same rows give the same bytes, and files stay within their size but for one large record
        assert raw == open(f"{paths[1]}/{m['name']}", "rb").read() and hashlib.sha256(raw).hexdigest() == m["sha256"]
        assert len(raw) == m["bytes"] and (len(raw) <= 2000 or m["records"] == 1)
        ids += [line.split(": ")[1] for line in gzip.decompress(raw).decode("utf-8", "replace").split("\r\n") if line.startswith("WARC-Page-Id")]
    assert list(map(int, ids)) == sorted(r[0] for r in rows if r[0] is not None)
    back = {(r.page_id, r.record_type): r.payload for r in warc.read_archives(spark, paths[0]).collect()}
    assert back[600, "response"] == rows[-1][2].encode() and back[7, "response"] == LONG.encode() or back[7, "response"] == b"<b>7</b>" + b"page text " * 7


def test_damage_and_missing_manifest(spark, rows, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows[:20], "page_id long, url string, html string"), path, shards=1)
    file = f"{path}/pages-000000-00000.warc.gz"
    raw = open(file, "rb").read()
    for bad in (raw[:-40], raw + warc.member("warcinfo", [], b"")):
        open(file, "wb").write(bad)
        with pytest.raises(Exception, match="ends within a record|isn't the file"):
            warc.read_archives(spark, path).collect()
    os.remove(f"{path}/manifest.jsonl")
    with pytest.raises(Exception):
        warc.read_archives(spark, path).collect()


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    writer = warc.WarcWriter({"path": path})

    def batches():
        yield from ()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(batches())
    writer.abort([None])
    assert not os.path.exists(f"{path}/manifest.jsonl") and not os.listdir(f"{path}/_temporary")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Block-Digest: sha256:00\r\n\r\nabc\r\n\r\n")
