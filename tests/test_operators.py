import zlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import matching, sequences
from factloom.operators import graphs, statistics
from factloom.sources import loaders


def test_sequences(spark):
    assert sequences.align(list("kitten"), list("sitting"))[0] == 3 and sequences.align([], ["a", "b"]) == (2, 1)
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), (None, []), (["$x", "add", "$y", "$x"], ["q"])], "a array<string>, b array<string>")
    out = df.select(sequences.aligned("a", "b").alias("x"), matching.change_vector("a", "b").alias("c"), matching.block_distance("a", "b").alias("d"), sequences.renamed_apart("a").alias("r")).collect()
    assert out[0].x.cost == 2 and out[0].c.changed == 1 and out[0].c.added == 1
    assert out[1].x.cost == 0 and out[1].d == 0 and out[1].r is None
    assert out[2].r == "r0 add r1 r0"
    row = spark.createDataFrame([("text",), (None,)], "t string").select(sequences.packed("t").alias("p")).withColumn("u", sequences.unpacked("p")).collect()
    assert zlib.decompress(row[0].p) == b"text" and row[0].u == "text" and row[1].u is None


def test_paired_arms_must_be_whole(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "id long, v long"), spark.createDataFrame([(1, 5)], "id long, v long")
    assert statistics.paired(a, a, "id", "v").count() == 2
    with pytest.raises(Exception, match="an arm lacks"):
        statistics.paired(a, b, "id", "v").collect()


def test_sign_test_and_power(spark):
    pairs = spark.createDataFrame([(i, 1) for i in range(9)] + [(9, -1), (10, 0)], "g long, d long")
    r = statistics.sign_test(pairs, "g", F.col("d")).first()
    assert (r.wins, r.losses) == (9, 1) and abs(r.p - 22 / 1024) < 1e-12
    assert statistics.sign_test(pairs.limit(0), "g", F.col("d")).first().p == 1.0
    cases = spark.createDataFrame([(40, 0.8), (3, 0.9)], "groups long, share double")
    power = {r.groups: r.power for r in statistics.sign_test_powers(cases).collect()}
    assert 0.9 < power[40] < 1 and power[3] == 0


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {r.node for r in graphs.reachable(edges, spark.createDataFrame([(2,)], "node long")).collect()} == {1, 2, 3, 4}
    assert {r.node: r.level for r in graphs.levels(edges).collect()} == {1: None, 2: None, 3: None, 4: 0}
    assert {r.node: r.component for r in graphs.strong_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_image_headers(spark, tmp_path):
    plain = bytes.fromhex("80371240") + bytes(4) + (0x80000400).to_bytes(4, "big") + bytes(20) + b"A TITLE".ljust(20) + bytes(7) + b"NABE\0" + bytes(range(8))
    swap = lambda raw, w: b"".join(raw[i : i + w][::-1] for i in range(0, len(raw), w))
    for w, name in ((1, "z64"), (2, "v64"), (4, "n64")):
        (tmp_path / name).write_bytes(swap(plain, w))
    rows = loaders.image_headers(loaders.images(spark, str(tmp_path))).collect()
    assert {(r.path.rsplit("/", 1)[1], r.byte_order) for r in rows} == {(n, n) for n in ("z64", "v64", "n64")}
    assert {(bytes(r.content), r.size, r.entry, r.title, r.game_code) for r in rows} == {(plain, len(plain), 0x80000400, "A TITLE", "NABE")}
    for bad in (b"", None, plain[:40], b"\0" + plain[1:], swap(plain, 2) + b"x"):
        with pytest.raises(Exception, match="not an image: p"):
            loaders.image_headers(spark.createDataFrame([("p", bad)], "path string, content binary")).collect()


def test_commits(spark, tmp_path):
    (tmp_path / "log").write_text("\x1eaa\x1f2024\x1fme\x1fFirst\n\nbody\n\x1d\n\nM\tx.c\nR090\told.c\tnew.c\nodd\n\x1ebb\x1f2025\x1fyou\x1f\x1d\n\x1ebroken\x1d\n\x1eno end")
    rows = {r.sha: r for r in loaders.commits(spark, str(tmp_path / "log")).collect()}
    assert rows.keys() == {"aa", "bb"} and rows["bb"].changes == [] and rows["bb"].message == ""
    assert rows["aa"].message == "First\n\nbody" and [tuple(c) for c in rows["aa"].changes] == [("M", None, "x.c"), ("R090", "old.c", "new.c")]
