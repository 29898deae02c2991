import pytest
from pyspark.sql import functions as F

from factloom.sources.ledger import GENESIS, Ledger, link
from factloom.sources.store import Refused, Store


@pytest.fixture
def book(spark, tmp_path):
    b = Ledger(Store(spark, str(tmp_path / "kb")), "looks", size=4)
    rows = lambda ids: spark.createDataFrame([(i, None if i == 7 else f"look {i}") for i in ids], "id long, content string")
    head = b.append(rows(range(10)).repartition(3), [F.asc("id")], GENESIS)
    b.append(rows(range(10, 15)), [F.asc("id")], head)
    b.rows = rows
    return b


def found(book):
    return sorted(tuple(r) for r in book.broken().collect())


def test_the_chain_by_hand(book):
    rows = sorted(tuple(r) for r in book.store.read("looks").collect())
    assert [(s, p) for s, p, *_ in rows] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 8), (2, 9), (3, 10), (3, 11), (3, 12), (3, 13), (4, 14)]
    head = GENESIS
    for segment in range(5):
        last = link(GENESIS, str(segment))
        for s, _, content, digest in rows:
            if s == segment:
                last = link(last, content)
                assert digest == last
        head = link(head, last)
    assert book.head() == head and found(book) == []


def test_a_change_in_any_segment_is_found(book, spark):
    good, heads = book.store.read("looks"), book.store.read("looks_heads")
    for place in range(15):
        for content in ("other", None if place != 7 else ""):
            if (place % 5, content) not in ((0, "other"), (2, None), (2, "")):
                continue
            book.store.publish("looks", good.withColumn("content", F.when(F.col("place") == place, F.lit(content)).otherwise(F.col("content"))))
            segment = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 3, 4][place]
            assert found(book) == [(segment, place, "entry")]
    # the last entry of a segment is gone, and a whole segment
    book.store.publish("looks", good.filter("place <> 9"))
    assert found(book) == [(2, 8, "segment")]
    book.store.publish("looks", good.filter("segment <> 3"))
    assert found(book) == [(3, 10, "segment")]
    # entry and digests of a segment made anew: its head tells, and with that made anew too the next one
    store = Store(spark, book.store.path + "-forged")
    other = Ledger(store, "looks", size=4)
    other.append(book.rows([0, 1, 2, 3, 4, 99, 6, 7]), [F.asc("id")], GENESIS)
    forged = store.read("looks").filter("segment = 1")
    book.store.publish("looks", good.filter("segment <> 1").unionByName(forged))
    assert [f[::2] for f in found(book)] == [(1, "segment")]
    book.store.publish("looks_heads", heads.filter("segment <> 1").unionByName(store.read("looks_heads").filter("segment = 1")))
    assert [f[::2] for f in found(book)] == [(2, "head")]


def test_two_writers_one_is_refused(book):
    seen = book.head()
    book.append(book.rows([20]), [F.asc("id")], seen)
    with pytest.raises(Refused):
        book.append(book.rows([21]), [F.asc("id")], seen)
    # both have read before one writes
    other = Ledger(book.store, "looks", size=4)
    seen, real = book.head(), other.store._publish

    def late(*changes):
        other.store._publish = real
        Ledger(book.store, "looks", size=4).append(book.rows([30]), [F.asc("id")], seen)
        return real(*changes)

    other.store._publish = late
    with pytest.raises(Refused):
        other.append(book.rows([31]), [F.asc("id")], seen)
    assert found(book) == [] and book.append(book.rows([]), [F.asc("id")], book.head()) == book.head()
    assert book.store.read("looks").count() == 17
