"""Pairs of texts whose sets of word shingles are similar (Jaccard), each checked by its sets.

Two sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each, in any order that holds for
all sets (the prefix filter), so no such pair is missed; of the smaller set the first n - ceil(2 t n / (1 + t)) + 1 are
enough. Shingles are ordered by their hash, common ones last: the first half
of each set is counted, then what is in front, until no common one comes to the front that wasn't known. A pair goes on only if the shingles that it
shares at the front and all that it could share behind reach the similarity; then its sets are compared.
Of the sets that share a shingle, each is first held against the least, then against the one with the fewest shingles of its
own, as the original of many edited copies has; only sets that are not linked yet are held against each other. What a set
has alone bounds what it can share: a copy with many edits meets none, so a large group of edited copies needs no square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shared import stage, unstage

SEED, WIDTH = 42, 5
#: Least similarity, as a fraction: whole numbers keep its limit exact.
SIMILARITY = (4, 5)
#: Sets that share a shingle from which on it counts as common, and common shingles that are sent to the workers in each
#: of the counts (16 bytes each). They only order the shingles; the result doesn't depend on them.
COMMON, SENT = 32, 500_000
#: Common shingles have places from here on; those of the others are 63 bits of their hashes.
BEHIND = 1 << 62
FRONT = ["key", "node", "n", "last", "place", "slast", "rare"]
#: Meetings for each row of an open front from which on a round by centres comes before them.
CROWDED = 2
#: How often they are counted at most.
_COUNTS = 8
#: Names of sets that a task remembers, so as not to send copies on; more are forgotten, which costs rows and nothing else.
_SEEN = 1 << 20


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the text's shingles, each once, in order; of a text with fewer words, of all its words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # of bytes: A-Z only, ASCII white space
    if not words:
        return np.empty(0, "i8")
    join, digest, n = b" ".join, xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    return np.unique(np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(n)), "u8", n).view("i8"))


def set_name(hashes: np.ndarray) -> int:
    """The name of a set: 64 bits of its hashes, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view("i8"))


def text_digest(text: str | None) -> bytes:
    return hashlib.md5(text.encode("utf-8", "replace") if text else b"").digest()


def digest_column(text: str = "text") -> Column:
    """What :func:`text_digest` gives, in SQL."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: tuple[int, int], width: int) -> DataFrame:
    """key, node, n, last, place, slast, rare: the first shingles of each set with its name, its size and the last of them in
    the order: as many as a pair of the similarity (a fraction) has one in common of. ``place`` is the shingle's place in the
    order, ``slast`` the last of those that are enough of the smaller set of a pair, ``rare`` how many of the first are not
    common. ``common`` has the common shingles in order of their hashes, and the place of each. Copies come once from a task."""
    p, q = similarity
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = sent.value
        seen: set[int] = set()
        for batch in batches:
            keys, at, nodes, sizes, lasts, slasts, rares, counts = [np.empty(0, "i8")], [np.empty(0, "i8")], [], [], [], [], [], []
            for text in batch.column(0):
                h = shingle_set(text.as_py(), width)
                n, node = len(h), set_name(h)
                if not n or node in seen:
                    continue
                seen.add(node)
                place = h >> 1
                if len(names):
                    i = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    place = np.where(names[i] == h, BEHIND + places[i], place)
                    order = np.argsort(place, kind="stable")
                    h, place = h[order], place[order]
                first = n - (p * n + q - 1) // q + 1
                few = n - (2 * p * n + p + q - 1) // (p + q) + 1
                keys.append(h[:first])
                at.append(place[:first])
                slasts.append(int(place[few - 1]))
                nodes.append(node)
                sizes.append(n)
                lasts.append(int(place[first - 1]))
                rares.append(int(np.count_nonzero(place[:first] < BEHIND)))
                counts.append(first)
            node, n, last, slast, rare = (pa.array(np.repeat(np.array(c, "i8"), counts)) for c in (nodes, sizes, lasts, slasts, rares))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), node, n, last, pa.array(np.concatenate(at)), slast, rare], names=FRONT)
            if len(seen) > _SEEN:
                seen.clear()

    return docs.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in FRONT))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and node, each once, those of keys with several nodes, with their key's first (a, m, la)."""
    key = node = None  # the last row
    head, rest, alone = (0, 0, 0), (0, 0, 0), False
    for batch in batches:
        out: list[tuple] = []
        for k, x, n, last, place, slast, rare in zip(*(batch.column(i).to_numpy().tolist() for i in range(7))):
            if k != key:
                key, node, head, alone, rest = k, x, (x, n, last), True, (place, slast, rare)
            elif x != node:
                node = x
                if alone:
                    out.append((k, *head, *rest, *head))
                    alone = False
                out.append((k, x, n, last, place, slast, rare, *head))
        cols = list(zip(*out)) if out else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*FRONT, "a", "m", "la"])


def _common(docs: DataFrame, similarity: tuple[int, int], width: int, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order of their hashes and the place of each, the rarest first."""
    names, counts = np.empty(0, "i8"), np.empty(0, "i8")
    for k in range(_COUNTS):
        places = np.empty(len(names), "i8")
        places[np.lexsort((names, counts))] = np.arange(len(names))
        # first the half of each set with the least hashes, then what is in front with the common ones behind
        front = _prefixes(docs, (names, places), (1, 2) if k == 0 else similarity, width)
        often = front.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > common)
        top = often.orderBy(F.desc("n"), "key").limit(SENT).toArrow()  # bounded by SENT
        key, n = top.column("key").to_numpy(), top.column("n").to_numpy()
        fresh = ~np.isin(key, names)
        if k and not fresh.any():
            break
        names, counts = np.append(names, key[fresh]), np.append(counts, n[fresh])
        order = np.argsort(names)
        names, counts = names[order], counts[order]
        if k and n[fresh].max() <= 4 * common:  # too few sets each to matter
            break
    places = np.empty(len(names), "i8")
    places[np.lexsort((names, counts))] = np.arange(len(names))
    return names, places


def _alike(n: str, m: str, similarity: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be similar."""
    p, q = similarity
    return q * F.least(n, m) >= p * F.greatest(n, m)


def _likely(pairs: DataFrame, similarity: tuple[int, int], short: bool = False) -> DataFrame:
    """a, b: those of ``pairs`` (a, b, n, m, last, la; one row for each shared key) that can be similar. ``short``: of a,
    with m and la, only what is enough of the smaller set was met."""
    p, q = similarity
    behind = {"n": f"({p} * n + {q - 1}) DIV {q} - 1", "m": f"(2 * {p} * m + {p + q - 1}) DIV {p + q} - 1" if short else f"({p} * m + {q - 1}) DIV {q} - 1"}
    rest = lambda n: F.expr(behind[n])
    met = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("n", "m", "last", "la")])
    # what both have in order up to where the first of the two fronts ends is counted
    most = F.when(F.col("last") < F.col("la"), rest("n")).when(F.col("last") > F.col("la"), rest("m")).otherwise(F.greatest(rest("n"), rest("m")))
    return met.filter((p + q) * (F.col("c") + most) >= p * (F.col("n") + F.col("m"))).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: tuple[int, int], width: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar, by the sets of the texts (digest, id) that ``nodes`` names."""
    p, q = similarity
    pairs = stage(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "shingle-pairs")
    taken = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("digest", "id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.empty(0, "i8"), *found])))
            yield pa.RecordBatch.from_arrays([pa.array([set_name(h) for h in found], pa.int64()), lists], names=["node", "shingles"])

    texts = docs.select("text", "digest", "id").join(taken, ["digest", "id"], "left_semi")
    of = stage(texts.select("text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "shingle-sets")
    left, right = (of.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("sa", "sb")))
    out = stage(both.filter(q * F.col("o") >= p * (F.size("sa") + F.size("sb") - F.col("o"))).select("a", "b"), "shingle-links")
    unstage(of)
    return out


def _open(held: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``held`` at shingles that sets of several groups have, with the group (root) by the links ``found`` and how
    many of the set's first shingles that are not common none of another group has among its first (own)."""
    rooted = held.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    left = stage(rooted.join(apart, "key", "left_semi"), "open-shingles")
    met = left.groupBy("node").agg(F.count_if(F.col("place") < BEHIND).alias("met"))
    out = stage(left.join(met, "node").withColumn("own", F.col("rare") - F.col("met")).drop("met"), "open-shingles")
    unstage(left)
    return out


def _bounded(x: str, y: str, similarity: tuple[int, int]) -> Column:
    """Whether two sets of different groups can share enough. If the last of a set's first shingles is common, then all of its
    others are among the first, and it has none of what the other set has alone."""
    p, q = similarity
    c = lambda side, name: F.col(f"{side}{name}")
    most = lambda a, b: c(a, "n") - F.when(c(b, "last") >= BEHIND, c(a, "own")).otherwise(0)
    return (p + q) * F.least(most(x, y), most(y, x)) >= p * (c(x, "n") + c(y, "n"))


def _crowded(open_: DataFrame) -> bool:
    """Whether sets of different groups would meet more than :data:`CROWDED` times for each row."""
    of = open_.groupBy("key", "root").agg(F.count("*").alias("n"), F.count_if(F.col("place") <= F.col("slast")).alias("s"))
    of = of.groupBy("key").agg(F.sum("n").alias("n"), (F.sum("n") * F.sum("s") - F.sum(F.col("n") * F.col("s"))).alias("met"))
    n, met = of.agg(F.sum("n"), F.sum(F.col("met").cast("double"))).first()
    return bool(n) and met > CROWDED * n


def links(docs: DataFrame, nodes: DataFrame, likely: DataFrame, similarity: tuple[int, int] = SIMILARITY, width: int = WIDTH, common: int = COMMON) -> DataFrame:
    """a, b: pairs of similar sets, enough to join all that are linked.

    ``docs`` has text, digest and id; ``nodes`` has for each set its name (node) and digest and id of one of its texts;
    ``likely`` has pairs (a, b) of names to be checked first.
    """
    order = _common(docs, similarity, width, common)
    fronts = _prefixes(docs, order, similarity, width)
    held = stage(fronts.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_runs, ", ".join(f"{c} long" for c in [*FRONT, "a", "m", "la"])), "shared-shingles")
    stars = held.filter(F.col("node") != F.col("a")).filter(_alike("n", "m", similarity)).withColumnRenamed("node", "b")
    found = verified(likely.unionByName(_likely(stars, similarity)), docs, nodes, similarity, width)
    open_ = _open(held.drop("a", "m", "la"), found)
    if _crowded(open_):
        centre = open_.groupBy("key").agg(F.min(F.struct("own", "node", "n", "last", "root")).alias("c"))
        met = open_.join(centre, "key").filter(F.col("root") != F.col("c.root")).select("node", "n", "last", "own", *[F.col("c")[c].alias(f"c_{c}") for c in ("node", "n", "last", "own")])
        met = met.filter(_alike("n", "c_n", similarity)).filter(_bounded("", "c_", similarity))
        pairs = met.select(F.col("node").alias("a"), F.col("c_node").alias("b"), "n", F.col("c_n").alias("m"), "last", F.col("c_last").alias("la"))
        found = found.unionByName(verified(_likely(pairs, similarity), docs, nodes, similarity, width))
        before, open_ = open_, _open(open_.drop("root", "own"), found)
        unstage(before)
    # the smaller set of a pair by its short front, so that what very many sets have is met by few
    x, y = open_.filter("place <= slast").alias("x"), open_.alias("y")
    smaller = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    met = (F.col("x.key") == F.col("y.key")) & smaller & (F.col("x.root") != F.col("y.root")) & _alike("x.n", "y.n", similarity) & _bounded("x.", "y.", similarity)
    pairs = x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n"), F.col("x.slast").alias("la"), F.col("y.last").alias("last"))
    return found.unionByName(verified(_likely(pairs, similarity, short=True), docs, nodes, similarity, width))
