"""Mix sources to target weights by entropy balancing.

Each document gets a rate, how often the mix takes it, as near to 1 as the targets allow: of all rates between 0 and
the limit whose words meet their source's target, those of the least (bounded) relative entropy. They are exponentially
tilted by the document's words, and the tilt of a source solves the convex dual, one Newton step for all sources at a
time, each step one distributed sum. Rates are then rounded into copies: each document is rounded by a hash of its own,
against a threshold for its source at which the words taken come nearest to the target.

Sources are a table like any other: there may be any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import packed, stage, unstage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in turn, the share of all words that the mix takes, and how often a document is taken at most.
WEIGHTS, SHARE, LIMIT = (3.0, 1.0, 2.0), 1.5, 2
STEPS, CLOSE = 60, 1e-9
#: Rounding thresholds are found in so many bits, so many at a time.
KEY_BITS, DIGIT_BITS = 48, 6
_INF = float("inf")


def targets(sizes: DataFrame) -> tuple[DataFrame, float]:
    """source, words, target of each source of ``sizes`` (source, size, n), and the mean size of a document.

    The mix is shared out by weight, to sources in order of code points, null last. What would take a source beyond its
    limit goes to the others by weight, again and again until none is beyond.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows"))
    order = [F.col("source").isNull(), F.col("source")]
    # places in the order: within a range, and what the ranges before it have
    placed = stage(per.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("rows").alias("rows")).orderBy("part").collect()  # one row for each range
    before, rows = 0, []
    for r in parts:
        rows.append((r.part, before))
        before += r.n
    total = sum(r.words for r in parts)
    offsets = sizes.sparkSession.createDataFrame(rows, "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    weighed = stage(placed.join(F.broadcast(offsets), F.shiftright("at", 33) == F.col("part")).select("source", "words", weight.alias("weight")), "mix-weights")
    most = float(LIMIT) * F.col("words")
    unit, full = 0.0, -1
    while True:
        at_limit = F.col("weight") * F.lit(unit) >= most
        r = weighed.agg(F.sum(F.when(~at_limit, F.col("weight"))).alias("free"), F.sum(F.when(at_limit, most)).alias("used"), F.count(F.when(at_limit, 1)).alias("full")).first()
        if r.free is None or r.full == full:
            break
        unit, full = (SHARE * total - (r.used or 0.0)) / r.free, r.full
    target = F.when(F.col("weight") * F.lit(unit) >= most, most).otherwise(F.col("weight") * F.lit(unit))
    return weighed.select("source", "words", target.alias("target")), max(1.0, total / max(1, sum(r.rows for r in parts)))


def _with(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what ``sources`` has of their source."""
    renamed = sources.withColumnRenamed("source", "_name")
    return rows.join(renamed, F.col("source").eqNullSafe(F.col("_name")), how).drop("_name")


def _rate(mean: float) -> Column:
    """The limit times the logistic function of tilt and size; the words of a source at its limit are all taken."""
    at_limit = F.col("target") >= F.lit(float(LIMIT)) * F.col("words")
    return F.when(at_limit, F.lit(float(LIMIT))).otherwise(F.lit(float(LIMIT)) / (1 + F.exp(-F.col("tilt") * F.col("size") / F.lit(mean))))


def _key(rate: Column, hashed: Column) -> Column:
    """Order in which documents are rounded up: those of the largest remainder, less a uniform number of their own."""
    uniform = F.shiftrightunsigned(hashed, 16) / F.lit(float(1 << 48))
    order = (1 - (rate - F.floor(rate) - uniform)) / 2
    return F.least(F.floor(order * float(1 << KEY_BITS)), F.lit((1 << KEY_BITS) - 1)).cast("long")


def balanced(sizes: DataFrame, sources: DataFrame, mean: float) -> DataFrame:
    """``sources`` with the tilt of each: Newton steps on its dual, kept within the bracket that its sums have shown."""
    partly = (F.col("target") > 0) & (F.col("target") < LIMIT * F.col("words"))
    state = stage(sources.select("*", F.lit(0.0).alias("tilt"), F.lit(-_INF).alias("low"), F.lit(_INF).alias("high"), partly.alias("open")), "mix-tilts")
    rows = sizes.filter("size > 0")
    for _ in range(STEPS):
        if state.filter("open").isEmpty():
            break
        words, r = F.col("n") * F.col("size"), F.col("r")
        sums = _with(rows, state.filter("open")).withColumn("r", _rate(mean)).groupBy("source").agg(F.sum(words * r).alias("took"), F.sum(words * F.col("size") / mean * r * (1 - r / LIMIT)).alias("slope"))
        now = _with(state, sums, "left").withColumn("miss", F.col("took") - F.col("target"))
        now = now.withColumn("high", F.when(F.col("miss") > 0, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("miss") <= 0, F.col("tilt")).otherwise(F.col("low")))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("miss") / F.col("slope"))
        # where the step leaves the bracket, its middle, or further out where it has one end only
        ends = F.when((F.col("low") > -_INF) & (F.col("high") < _INF), (F.col("low") + F.col("high")) / 2).when(F.col("low") > -_INF, 2 * F.col("low") + 1).otherwise(2 * F.col("high") - 1)
        now = now.withColumn("step", newton).withColumn("step", F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise(ends))
        moves = F.coalesce(F.col("open") & (F.abs("miss") > CLOSE * F.col("target")) & (F.col("step") != F.col("tilt")), F.lit(False))
        after = stage(now.select("source", "words", "target", F.when(moves, F.col("step")).otherwise(F.col("tilt")).alias("tilt"), "low", "high", moves.alias("open")), "mix-tilts")
        unstage(state)
        state = after
    return state.select("source", "words", "target", "tilt")


def _thresholds(narrow: DataFrame, sources: DataFrame, mean: float) -> DataFrame:
    """``sources`` with the largest key of each that is rounded up, found digit by digit."""
    rows = _with(narrow.filter("size > 0"), sources).withColumn("r", _rate(mean))
    keyed = stage(rows.select("source", "size", F.floor("r").cast("int").alias("whole"), _key(F.col("r"), F.col("hash")).alias("key")), "mix-keys")
    wholes = keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("took"))
    lack = F.col("target") - F.coalesce("took", F.lit(0))
    state = _with(sources, wholes, "left").select("source", "words", "target", "tilt", lack.alias("lack"), F.lit(0).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("threshold"), (lack > 0).alias("open"))
    state = stage(state, "mix-thresholds")
    up = keyed.filter(F.col("whole") < LIMIT)
    for shift in range(KEY_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        if state.filter("open").isEmpty():
            break
        inside = _with(up, state.filter("open").select("source", "prefix", "lack")).filter(F.shiftright("key", shift + DIGIT_BITS) == F.col("prefix"))
        bins = inside.groupBy("source", "lack", F.shiftright("key", shift).alias("at")).agg(F.sum("size").alias("w"))  # 2**DIGIT_BITS of a source at most
        upto = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("source").orderBy("at")))
        chosen = upto.filter(F.col("upto") > F.col("lack")).groupBy("source").agg(F.min(F.struct("at", "w", "upto")).alias("bin"))
        left = F.col("lack") - (F.col("bin.upto") - F.col("bin.w"))
        # the last digit: a bin is taken if that comes nearer than leaving it
        last = F.when(F.col("bin.w") - left < left, F.col("bin.at")).otherwise(F.col("bin.at") - 1)
        every = F.shiftleft(F.col("prefix") + 1, shift + DIGIT_BITS) - 1  # all of them
        threshold = F.when(F.col("open") & F.col("bin").isNull(), every).when(F.col("open") & F.lit(shift == 0), last).otherwise(F.col("threshold"))
        now = _with(state, chosen, "left").select("source", "words", "target", "tilt", F.coalesce(left, F.col("lack")).alias("lack"), F.coalesce("bin.at", "prefix").alias("prefix"), threshold.alias("threshold"), (F.col("open") & F.col("bin").isNotNull()).alias("open"))
        after = stage(now, "mix-thresholds")
        unstage(state)
        state = after
    unstage(keyed)
    return state.select("source", "words", "target", "tilt", "threshold")


def mixed(docs: DataFrame) -> DataFrame:
    """row (a struct of the columns of ``docs``), size, source_size, target, rate, copies and taken of every row of ``docs``
    (doc_id, text, source and any others).

    A null or empty text has no words and is never taken. Null is a source, the last. Rows equal in doc_id and text are
    rounded alike; apart from that each row counts. Reruns agree, as all that is random is a hash of doc_id and text.
    An empty table gives none.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(packed(docs), F.col("source"), size.alias("size"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("hash"))
    narrow = stage(sized.select("source", "size", "hash"), "mix-sizes")
    # rates depend on source and size alone, so the dual is summed over these
    sizes = stage(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources, mean = targets(sizes)
    sources = _thresholds(narrow, balanced(sizes, sources, mean), mean)
    unstage(sizes)
    unstage(narrow)
    out = _with(sized, sources, "left").withColumn("rate", F.when(F.col("size") > 0, _rate(mean)).otherwise(0.0))
    up = (_key(F.col("rate"), F.col("hash")) <= F.col("threshold")) & (F.floor("rate") < LIMIT) & (F.col("size") > 0)
    out = out.withColumn("copies", (F.floor("rate") + up.cast("int")).cast("int"))
    return out.select("row", "size", F.col("words").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
