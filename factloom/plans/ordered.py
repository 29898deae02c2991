"""Queries of interval, lineage and graph operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from factloom.operators import graphs, intervals, order
from factloom.plans.registry import Registry, statement, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_OFFSETS = "SELECT DISTINCT l_suppkey AS k, l_partkey AS pos FROM lineitem WHERE l_quantity > 25"


@R.add("w4_stride_runs", f"WITH p AS ({_OFFSETS}), i AS (SELECT *, pos - 4 * row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY k, g) AS n FROM i) SELECT k, pos FROM n WHERE n >= 2")
def stride_runs(spark, sf_dir):
    return intervals.stride_runs(statement(spark, sf_dir, _OFFSETS), ["k"], "pos", 4, 2)


@R.add("w5_gap_clusters", f"""WITH p AS ({_OFFSETS}), s AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) > 8 THEN 1 ELSE 0 END AS st FROM p),
    c AS (SELECT *, CAST(sum(st) OVER (PARTITION BY k ORDER BY pos) AS BIGINT) AS cluster FROM s) SELECT k, cluster, count(*) AS fields, min(pos) AS base, max(pos) AS top FROM c GROUP BY k, cluster HAVING count(*) >= 2""")  # fmt: skip
def gap_clusters(spark, sf_dir):
    c = intervals.gap_clusters(statement(spark, sf_dir, _OFFSETS), ["k"], "pos", 8)
    return c.groupBy("k", "cluster").agg(F.count("*").alias("fields"), F.min("pos").alias("base"), F.max("pos").alias("top")).filter("fields >= 2")


_SPANS = "SELECT l_suppkey AS k, l_partkey AS s, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey + CAST(l_quantity / 5 AS INT) END AS e, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_quantity IN (5.0, 10.0, 20.0, 45.0) AND l_discount > 0.08"


@R.add("w6_interval_clusters", f"""WITH p AS (SELECT k, s, e, min(id) AS id FROM ({_SPANS}) x GROUP BY k, s, e), b AS (SELECT *, max(e) OVER w AS far, lag(e IS NULL) OVER (PARTITION BY k ORDER BY s, id) AS bar FROM p
    WINDOW w AS (PARTITION BY k ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, CAST(sum(CASE WHEN coalesce(bar, false) OR s - far > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM b)
    SELECT k, cluster, count(*) AS n, min(s) AS lo, max(e) AS hi FROM c GROUP BY k, cluster""")  # fmt: skip
def interval_clusters(spark, sf_dir):
    p = statement(spark, sf_dir, _SPANS).groupBy("k", "s", "e").agg(F.min("id").alias("id"))
    c = intervals.interval_clusters(p, ["k"], "s", "e", 40, "id")
    return c.groupBy("k", "cluster").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("e").alias("hi"))


@R.add("w7_overlaps_next", f"WITH p AS ({_SPANS}), n AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY s, id) AS next_start FROM p) SELECT k, s, e, id, next_start FROM n WHERE next_start < e")
def overlaps_next(spark, sf_dir):
    return intervals.overlaps_next(statement(spark, sf_dir, _SPANS), ["k"], "s", "e", "id")


@R.add("w8_uncovered_gaps", f"WITH p AS ({_SPANS}), n AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM p) SELECT k, gap_start, s AS gap_end FROM n WHERE gap_start < s")
def uncovered(spark, sf_dir):
    return intervals.uncovered(statement(spark, sf_dir, _SPANS), ["k"], "s", "e", "id")


@R.add("w11_sliding_windows", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS t FROM documents)
    SELECT doc_id, CAST(i AS INT) AS i, array_to_string(t[i:i+2], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 1, 1))) AS i FROM w WHERE len(t) >= 3) x""")  # fmt: skip
def sliding_windows(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.expr("filter(split(lower(text), '[^a-z]+'), x -> x <> '')").alias("t"))
    return t.filter("size(t) >= 3").select("doc_id", F.posexplode(F.expr("transform(sequence(1, size(t) - 2), i -> array_join(slice(t, i, 3), ' '))")).alias("i", "gram")).withColumn("i", F.col("i") + 1)


@R.add("w12_proximity_groups", """WITH h AS (SELECT user_id AS k, event_id AS pos FROM events WHERE event_type = 'error'), s AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) > 150 THEN 1 ELSE 0 END AS st FROM h),
    c AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY pos) AS c FROM s) SELECT k, min(pos) AS first_pos, count(*) AS n FROM c GROUP BY k, c HAVING count(*) > 1""")  # fmt: skip
def proximity_groups(spark, sf_dir):
    hits = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("k"), F.col("event_id").alias("pos"))
    return intervals.gap_clusters(hits, ["k"], "pos", 150).groupBy("k", "cluster").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n")).filter("n > 1").drop("cluster")


@R.add("w13_plateau", """WITH g AS (SELECT user_id, event_id, value, value - lag(value) OVER o AS gain, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    w AS (SELECT *, max(gain) OVER f AS most, avg(abs(gain)) OVER f AS drift FROM g WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT user_id, count(*) FILTER (WHERE n >= 5 AND most <= 20 AND drift <= 40) AS plateaus FROM w GROUP BY user_id""")  # fmt: skip
def plateau(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["w13_plateau"])


@R.add("w16_stopping_budget", "SELECT user_id, event_id FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) x WHERE spent <= 500")
def stopping_budget(spark, sf_dir):
    return intervals.running_budget(table(spark, sf_dir, "events"), ["user_id"], [F.col("event_id")], "value", 500).select("user_id", "event_id")


@R.add("w16_skipping_budget", """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
    f AS (SELECT user_id, event_id, rn, value <= 300 AS keep, CASE WHEN value <= 300 THEN 300 - value ELSE 300 END AS rest FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, e.value <= f.rest, CASE WHEN e.value <= f.rest THEN f.rest - e.value ELSE f.rest END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT user_id, event_id FROM f WHERE keep""")  # fmt: skip
def skipping_budget(spark, sf_dir):
    return intervals.skipping_budget(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 300).select("user_id", "event_id")


@R.add("w10_hash_chain", """WITH c AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS entry FROM events) SELECT count(*) AS links, count(*) FILTER (WHERE NOT coalesce(prev = expected, true)) AS broken FROM
    (SELECT event_id, CASE WHEN event_id % 1000 = 999 THEN 'tampered' ELSE lag(entry) OVER (ORDER BY event_id) END AS prev, lag(entry) OVER (ORDER BY event_id) AS expected FROM c) x""")  # fmt: skip
def hash_chain(spark, sf_dir):
    c = order.numbered(table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("entry")), [F.asc("event_id")])
    before = c.select((F.col("place") + 1).alias("place"), F.col("entry").alias("expected"))
    chain = c.join(before, "place", "left").withColumn("prev", F.when(F.col("event_id") % 1000 == 999, F.lit("tampered")).otherwise(F.col("expected")))
    return chain.agg(F.count("*").alias("links"), F.count_if(~F.coalesce(F.col("prev") == F.col("expected"), F.lit(True))).alias("broken"))


@R.add("w20_exploration_slots", """WITH r AS (SELECT p_partkey, p_size % 3 = 0 AS rare, row_number() OVER (PARTITION BY p_size % 3 = 0 ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part)
    SELECT p_partkey, CASE WHEN rare THEN 4 * i + 3 ELSE CAST(floor(i / 3) AS BIGINT) * 4 + i % 3 END AS slot FROM r""")  # fmt: skip
def exploration_slots(spark, sf_dir):
    """Every fourth slot goes to an exploring candidate while there are any; a slot number, so gaps close when sorted."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.coalesce(F.col("p_size") % 3 == 0, F.lit(False)).alias("rare"))
    placed = [order.numbered(part.filter(F.col("rare") == which), [F.desc("p_retailprice"), F.asc("p_partkey")], "i").select("p_partkey", slot.cast("long").alias("slot")) for which, slot in ((True, 4 * F.col("i") + 3), (False, F.floor(F.col("i") / 3) * 4 + F.col("i") % 3))]
    return placed[0].unionByName(placed[1])


@R.add("j12_containment", "WITH s AS (SELECT p_partkey AS id, p_partkey * 40 AS lo, p_partkey * 40 + p_size AS hi FROM part), p AS (SELECT event_id AS x FROM events) SELECT x, id FROM p JOIN s ON x >= lo AND x <= hi")
def containment(spark, sf_dir):
    spans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 40).alias("lo"), (F.col("p_partkey") * 40 + F.col("p_size")).alias("hi"))
    return intervals.contained_in(table(spark, sf_dir, "events").select(F.col("event_id").alias("x")), spans, "x", "lo", "hi", 64).select("x", "id")


@R.add("j13_as_of", """WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
    SELECT l.event_id, l.user_id, r.v AS click_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")  # fmt: skip
def as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left, right = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.filter("event_type = 'click'").select("user_id", "ts", "value")
    return intervals.as_of(left, right, ["user_id"], "ts", "value", "click_value").select("event_id", "user_id", "click_value")


@R.add("j14_neighbour_window", """WITH m AS (SELECT user_id, event_id, value > 200 AS hit FROM events), n AS (SELECT *, lag(hit) OVER o AS b, lead(hit) OVER o AS a FROM m WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id FROM n WHERE hit OR coalesce(a, false) OR coalesce(b, false)""")  # fmt: skip
def neighbour_window(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["j14_neighbour_window"])


@R.add("d7_interval_catalog", f"""WITH p AS (SELECT k, s, e, min(id) AS id FROM ({_SPANS}) x WHERE e IS NOT NULL GROUP BY k, s, e), b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM p)
    SELECT k, CAST(sum(greatest(e - greatest(s, coalesce(far, s)), 0)) AS BIGINT) AS covered, CAST(sum(e - s) AS BIGINT) AS total FROM b GROUP BY k""")  # fmt: skip
def interval_catalog(spark, sf_dir):
    from pyspark.sql import Window

    p = statement(spark, sf_dir, _SPANS).filter("e IS NOT NULL").groupBy("k", "s", "e").agg(F.min("id").alias("id"))
    far = F.max("e").over(Window.partitionBy("k").orderBy("s", "id").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("e") - F.greatest("s", F.coalesce("far", "s")), F.lit(0))
    return p.withColumn("far", far).groupBy("k").agg(F.sum(fresh).alias("covered"), F.sum(F.col("e") - F.col("s")).alias("total"))


# --- places in the order of a whole table ---
@R.add("w15_forward_outcome", """WITH c AS (SELECT ts AS cut FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events) x WHERE rn = CAST(floor(n * 0.7) AS BIGINT) + 1),
      g AS (SELECT user_id, count(*) FILTER (WHERE ts < cut) AS before_n, max(CASE WHEN ts < cut THEN value END) AS before_best, max(CASE WHEN ts >= cut THEN value END) AS after_best FROM events CROSS JOIN c GROUP BY user_id)
      SELECT user_id, before_best, after_best, coalesce(after_best > before_best + 1, false) AS improved FROM g WHERE before_n >= 3 AND before_best < 300""")  # fmt: skip
def forward_outcome(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    places = order.numbered(e.select("ts", "event_id"), [F.asc("ts"), F.asc("event_id")])
    at = F.floor(F.lit(e.count()) * 0.7)
    cut = F.broadcast(places.filter(F.col("place") == at).select(F.col("ts").alias("cut")))  # one row
    early = F.col("ts") < F.col("cut")
    g = e.crossJoin(cut).groupBy("user_id").agg(F.count_if(early).alias("n"), F.max(F.when(early, F.col("value"))).alias("before_best"), F.max(F.when(~early, F.col("value"))).alias("after_best"))
    improved = F.coalesce(F.col("after_best") > F.col("before_best") + 1, F.lit(False))
    return g.filter("n >= 3 AND before_best < 300").select("user_id", "before_best", "after_best", improved.alias("improved"))


@R.add("w17_fixed_cost_cut", """SELECT p_partkey, rn FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) x WHERE rn <= least(CAST(floor(1000 / 15.0) AS INT), 40)""")
def fixed_cost_cut(spark, sf_dir):
    most = min(int(1000 / 15.0), 40)
    best = [F.desc("p_retailprice"), F.asc("p_partkey")]
    top = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(*best).limit(most)
    return order.numbered(top, best, "rn").select("p_partkey", (F.col("rn") + 1).cast("int").alias("rn"))


@R.add("w18_round_robin", """SELECT p_partkey, p_type, place FROM (SELECT p_partkey, p_type, row_number() OVER (ORDER BY rn, p_type, p_partkey) AS place FROM
      (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part) x) y WHERE place <= 60""")  # fmt: skip
def round_robin(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    # no stratum has more of the first 60 than its own first 60
    first = table(spark, sf_dir, "part").select("p_partkey", "p_type", place.alias("rn")).filter("rn <= 60")
    turn = [F.asc("rn"), F.asc("p_type"), F.asc("p_partkey")]
    return order.numbered(first.orderBy(*turn).limit(60), turn).select("p_partkey", "p_type", (F.col("place") + 1).cast("int").alias("place"))


@R.add("w19_quantile_cohorts", """WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS ix, count(*) OVER () AS n FROM part),
      pick AS (SELECT DISTINCT i, CAST(floor((i + 0.5) * n / 40) AS BIGINT) AS ix FROM o CROSS JOIN (SELECT CAST(ix AS INT) AS i FROM o WHERE ix < 40) k)
      SELECT o.p_partkey, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END AS cohort FROM pick JOIN o ON pick.ix = o.ix""")  # fmt: skip
def quantile_cohorts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    n = part.count()
    picks = spark.createDataFrame([(i, math.floor((i + 0.5) * n / 40)) for i in range(min(40, n))], "i int, place long")
    placed = order.numbered(part, [F.asc("p_retailprice"), F.asc("p_partkey")])
    return placed.join(F.broadcast(picks), "place").select("p_partkey", F.when(F.col("i") % 2 == 0, "a").otherwise("b").alias("cohort"))


@R.add("w22_retention", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS newest, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS of_day FROM events) x
      WHERE newest <= 20 OR of_day = 1 OR event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 300)""")  # fmt: skip
def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = e.select("event_id").orderBy(F.desc("event_id")).limit(20)
    of_day = e.groupBy(F.to_date("ts").alias("day")).agg(F.max(F.struct("ts", "event_id")).alias("last")).select("last.event_id")
    pinned = e.filter("event_type = 'purchase' AND value > 300").select("event_id")
    return newest.union(of_day).union(pinned).distinct()


@R.add("d6_differential_blame", """WITH s AS (SELECT user_id, count(*) AS support, max(ts) AS latest, max(value) AS worst FROM events GROUP BY user_id)
      SELECT user_id, rank() OVER (ORDER BY support) + rank() OVER (ORDER BY latest DESC) + rank() OVER (ORDER BY worst DESC) AS blame FROM s""")  # fmt: skip
def differential_blame(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("support"), F.max("ts").alias("latest"), F.max("value").alias("worst"))
    ranked = order.ranks(order.ranks(order.ranks(s, "support", "a"), "latest", "b", descending=True), "worst", "c", descending=True)
    return ranked.select("user_id", (F.col("a") + F.col("b") + F.col("c")).alias("blame"))


# --- graphs: a part depends on parts with smaller keys; conversations are chains ---
_DEPS = "SELECT DISTINCT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey > 0 AND p_size > 40"
_CYCLIC = "SELECT p_partkey AS src, p_partkey - p_partkey % 10 + (p_partkey * 7 + 3) % 10 AS dst FROM part WHERE p_size > 5"


@R.add("g1_transitive_closure", f"WITH RECURSIVE e AS ({_DEPS}), r AS (SELECT CAST(5 AS BIGINT) AS node UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node FROM r")
def closure(spark, sf_dir):
    e = statement(spark, sf_dir, _DEPS).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.reachable(e, spark.createDataFrame([(5,)], "node long"))


@R.add("g2_affected_entities", f"WITH RECURSIVE e AS ({_DEPS}), r AS (SELECT CAST(7 AS BIGINT) AS node UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT DISTINCT l_suppkey AS entity FROM lineitem WHERE l_partkey IN (SELECT node FROM r)")
def affected(spark, sf_dir):
    e = statement(spark, sf_dir, _DEPS).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = graphs.reachable(e, spark.createDataFrame([(7,)], "node long"))
    return table(spark, sf_dir, "lineitem").join(hit, F.col("l_partkey") == F.col("node"), "left_semi").select(F.col("l_suppkey").alias("entity")).distinct()


@R.add("g3_stale_propagation", f"WITH RECURSIVE e AS ({_DEPS}), r AS (SELECT p_partkey AS node FROM part WHERE p_type = 'PROMO' AND p_size = 50 UNION SELECT e.src FROM r JOIN e ON e.dst = r.node) SELECT node FROM r")
def stale(spark, sf_dir):
    e = statement(spark, sf_dir, _DEPS).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.reachable(e, table(spark, sf_dir, "part").filter("p_type = 'PROMO' AND p_size = 50").select(F.col("p_partkey").alias("node")))


@R.add("g4_strong_components", f"""WITH RECURSIVE e AS ({_CYCLIC}), r AS (SELECT src AS a, src AS b FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")  # fmt: skip
def strong_components(spark, sf_dir):
    return graphs.strong_components(statement(spark, sf_dir, _CYCLIC))


@R.add("g5_levels", f"WITH RECURSIVE e AS ({_DEPS}), r AS (SELECT dst AS node, 0 AS level FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def topological_levels(spark, sf_dir):
    return graphs.levels(statement(spark, sf_dir, _DEPS))


@R.add("g6_cyclic_members", f"WITH RECURSIVE e AS ({_CYCLIC}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT a AS node FROM r WHERE a = b")
def cyclic_members(spark, sf_dir):
    e = statement(spark, sf_dir, _CYCLIC)
    c = graphs.strong_components(e)
    loops = e.filter("src = dst").select(F.col("src").alias("node"))
    big = c.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return c.join(big, "component", "left_semi").select("node").union(loops).distinct()


@R.add("g8_ready_and_blocked", f"""WITH e AS ({_DEPS}), d AS (SELECT p_partkey AS node FROM part WHERE p_size < 25), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT * FROM e WHERE dst NOT IN (SELECT node FROM d))
    SELECT n.node, (SELECT count(DISTINCT dst) FROM o WHERE o.src = n.node) AS pending, (SELECT count(DISTINCT src) FROM o WHERE o.dst = n.node AND src NOT IN (SELECT node FROM d)) AS unblocks FROM n WHERE n.node NOT IN (SELECT node FROM d)""")  # fmt: skip
def ready(spark, sf_dir):
    return graphs.ready_and_blocked(statement(spark, sf_dir, _DEPS), table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("node")))


@R.add("g9_work_queue", f"""WITH e AS ({_DEPS}), w AS (SELECT dst AS node, count(DISTINCT src) AS unblocks FROM e GROUP BY dst) SELECT p_partkey, coalesce(unblocks, 0) AS unblocks, p_size FROM part LEFT JOIN w ON p_partkey = node
    WHERE p_size <= 30 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) ORDER BY unblocks DESC, p_size, p_partkey LIMIT 100""")  # fmt: skip
def work_queue(spark, sf_dir):
    e, part = statement(spark, sf_dir, _DEPS), table(spark, sf_dir, "part")
    w = e.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("unblocks"))
    tried = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))
    q = part.filter("p_size <= 30").join(tried, "p_partkey", "left_anti").join(w, F.col("p_partkey") == F.col("node"), "left")
    return q.select("p_partkey", F.coalesce("unblocks", F.lit(0)).alias("unblocks"), "p_size").orderBy(F.desc("unblocks"), "p_size", "p_partkey").limit(100)


@R.add("g10_grown_neighbourhood")
def neighbourhood(spark, sf_dir):
    weights = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("weight"))
    return graphs.grown_neighbourhood(statement(spark, sf_dir, _DEPS), weights, 1, 6)


@R.add("g11_wavefront", f"""WITH RECURSIVE e AS ({_DEPS}), ok AS (SELECT p_partkey AS node FROM part WHERE p_size % 7 > 0), bad AS (SELECT p_partkey AS node FROM part WHERE p_size % 7 = 0 UNION SELECT e.src FROM bad JOIN e ON e.dst = bad.node),
    l AS (SELECT node, 1 AS wave FROM ok WHERE node NOT IN (SELECT src FROM e) UNION SELECT e.src, l.wave + 1 FROM l JOIN e ON e.dst = l.node) SELECT node, max(wave) AS wave FROM l WHERE node NOT IN (SELECT node FROM bad) GROUP BY node""")  # fmt: skip
def wavefront(spark, sf_dir):
    draws = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 7 > 0).alias("success"))
    return graphs.wavefront(statement(spark, sf_dir, _DEPS), draws, 50)


_TURNS = "SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent, length(text) AS score, length(text) % 5 = 0 AS exact FROM conversations"


@R.add("g12_forest", f"WITH t AS ({_TURNS}) SELECT a.id, a.parent, p.id IS NULL AS is_root, (SELECT count(*) FROM t c WHERE c.parent = a.id) AS n_children FROM t a LEFT JOIN t p ON a.parent = p.id")
def forest(spark, sf_dir):
    return graphs.forest(statement(spark, sf_dir, _TURNS), "id", "parent").select("id", "parent", "is_root", "n_children")


@R.add("g13_best_in_subtree", f"""WITH RECURSIVE t AS ({_TURNS}), r AS (SELECT id AS a, id AS d FROM t UNION SELECT r.a, t.id FROM r JOIN t ON t.parent = r.d),
    s AS (SELECT r.a AS id, t.exact, t.score, row_number() OVER (PARTITION BY r.a ORDER BY t.exact DESC, t.score DESC) AS rn FROM r JOIN t ON t.id = r.d) SELECT id, exact AS best_exact, score AS best_score FROM s WHERE rn = 1""")  # fmt: skip
def best_in_subtree(spark, sf_dir):
    t = statement(spark, sf_dir, _TURNS)
    best = graphs.best_below(t, "id", "parent", F.struct("exact", "score"))
    return best.select(F.col("node").alias("id"), F.col("best.exact").alias("best_exact"), F.col("best.score").alias("best_score"))


@R.add("g14_on_the_path", f"WITH RECURSIVE t AS ({_TURNS}), r AS (SELECT id FROM t WHERE exact UNION SELECT t.parent FROM r JOIN t ON t.id = r.id WHERE t.parent IS NOT NULL) SELECT id FROM r")
def on_path(spark, sf_dir):
    t = statement(spark, sf_dir, _TURNS)
    up = t.filter("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return graphs.reachable(up, t.filter("exact").select(F.col("id").alias("node"))).withColumnRenamed("node", "id")


@R.add("g15_trajectory_labels", f"WITH RECURSIVE t AS ({_TURNS}), r AS (SELECT id FROM t WHERE exact UNION SELECT t.parent FROM r JOIN t ON t.id = r.id WHERE t.parent IS NOT NULL) SELECT id, CASE WHEN exact THEN 'exact' WHEN id IN (SELECT id FROM r) THEN 'leads_to_exact' ELSE 'other' END AS label FROM t")
def trajectory_labels(spark, sf_dir):
    t = statement(spark, sf_dir, _TURNS)
    path = on_path(spark, sf_dir).withColumn("_on", F.lit(True))
    return t.join(path, "id", "left").select("id", F.when(F.col("exact"), "exact").when(F.col("_on"), "leads_to_exact").otherwise("other").alias("label"))


@R.add("g17_blocker_edges", """WITH s AS (SELECT user_id, event_id, list_sort(list_distinct([event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END, 'k' || CAST(event_id % 4 AS VARCHAR)])) AS c FROM events),
    b AS (SELECT *, lag(c) OVER o AS p, flatten(list(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS ever FROM s WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT unnest(list_filter(p, lambda x: NOT list_contains(c, x))) AS cleared, list_filter(c, lambda x: NOT list_contains(ever, x)) AS new FROM b WHERE p IS NOT NULL)
    SELECT cleared, revealed, count(*) AS n FROM (SELECT cleared, unnest(new) AS revealed FROM g) x GROUP BY cleared, revealed""")  # fmt: skip
def blockers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("array_sort(array_distinct(array(event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END, concat('k', event_id % 4))))").alias("c"))
    return graphs.blocker_edges(e, "user_id", "event_id", "c")


@R.add("g18_merged_states", "SELECT md5(text) AS state, count(*) AS times, count(DISTINCT conv_id) AS sources, count(DISTINCT role) > 1 AS contradicts FROM conversations GROUP BY 1")
def merged_states(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.md5("text").alias("state")).agg(F.count("*").alias("times"), F.count_distinct("conv_id").alias("sources"), (F.count_distinct("role") > 1).alias("contradicts"))


@R.add("g23_propagated_constraints", "SELECT l_partkey AS callee, count(DISTINCT l_suppkey) AS callers, min(l_quantity) AS least, max(l_quantity) AS most, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS agreed FROM lineitem GROUP BY l_partkey")
def propagated(spark, sf_dir):
    agreed = F.when(F.count_distinct("l_returnflag") == 1, F.min("l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("callee")).agg(F.count_distinct("l_suppkey").alias("callers"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), agreed.alias("agreed"))
