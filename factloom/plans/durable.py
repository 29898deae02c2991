"""Queries of the store, sources, splits, leakage checks, forecasts and logs, each on a store or log of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import intervals, nearest, order, queues, similarity, statistics, validation
from factloom.plans.registry import Registry, statement, table
from factloom.sources import ledger, loaders
from factloom.sources.staging import staged
from factloom.sources.store import Refused, Store, new_rows, retained
from factloom.streaming import heartbeat, logs, tail

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _store(spark) -> Store:
    staged(spark.range(1))  # names a shared folder where the session has none
    return Store(spark, f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/factloom/store-{uuid.uuid4().hex}")


_CLAIMS = "SELECT p_partkey AS id, p_type AS kind, p_name AS subject, p_brand AS value, CASE WHEN p_size = 1 THEN 'human' ELSE 'model' END AS origin FROM part"


@R.add("l1_cited_claims", "SELECT origin, count(*) AS claims FROM (SELECT CASE WHEN p_size = 1 THEN 'human' ELSE 'model' END AS origin FROM part) x GROUP BY origin")
def cited_claims(spark, sf_dir):
    s = _store(spark)
    s.publish("evidence", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))
    claims = statement(spark, sf_dir, _CLAIMS)
    s.assert_claims(claims, claims.select(F.col("id").alias("inference_id"), F.col("id").alias("evidence_id")))
    return s.read("inference").filter("status = 'active'").groupBy("origin").agg(F.count("*").alias("claims"))


@R.add("l3_retraction_cascade", """WITH RECURSIVE r AS (SELECT CAST(3 AS BIGINT) AS node UNION SELECT p_partkey FROM r JOIN part ON CAST(floor(p_partkey / 3) AS BIGINT) = r.node AND p_partkey > 0)
    SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT node FROM r) THEN 'retracted' ELSE 'active' END AS status FROM part""")  # fmt: skip
def retraction(spark, sf_dir):
    s = _store(spark)
    s.publish("inference", statement(spark, sf_dir, _CLAIMS).withColumn("status", F.lit("active")).withColumn("reason", F.lit(None).cast("string")))
    s.publish("inference_depends", table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("inference_id"), F.floor(F.col("p_partkey") / 3).alias("depends_on_id")))
    s.retract(spark.createDataFrame([(3,)], "node long"), "contradicted")
    return s.read("inference").select("id", "status")


@R.add("l2_insert_or_ignore", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x")
def insert_or_ignore(spark, sf_dir):
    s = _store(spark)
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    s.append_missing("bridge", pairs.filter("l_suppkey % 2 = 0"), ["l_suppkey", "l_partkey"])
    s.append_missing("bridge", pairs, ["l_suppkey", "l_partkey"])
    return s.read("bridge").agg(F.count("*").alias("n"))


@R.add("l4_ratchet", "SELECT count(*) FILTER (WHERE p_size > 10) AS matched, count(*) AS n FROM part")
def ratchet(spark, sf_dir):
    s, part = _store(spark), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    assert s.ratchet("state", part, "p_size > 10")
    assert not s.ratchet("state", part.filter("p_size < 40"), "p_size > 10")
    return s.read("state").agg(F.count_if(F.col("p_size") > 10).alias("matched"), F.count("*").alias("n"))


@R.add("l6_last_write_wins", "SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def last_write(spark, sf_dir):
    s, e = _store(spark), table(spark, sf_dir, "events")
    for part in (e.filter("event_id < 5000"), e.filter("event_id >= 5000")):
        s.upsert("kv", part.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value")), ["user_id"])
    return s.read("kv")


@R.add("l7_content_addressed", "SELECT count(DISTINCT text) AS objects, count(*) AS entries FROM documents")
def content_addressed(spark, sf_dir):
    s = _store(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    s.commit(d.filter("doc_id % 2 = 0"), "name", "text", 1, None)
    s.commit(d, "name", "text", 2, 1)
    return s.read("objects").agg(F.count("*").alias("objects")).crossJoin(s.read("manifests").filter("commit_id = 2").agg(F.count("*").alias("entries")))


@R.add("l8_hydrate", "SELECT CAST(doc_id AS VARCHAR) AS name, md5(text) AS digest FROM documents")
def hydrate(spark, sf_dir):
    s = _store(spark)
    s.commit(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text"), "name", "text", 1, None)
    return s.hydrate(1).select("name", F.md5("payload").alias("digest"))


@R.add("l10_compaction", "SELECT count(DISTINCT text) AS objects FROM documents WHERE doc_id % 3 = 0")
def compaction(spark, sf_dir):
    s, d = _store(spark), table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    s.commit(d.filter("doc_id % 2 = 0"), "name", "text", 1, None)
    s.commit(d.filter("doc_id % 3 = 0"), "name", "text", 2, 1)
    s.compact(spark.createDataFrame([(2,)], "commit_id long"))
    return s.read("objects").agg(F.count("*").alias("objects"))


@R.add("l11_beyond_the_mark", "SELECT event_id, user_id FROM events WHERE event_id > 9000")
def beyond_mark(spark, sf_dir):
    return new_rows(table(spark, sf_dir, "events"), 9000, "event_id").select("event_id", "user_id")


@R.add("l12_job_import", "SELECT CAST(2 * count(*) AS BIGINT) AS n, CAST(2 * count(*) AS BIGINT) AS top FROM events")
def job_import(spark, sf_dir):
    s, rows = _store(spark), table(spark, sf_dir, "events").select("event_id", "value")
    for job in ("a", "b", "a"):
        s.import_job("log", rows, "event_id", job)
    return s.read("log").agg(F.count("*").alias("n"), F.max("event_id").alias("top"))


@R.add("l5_guarded_facts", "SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n, 2 AS refused FROM events GROUP BY event_type")
def guarded_facts(spark, sf_dir):
    """Facts as they were, after a writer has tried to change all of them and another to give one twice."""
    s, e = _store(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    s.append("facts", e, ["event_id"])
    refused = 0
    for rows in (e.withColumn("event_type", F.lit("changed")), e.select((F.col("event_id") % 7 - 1_000_000).alias("event_id"), "event_type")):
        try:
            s.append("facts", rows, ["event_id"])
        except Refused:
            refused += 1
    return s.read("facts").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@R.add("l15_chained_ledger", """WITH l AS (SELECT event_id, event_id % 2 AS part, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1 AS pos, count(*) FILTER (WHERE event_id % 2 = 0) OVER () AS evens FROM events WHERE event_type = 'view'),
    p AS (SELECT event_id, CASE WHEN part = 0 THEN pos ELSE evens + pos END AS place, CASE WHEN part = 0 THEN pos // 50 ELSE (evens + 49) // 50 + pos // 50 END AS segment FROM l)
    SELECT segment, min(place) AS place, 'entry' AS why FROM p WHERE event_id % 100 = 37 GROUP BY segment""")  # fmt: skip
def chained_ledger(spark, sf_dir):
    """Looks at the data as a hash-chained ledger, written in two changes; some entries are then changed, and found."""
    s, e = _store(spark), table(spark, sf_dir, "events").filter("event_type = 'view'")
    looks = e.select("event_id", F.to_json(F.struct("event_id", "user_id", "value")).alias("content"))
    book = ledger.Ledger(s, "looks", size=50)
    head = book.append(looks.filter("event_id % 2 = 0"), [F.asc("event_id")], ledger.GENESIS)
    book.append(looks.filter("event_id % 2 = 1"), [F.asc("event_id")], head)
    tampered = F.get_json_object("content", "$.event_id").cast("long") % 100 == 37
    s.publish("looks", s.read("looks").withColumn("content", F.when(tampered, F.lit("{}")).otherwise(F.col("content"))))
    return book.broken()


@R.add("l13_snapshot_budget", """WITH RECURSIVE u AS (SELECT user_id, count(*) AS n, max(ts) AS latest FROM events GROUP BY user_id), o AS (SELECT user_id, n, row_number() OVER (ORDER BY latest DESC, user_id) AS rn FROM u),
    f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(2000 AS HUGEINT) AS rest, CAST(NULL AS BIGINT) AS user_id, false AS keep UNION ALL SELECT o.rn, CASE WHEN o.n <= f.rest THEN f.rest - o.n ELSE f.rest END, o.user_id, o.n <= f.rest FROM f JOIN o ON o.rn = f.rn + 1) SELECT user_id FROM f WHERE keep""")  # fmt: skip
def snapshot_budget(spark, sf_dir):
    """What stays within the budget, the latest first; one that doesn't fit is skipped, and smaller ones behind it may stay."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return intervals.skipping_budget_of_all(users, [F.desc("latest"), F.asc("user_id")], "n", 2000).select("user_id")


@R.add("w22_commit_retention", "SELECT event_id AS commit_id FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5) OR event_id IN (SELECT max_by(event_id, struct_pack(t := ts, i := event_id)) FROM events GROUP BY CAST(ts AS DATE)) OR value > 400")
def commit_retention(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("commit_id"), F.col("ts").alias("created"), "value")
    return retained(e, 5, e.filter("value > 400").select("commit_id"))


# --- sources ---
@R.add("s2_facts_by_kind", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def facts_by_kind(spark, sf_dir):
    path = _store(spark).path + "/facts"
    table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind").write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"))


@R.add("s3_overlap_refusal", """WITH n AS (SELECT concat(p_brand, '/', p_size) AS grp, p_partkey * 100 AS lo, p_partkey * 100 + p_size AS hi FROM part), k AS (SELECT c_custkey * 1999 + 17 AS lo, c_custkey * 1999 + 60 AS hi FROM customer)
    SELECT grp, count(*) AS n FROM n WHERE grp NOT IN (SELECT grp FROM n JOIN k ON n.lo < k.hi AND k.lo < n.hi) GROUP BY grp""")  # fmt: skip
def overlap_refusal(spark, sf_dir):
    n = statement(spark, sf_dir, "SELECT concat(p_brand, '/', p_size) AS grp, p_partkey * 100 AS lo, p_partkey * 100 + p_size AS hi FROM part")
    k = statement(spark, sf_dir, "SELECT c_custkey * 1999 + 17 AS lo, c_custkey * 1999 + 60 AS hi FROM customer")
    good, _ = loaders.without_overlaps(n, k, "grp", "lo", "hi")
    return good.groupBy("grp").agg(F.count("*").alias("n"))


@R.add("s8_symbol_identity", "SELECT p_name AS name, CASE WHEN count(DISTINCT p_size) = 0 THEN 'unresolved' WHEN count(DISTINCT p_size) = 1 THEN 'resolved' ELSE 'conflict' END AS status, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) END AS addr FROM part GROUP BY p_name")
def symbol_identity(spark, sf_dir):
    return loaders.symbol_identity(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("addr")))


@R.add("s11_json_lines", "SELECT event_id, value FROM events")
def json_lines(spark, sf_dir):
    path = _store(spark).path + "/lines"
    loaders.write_json_lines(table(spark, sf_dir, "events").select("event_id", "value"), path)
    return loaders.json_lines(spark, path, "event_id long, value double", ["event_id"])


@R.add("s12_key_at_any_depth", "SELECT value, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS value FROM events) x GROUP BY value")
def any_depth(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(F.concat(F.lit('{"a": [{"b": '), "props", F.lit("}]}")).alias("j"))
    return loaders.values_of_key(nested, "j", "k").groupBy("value").agg(F.count("*").alias("n"))


@R.add("s10_corpus_index", """SELECT doc_id, source, md5(lower(text)) AS digest, len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS tokens FROM documents""")
def corpus_index(spark, sf_dir):
    s = _store(spark)
    d = table(spark, sf_dir, "documents").withColumn("w", text.words(F.col("text")))
    s.publish("corpus", d.select("doc_id", "source", F.md5(F.lower("text")).alias("digest"), F.size("w").cast("long").alias("tokens"), text.sketch(F.col("w")).alias("sketch")))
    return s.read("corpus").drop("sketch")


@R.add("s15_attempt_with_edge", "SELECT (SELECT count(*) FROM conversations) AS attempts, (SELECT count(*) FROM conversations WHERE turn > 0) AS edges")
def attempt_with_edge(spark, sf_dir):
    s, c = _store(spark), table(spark, sf_dir, "conversations")
    attempts = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    child = (F.col("conv_id") * 100 + F.col("turn")).alias("child")
    edges = c.filter("turn > 0").select(child, (F.col("conv_id") * 100 + F.col("turn") - 1).alias("parent"))
    s.append_all({"attempts": (attempts, ["id"]), "edges": (edges, ["child"])})
    return s.read("attempts").agg(F.count("*").alias("attempts")).crossJoin(s.read("edges").agg(F.count("*").alias("edges")))


@R.add("s16_linked_receipts", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id + 1 END AS child FROM events")
def linked_receipts(spark, sf_dir):
    """A link is a new version of the receipt; readers take the last."""
    e = table(spark, sf_dir, "events").select("event_id", F.lit(None).cast("long").alias("child"), F.lit(0).alias("version"))
    linked = e.filter("event_id % 3 = 0").withColumn("child", F.col("event_id") + 1).withColumn("version", F.lit(1))
    return loaders.latest_versions(e.unionByName(linked), ["event_id"], "version").select("event_id", "child")


@R.add("s20_status_api", "SELECT user_id, count(*) AS tries, max(value) AS best, bool_or(value > 300) AS exact FROM events GROUP BY user_id")
def status_api(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tries"), F.max("value").alias("best"), F.bool_or(F.col("value") > 300).alias("exact"))


@R.add("s22_generated_rows", """SELECT i AS id, CAST(('0x' || substring(h, 1, 4)) AS BIGINT) % 8 AS family, CAST(('0x' || substring(h, 5, 6)) AS BIGINT) % 500 + 1 AS size
    FROM (SELECT i, md5('7:' || CAST(i AS VARCHAR)) AS h FROM (SELECT unnest(range((SELECT count(*) FROM part))) AS i) r) x""")  # fmt: skip
def generated_rows(spark, sf_dir):
    return loaders.generated(spark, table(spark, sf_dir, "part").count(), 7)


# --- splits and leakage ---
@R.add("c2_disjoint_split", """WITH used AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 50), s AS (SELECT p_partkey, p_brand, CASE WHEN CAST(('0x' || substring(sha256('c2:' || p_brand), 1, 2)) AS INT) < 76 THEN 'test' ELSE 'train' END AS split FROM part)
    SELECT p_partkey, split FROM s WHERE p_brand NOT IN (SELECT p_brand FROM used) OR split = 'train'""")  # fmt: skip
def disjoint_split(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    used = part.filter("p_size = 50").select("p_brand").distinct().withColumn("_used", F.lit(True))
    split = F.when(text.sealed("c2", F.col("p_brand"), 0.3), "test").otherwise("train")
    return part.withColumn("split", split).join(used, "p_brand", "left").filter(F.col("_used").isNull() | (F.col("split") == "train")).select("p_partkey", "split")


@R.add("c3_group_seal", "SELECT p_brand, CAST(('0x' || substring(sha256('seal:' || p_brand), 1, 2)) AS INT) < 51 AS sealed, count(*) AS n FROM part GROUP BY 1, 2")
def group_seal(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", text.sealed("seal", F.col("p_brand"), 0.2).alias("sealed")).agg(F.count("*").alias("n"))


@R.add("c4_pinned_families", "SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 'train' WHEN CAST(('0x' || substring(sha256(source), 1, 8)) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1, 2")
def pinned_families(spark, sf_dir):
    split = F.when(F.col("source").isin("src0", "src1"), "train").when(text.hash_bucket(F.col("source"), 8, 100) < 20, "test").otherwise("train")
    return table(spark, sf_dir, "documents").groupBy("source", split.alias("split")).agg(F.count("*").alias("n"))


@R.add("c5_split_by_entity", "SELECT user_id, CASE WHEN CAST(('0x' || substring(sha256('11:' || CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 = 0 THEN 'heldout' ELSE 'train' END AS split, count(*) AS n FROM events GROUP BY 1, 2")
def split_by_entity(spark, sf_dir):
    split = F.when(text.hash_bucket(F.concat(F.lit("11:"), F.col("user_id").cast("string")), 8, 5) == 0, "heldout").otherwise("train")
    return table(spark, sf_dir, "events").groupBy("user_id", split.alias("split")).agg(F.count("*").alias("n"))


@R.add("c7_split_audit", "WITH s AS (SELECT p_brand, p_name, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS split FROM part) SELECT (SELECT count(*) FROM (SELECT p_brand FROM s GROUP BY p_brand HAVING count(DISTINCT split) > 1) x) AS shared_groups, (SELECT count(*) FROM (SELECT p_name FROM s GROUP BY p_name HAVING count(DISTINCT split) > 1) x) AS shared_names")
def split_audit(spark, sf_dir):
    s = table(spark, sf_dir, "part").withColumn("split", F.col("p_size") % 2)
    shared = lambda c: s.groupBy(c).agg(F.count_distinct("split").alias("n")).filter("n > 1").agg(F.count("*").alias("shared_groups" if c == "p_brand" else "shared_names"))
    return shared("p_brand").crossJoin(shared("p_name"))  # one row each


@R.add("c8_development_only", "SELECT p_partkey FROM part WHERE p_size > 48 AND CAST(('0x' || substring(sha256('seal:' || p_brand), 1, 2)) AS INT) < 51")
def development_only(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_size") > 48).filter(text.sealed("seal", F.col("p_brand"), 0.2)).select("p_partkey")


@R.add("c9_whole_word_leak", "SELECT DISTINCT d.doc_id, w AS word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) d WHERE w IN ('license', 'copyright', 'password', 'secret', 'benchmark', 'email')")
def whole_word_leak(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.filter(F.col("word").isin("license", "copyright", "password", "secret", "benchmark", "email")).distinct()


@R.add("c11_grams_outside_handed_text", """WITH a AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations WHERE turn IN (0, 1)), g AS (SELECT conv_id, turn, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [] END) AS g FROM a)
    SELECT x.conv_id, count(DISTINCT x.g) AS outside FROM g x WHERE x.turn = 1 AND NOT EXISTS (SELECT 1 FROM g y WHERE y.conv_id = x.conv_id AND y.turn = 0 AND y.g = x.g) GROUP BY x.conv_id""")  # fmt: skip
def grams_outside(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("turn IN (0, 1)").select("conv_id", "turn", text.words(F.col("text")).alias("w")).filter("size(w) >= 3")
    g = c.select("conv_id", "turn", F.explode(text.windows(F.col("w"), 3)).alias("g")).distinct()
    out = g.filter("turn = 1").join(g.filter("turn = 0").select("conv_id", "g"), ["conv_id", "g"], "left_anti")
    return out.groupBy("conv_id").agg(F.count("*").alias("outside"))


@R.add("c13_manifest_check", "SELECT CASE WHEN m.id IS NULL THEN 'not_in_manifest' WHEN d.doc_id IS NULL THEN 'not_in_data' WHEN m.digest <> md5(d.text) THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 7 <> 0) m FULL OUTER JOIN (SELECT * FROM documents WHERE doc_id % 11 <> 0) d ON m.id = d.doc_id GROUP BY 1")
def manifest_check(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["c13_manifest_check"])


@R.add("c15_answer_lines", "WITH a AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), p AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT item_id, count(DISTINCT line) AS leaked FROM a WHERE length(line) > 25 AND line IN (SELECT line FROM p) GROUP BY item_id")
def answer_lines(spark, sf_dir):
    lines = lambda df: df.select("*", F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 25")
    a, p = lines(table(spark, sf_dir, "benchmark")), lines(table(spark, sf_dir, "documents")).select("line").distinct()
    return a.join(p, "line", "left_semi").groupBy("item_id").agg(F.count_distinct("line").alias("leaked"))


@R.add("c17_taint_digest", "SELECT sha256(string_agg(n_name, ',' ORDER BY n_name)) AS digest FROM nation")
def taint_digest(spark, sf_dir):
    return table(spark, sf_dir, "nation").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), ","), 256).alias("digest"))


@R.add("c18_experiment_fingerprint", "SELECT sha256('{\"events\":' || CAST(count(*) AS VARCHAR) || ',\"seed\":7}') AS fingerprint FROM events")
def experiment_fingerprint(spark, sf_dir):
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("events"))
    return n.select(F.sha2(F.to_json(F.struct("events", F.lit(7).alias("seed"))), 256).alias("fingerprint"))


# --- evaluation over arms ---
@R.add("x12_policy_choice", "WITH p AS (SELECT event_type AS policy, count(*) FILTER (WHERE value > 100) AS exacts, round(sum(value), 2) AS gain, count(*) AS compiles FROM events GROUP BY 1) SELECT policy, exacts FROM p ORDER BY exacts DESC, gain DESC, compiles, policy <> 'click', policy LIMIT 1")
def policy_choice(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["x12_policy_choice"])


@R.add("x13_leave_one_out_backoff", """WITH t AS (SELECT user_id, event_type, CAST(user_id % 4 AS INT) AS ctx, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY 1, 2, 3)
    SELECT a.user_id, a.event_type, round(coalesce((SELECT sum(k) / nullif(sum(n), 0) FROM t b WHERE b.user_id <> a.user_id AND b.event_type = a.event_type AND b.ctx = a.ctx), 0.5), 9) AS rate FROM t a""")  # fmt: skip
def backoff(spark, sf_dir):
    """Sums of the others are the group's sums less one's own, so no row meets another."""
    t = table(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("user_id") % 4).alias("ctx")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    w = Window.partitionBy("event_type", "ctx")
    n, k = F.sum("n").over(w) - F.col("n"), F.sum("k").over(w) - F.col("k")
    return t.select("user_id", "event_type", F.round(F.when(n > 0, k / n).otherwise(0.5), 9).alias("rate"))


@R.add("x13_context_backoff", """WITH t AS (SELECT user_id, event_type, hour(ts) AS h, dayofmonth(ts) AS d, count(*) AS n, count(*) FILTER (WHERE value > 50) AS k FROM events GROUP BY ALL),
    a AS (SELECT a.*, (SELECT struct_pack(n := sum(b.n), k := sum(b.k)) FROM t b WHERE b.event_type = a.event_type AND b.user_id <> a.user_id AND b.h = a.h AND b.d = a.d) AS x, (SELECT struct_pack(n := sum(b.n), k := sum(b.k)) FROM t b WHERE b.event_type = a.event_type AND b.user_id <> a.user_id AND b.d = a.d) AS y,
      (SELECT struct_pack(n := sum(b.n), k := sum(b.k)) FROM t b WHERE b.event_type = a.event_type AND b.user_id <> a.user_id) AS z FROM t a)
    SELECT user_id, event_type, CAST(h AS INT) AS hour, CAST(d AS INT) AS day, CASE WHEN x.n > 0 THEN 0 WHEN y.n > 0 THEN 1 WHEN z.n > 0 THEN 2 END AS tier, CAST(coalesce(x.n, y.n, z.n, 0) AS BIGINT) AS support,
      round(CASE WHEN x.n > 0 THEN x.k / x.n WHEN y.n > 0 THEN y.k / y.n WHEN z.n > 0 THEN z.k / z.n END, 9) AS rate FROM a""")  # fmt: skip
def context_backoff(spark, sf_dir):
    """How often an action of a user paid off for others: on the same day and hour, on the same day, or ever."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"), "value")
    t = e.groupBy("user_id", "event_type", "hour", "day").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    out = statistics.backed_off(t, "user_id", "event_type", [["day", "hour"], ["day"], []], "k", "n")
    return out.select("user_id", "event_type", "hour", "day", "tier", "support", F.round("rate", 9).alias("rate"))


@R.add("x14_receipt_ratchet", "WITH a AS (SELECT user_id, max(value) AS l, count(*) FILTER (WHERE event_type = 'error') AS e FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(value) AS l, count(*) FILTER (WHERE event_type = 'error') AS e FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT count(*) AS states, count(*) FILTER (WHERE b.l < a.l) AS lost, count(*) FILTER (WHERE b.e > a.e) AS more_errors, count(*) FILTER (WHERE b.l < a.l OR b.e > a.e) = 0 AS holds FROM a JOIN b ON a.user_id = b.user_id")
def receipt_ratchet(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["x14_receipt_ratchet"])


@R.add("x15_equal_budget", "WITH a AS (SELECT user_id, max(value) > 150 AS hit FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(value) > 150 AS hit FROM events WHERE event_type = 'view' GROUP BY 1) SELECT count(*) FILTER (WHERE a.hit AND NOT b.hit) AS only_a, count(*) FILTER (WHERE b.hit AND NOT a.hit) AS only_b, CASE WHEN count(*) FILTER (WHERE a.hit) > count(*) FILTER (WHERE b.hit) THEN 'a' WHEN count(*) FILTER (WHERE a.hit) < count(*) FILTER (WHERE b.hit) THEN 'b' ELSE 'inconclusive' END AS verdict FROM a JOIN b ON a.user_id = b.user_id")
def equal_budget(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["x15_equal_budget"])


@R.add("x17_stopping_gate", "WITH p AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 60) AS t, bool_or(event_type = 'click' AND value > 60) AS c FROM events GROUP BY user_id) SELECT count(*) FILTER (WHERE t AND NOT c) AS n01, count(*) FILTER (WHERE c AND NOT t) AS n10, count(*) FILTER (WHERE t AND NOT c) > count(*) FILTER (WHERE c AND NOT t) AND count(*) FILTER (WHERE t) > count(*) FILTER (WHERE c) AS passes FROM p")
def stopping_gate(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["x17_stopping_gate"])


@R.add("x9_policy_replay", "WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n, event_type = 'purchase' AS hit FROM events), f AS (SELECT user_id, min(n) FILTER (WHERE hit) AS place FROM o GROUP BY user_id) SELECT count(*) FILTER (WHERE place <= 1) AS b1, count(*) FILTER (WHERE place <= 4) AS b4, count(*) FILTER (WHERE place <= 16) AS b16, count(*) AS n FROM f")
def policy_replay(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["x9_policy_replay"])


@R.add("x16_preference_pairs", "WITH s AS (SELECT conv_id, turn, length(text) AS v FROM conversations), p AS (SELECT conv_id, max_by(turn, struct_pack(v := v, t := -turn)) AS best, min_by(turn, struct_pack(v := v, t := turn)) AS worst, max(v) - min(v) AS gap FROM s GROUP BY conv_id) SELECT conv_id, best, worst FROM p WHERE gap > 50")
def preference_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("v"))
    p = s.groupBy("conv_id").agg(F.max_by("turn", F.struct("v", -F.col("turn"))).alias("best"), F.min_by("turn", F.struct("v", "turn")).alias("worst"), (F.max("v") - F.min("v")).alias("gap"))
    return p.filter("gap > 50").select("conv_id", "best", "worst")


@R.add("x10_trained_classifier")
def trained_classifier(spark, sf_dir):
    """Area under the ROC and precision-recall curves of a boosted classifier of document quality, on held-out rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = F.size(F.split("text", r"\s+")).cast("double")
    rows = d.select("doc_id", F.col("quality").cast("double").alias("label"), words.alias("words"), (F.char_length("text") / words).alias("length"), (F.char_length(F.regexp_replace("text", "[^#*$%&|<>]", "")) / F.char_length("text")).alias("symbols")).fillna(0.0)
    rows = staged(VectorAssembler(inputCols=["words", "length", "symbols"], outputCol="features").transform(rows).select("doc_id", "label", "features"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=7).fit(rows.filter("doc_id % 5 <> 0"))
    scored = model.transform(rows.filter("doc_id % 5 = 0"))
    measure = lambda m: float(BinaryClassificationEvaluator(metricName=m).evaluate(scored))
    return spark.createDataFrame([(measure("areaUnderROC"), measure("areaUnderPR"))], "auc double, ap double")


# --- mining ---
@R.add("m12_edit_abstraction", "WITH s AS (SELECT user_id, lag(event_type) OVER o AS a, event_type AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) SELECT a || '>' || b AS edit, b || '>' || a AS inverse, count(*) AS n, count(DISTINCT user_id) AS entities FROM s WHERE a IS NOT NULL AND a <> b GROUP BY 1, 2")
def edit_abstraction(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["m12_edit_abstraction"])


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')"


@R.add("m17_repeated_regions", f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), g AS (SELECT doc_id, len(w) >= 200 AS large, unnest(range(1, len(w) - 10)) AS p, w FROM d WHERE len(w) >= 12),
    k AS (SELECT doc_id, large, p, md5(array_to_string(w[p:p + 11], ' ')) AS region FROM g), o AS (SELECT region FROM k GROUP BY region HAVING count(*) > 1),
    l AS (SELECT region, doc_id, large, list_sort(list(p)) AS ps FROM k WHERE region IN (SELECT region FROM o) GROUP BY region, doc_id, large),
    t AS (SELECT region, doc_id, large, CASE WHEN len(ps) = 1 THEN 1 ELSE list_reduce(list_prepend(10000000 + ps[1], ps[2:]), lambda a, x: CASE WHEN x >= a % 10000000 + 12 THEN (a // 10000000 + 1) * 10000000 + x ELSE a END) // 10000000 END AS n FROM l)
    SELECT region, CAST(sum(n) AS BIGINT) AS times, count(*) AS entities FROM t GROUP BY region HAVING sum(n) >= 2 AND bool_or(large)""")  # fmt: skip
def repeated_regions(spark, sf_dir):
    """Runs of 12 words that occur again, in the same text or another, one of 200 words or more among them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.words(F.col("text")).alias("tokens"))
    return similarity.repeated_regions(d, 12, 200)


@R.add("m17_contained_bodies", f"""WITH b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark), d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
    SELECT item_id AS body_id, doc_id AS host_id, count(*) AS times FROM p JOIN b ON len(b.w) >= 8 AND p.w[p.p] = b.w[1] AND p.w[p.p:p.p + len(b.w) - 1] = b.w GROUP BY 1, 2""")  # fmt: skip
def contained_bodies(spark, sf_dir):
    """Benchmark items whose words stand whole in a document."""
    words = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), text.words(F.col("text")).alias("tokens"))
    return similarity.contained_bodies(words("benchmark", "item_id"), words("documents", "doc_id"), 8)


@R.add("m18_history_mining", "SELECT doc_id, CASE WHEN regexp_matches(substring(text, greatest(p - 200, 1), 400), '(?i)the') THEN 'worked' ELSE 'inert' END AS outcome FROM (SELECT doc_id, text, strpos(text, 'license') AS p FROM documents) x WHERE p > 0")
def history_mining(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", "license").alias("p")).filter("p > 0")
    near = F.expr("substring(text, greatest(p - 200, 1), 400)")
    return x.select("doc_id", F.when(near.rlike("(?i)the"), "worked").otherwise("inert").alias("outcome"))


@R.add("m21_confirmed_rules", "WITH c AS (SELECT event_type AS rule, user_id, max(value) > 100 AS fired FROM events GROUP BY 1, 2) SELECT rule, count(*) FILTER (WHERE NOT fired) AS declined, count(*) FILTER (WHERE fired) AS predicted, count(*) FILTER (WHERE fired AND user_id <> 7) > 0 AS confirmed FROM c GROUP BY rule")
def confirmed_rules(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["m21_confirmed_rules"])


@R.add("m22_experiment_memory", "WITH u AS (SELECT user_id, event_type, min(event_id) AS id FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'purchase', id) AS rn FROM u) SELECT user_id, event_type, id FROM r WHERE rn <= 3")
def experiment_memory(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["m22_experiment_memory"])


@R.add("j16_similarity_join_top_k", "WITH v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0) SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM p) x WHERE rn <= 2")
def similarity_join(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    return nearest.greatest_products(v.filter("id % 100 = 0"), v, 2).select(F.col("id").alias("a"), F.col("known_id").alias("b"))


@R.add("o8_diverse_archive", "WITH k AS (SELECT user_id, event_id, value, md5(event_type || CAST(CAST(floor(value / 20) AS INT) AS VARCHAR)) AS novelty FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, novelty ORDER BY value DESC, event_id) AS rn FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM d WHERE rn = 1) SELECT user_id, event_id FROM r WHERE place <= 8")
def diverse_archive(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["o8_diverse_archive"].replace("VARCHAR", "STRING"))


@R.add("o9_fair_queue", "WITH e AS (SELECT user_id, count(*) AS visits, max(value) AS best FROM events GROUP BY user_id) SELECT user_id, CAST(floor(visits / 20) AS INT) AS band, row_number() OVER (ORDER BY floor(visits / 20), user_id % 3, best DESC, user_id) AS place FROM e")
def fair_queue(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("visits"), F.max("value").alias("best"))
    e = e.withColumn("band", F.floor(F.col("visits") / 20).cast("int"))
    turn = [F.asc("band"), F.asc(F.col("user_id") % 3), F.desc("best"), F.asc("user_id")]
    return order.numbered(e, turn).select("user_id", "band", (F.col("place") + 1).alias("place"))


@R.add("o9_projected_queue", """WITH RECURSIVE v AS (SELECT l_partkey AS node, count(*) AS visits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
      i AS (SELECT p_partkey AS node, p_partkey // 3 AS needs, p_size % 7 <> 0 AS open, coalesce(visits, 0) // 2 AS band, p_size % 6 AS lane, CASE WHEN p_size < 49 THEN p_brand END AS unit, CASE WHEN p_size % 5 <> 0 THEN p_size * 1000 + p_partkey % 1000 END AS address, p_size FROM part LEFT JOIN v ON p_partkey = v.node),
      o AS (SELECT * FROM i WHERE open), d AS (SELECT o.node, 0 AS depth FROM o WHERE needs = node OR needs NOT IN (SELECT node FROM o) UNION ALL SELECT o.node, depth + 1 FROM d JOIN o ON o.needs = d.node AND o.node <> d.node),
      c AS (SELECT needs AS node, count(*) AS callers FROM o WHERE needs <> node GROUP BY 1), u AS (SELECT unit, count(*) FILTER (WHERE open) AS in_unit, min(address) AS least FROM i WHERE unit IS NOT NULL GROUP BY 1),
      r AS (SELECT unit, in_unit, row_number() OVER (ORDER BY least NULLS LAST, unit) - 1 AS unit_rank FROM u WHERE in_unit > 0)
      SELECT o.node, band, lane, depth, coalesce(callers, 0) AS callers, in_unit, unit_rank, row_number() OVER (ORDER BY band, lane, depth, coalesce(callers, 0) DESC, in_unit NULLS LAST, unit_rank NULLS LAST, p_size, o.node) - 1 AS place
      FROM o JOIN d ON d.node = o.node LEFT JOIN c ON c.node = o.node LEFT JOIN r ON r.unit = o.unit""")  # fmt: skip
def projected_queue(spark, sf_dir):
    visits = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("visits"))
    p = table(spark, sf_dir, "part")
    items = p.selectExpr("p_partkey AS node", "p_size % 7 <> 0 AS open", "p_size % 6 AS lane", "CASE WHEN p_size < 49 THEN p_brand END AS unit", "CASE WHEN p_size % 5 <> 0 THEN p_size * 1000 + p_partkey % 1000 END AS address", "p_size AS size")
    return queues.projected(items.join(visits, "node", "left"), p.selectExpr("p_partkey AS src", "p_partkey DIV 3 AS dst"))


@R.add("d3_layout_census", """WITH f AS (SELECT l_suppkey AS func, l_linenumber AS param, l_partkey % 44 - 2 AS off, CAST(l_quantity AS INT) % 5 + 1 AS width, l_returnflag = 'R' AS is_load, l_linestatus = 'F' AND l_discount < 0.02 AS copied FROM lineitem),
      s AS (SELECT s_suppkey AS func, k AS param, CASE WHEN (s_suppkey + k) % 6 > 0 THEN 'Brand#' || (s_suppkey % 6 + 1) || (k % 5 + 1) END AS struct FROM supplier CROSS JOIN (SELECT unnest(range(1, 6)) AS k) x),
      y AS (SELECT p_brand AS struct, p_partkey % 42 AS off, p_size % 5 + 1 AS width, p_size % 3 = 0 AS padding FROM part),
      a AS (SELECT struct, off, count(*) FILTER (WHERE NOT padding) AS fields, max(width) FILTER (WHERE NOT padding) AS widest, list(width) FILTER (WHERE NOT padding) AS widths FROM y GROUP BY 1, 2),
      h AS (SELECT CASE WHEN s.func IS NULL THEN 'no_signature' WHEN s.struct IS NULL THEN 'param_not_struct' WHEN s.struct NOT IN (SELECT struct FROM y) THEN 'struct_unknown' WHEN f.off < 0 THEN 'negative_offset'
      WHEN a.off IS NULL THEN 'offset_uncovered' WHEN a.fields = 0 THEN 'offset_in_padding' WHEN f.copied THEN 'bulk_copy_excluded' WHEN list_contains(a.widths, f.width) THEN 'agree' WHEN f.is_load AND f.width < a.widest THEN 'subfield_read' ELSE 'disagree' END AS outcome
      FROM f LEFT JOIN s ON f.func = s.func AND f.param = s.param LEFT JOIN a ON a.struct = s.struct AND a.off = f.off)
      SELECT outcome, count(*) AS n, (SELECT CAST(floor(1000.0 * count(*) FILTER (WHERE outcome = 'agree') / count(*)) AS BIGINT) FROM h WHERE outcome IN ('agree', 'subfield_read', 'disagree')) AS accuracy_milli FROM h GROUP BY outcome""")  # fmt: skip
def layout_census(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS func", "l_linenumber AS param", "l_partkey % 44 - 2 AS offset", "CAST(l_quantity AS INT) % 5 + 1 AS width", "l_returnflag = 'R' AS is_load", "l_linestatus = 'F' AND l_discount < 0.02 AS copied")
    params = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    signatures = params.selectExpr("s_suppkey AS func", "k AS param", "CASE WHEN (s_suppkey + k) % 6 > 0 THEN concat('Brand#', s_suppkey % 6 + 1, k % 5 + 1) END AS struct")
    layouts = table(spark, sf_dir, "part").selectExpr("p_brand AS struct", "p_partkey % 42 AS offset", "p_size % 5 + 1 AS width", "p_size % 3 = 0 AS padding")
    return validation.census(validation.held_against_layouts(facts, signatures, layouts))


@R.add("o6_first_success_in_budget", "WITH o AS (SELECT user_id, event_id, event_type, sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS spent FROM events) SELECT user_id, min(spent) AS cost FROM o WHERE event_type = 'purchase' AND spent <= 800 GROUP BY user_id")
def first_success(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["o6_first_success_in_budget"])


# --- scalar functions ---
@R.add("f2_address_parse", "SELECT p_partkey, p_partkey + 4096 AS address FROM part")
def address_parse(spark, sf_dir):
    base = F.concat(F.lit("global:0x"), F.hex(F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", (F.conv(F.substring_index(base, ":0x", -1), 16, 10).cast("long") + 4096).alias("address"))


@R.add("f3_spelling_variants", "SELECT upper(printf('%x', p_partkey % 500)) AS k, count(*) AS n FROM part GROUP BY 1")
def spelling_variants(spark, sf_dir):
    h = F.hex(F.col("p_partkey") % 500)
    mixed = F.when(F.col("p_size") % 2 == 0, F.lower(h)).otherwise(h)
    return table(spark, sf_dir, "part").groupBy(F.upper(mixed).alias("k")).agg(F.count("*").alias("n"))


@R.add("f6_white_space", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))) AS digest FROM documents".replace("\\\\", "\\"))
def white_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace("text", "[ \\t\\n]+", " "))).alias("digest"))


@R.add("f7_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \\n]')) AS tokens FROM documents".replace("\\\\", "\\"))
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \\n]"), F.lit(0))).cast("long").alias("tokens"))


@R.add("f10_word_ngrams", "WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+5], ' '))) AS gram FROM w WHERE len(w) >= 6")
def word_ngrams(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("w")).filter("size(w) >= 6")
    return w.select("item_id", F.explode(text.windows(F.col("w"), 6)).alias("gram"))


@R.add("f11_diff_blocks", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), m AS (SELECT *, line LIKE '%the%' AS hit FROM l), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, hit ORDER BY i) AS blk FROM m) SELECT doc_id, min(i) AS first_line, count(*) AS lines FROM g WHERE hit GROUP BY doc_id, blk")
def diff_blocks(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(F.col("line").contains("the"))
    blk = (F.col("i") + 1) - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return l.withColumn("blk", blk).groupBy("doc_id", "blk").agg((F.min("i") + 1).cast("long").alias("first_line"), F.count("*").alias("lines")).drop("blk")


@R.add("f18_edit_labels", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'legal' WHEN regexp_matches(text, '[|]') THEN 'table' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'contact' ELSE 'prose' END AS label FROM documents")
def edit_labels(spark, sf_dir):
    t = F.col("text")
    label = F.when(F.lower(t).rlike("licen[cs]e"), "legal").when(t.rlike("[|]"), "table").when(t.rlike("[0-9]{3}-[0-9]{4}"), "contact").otherwise("prose")
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


@R.add("f19_references", "SELECT page_id, unnest(regexp_extract_all(url, '[a-z]+[.]example[.][a-z]+')) AS host FROM pages")
def references(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit("[a-z]+[.]example[.][a-z]+"), F.lit(0))).alias("host"))


@R.add("f20_canonical_digest", "SELECT n_nationkey, sha256('{\"key\":' || CAST(n_nationkey AS VARCHAR) || ',\"name\":\"' || n_name || '\"}') AS digest FROM nation")
def canonical_digest(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))), 256).alias("digest"))


@R.add("f23_local_date", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def local_date(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@R.add("f25_optional_fields", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, json_extract_string(props, '$.none.x') AS missing FROM events")
def optional_fields(spark, sf_dir):
    p = F.from_json("props", "k int, none struct<x:string>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), p["none"]["x"].alias("missing"))


@R.add("f16_multiset_metrics", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT coalesce(a.event_type, b.event_type) AS t, a.user_id AS ua, a.n AS x, b.n AS y FROM c a JOIN c b ON b.user_id = a.user_id + 1 AND a.event_type = b.event_type) SELECT ua AS user_id, CAST(sum(least(x, y)) AS BIGINT) AS shared FROM p GROUP BY ua")
def multiset_metrics(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["f16_multiset_metrics"])


# --- logs ---
@R.add("r3_recent_results", "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 40")
def recent_results(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("event_id")).limit(40)


def _events_log(spark, sf_dir, root: str) -> str:
    """The events as log files of JSON lines, the way workers would have appended them."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("worker"), "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")))
    e.select(line.alias("value")).write.text(root + "/log")
    return root + "/log"


def _tailed_events(spark, path: str):
    """Stream of the lines of :func:`_events_log`, parsed; lines that aren't JSON are left out."""
    row = F.from_json("line", "worker string, event_id long, event_type string, value double, micros long")
    return tail.appended_lines(spark, path).select("file", "position", row.alias("r")).filter("r.event_id IS NOT NULL").select("file", "position", "r.*", F.timestamp_micros("r.micros").alias("ts"))


def _to_end(rows, root: str, name: str):
    """What a stream gives until it has read all there is, as a table."""
    rows.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}")


@R.add("r1_tailed_lines", "SELECT event_id, CAST(user_id AS VARCHAR) AS worker, event_type, value, ts FROM events")
def tailed_lines(spark, sf_dir):
    """Every event by way of a log that is tailed by byte offsets."""
    root = _store(spark).path
    return _to_end(_tailed_events(spark, _events_log(spark, sf_dir, root)), root, "lines").select("event_id", "worker", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


@R.add("r1_windowed_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    """Counts of the tailed log in windows of a day; the state of the stream is the whole result."""
    root = _store(spark).path
    rows = _tailed_events(spark, _events_log(spark, sf_dir, root))
    counts = rows.groupBy(F.window("ts", "1 day"), F.col("event_type").alias("status")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")
    last = []

    def keep(batch, number):
        last.append(staged(batch))

    counts.writeStream.outputMode("complete").option("checkpointLocation", root + "/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return last[-1] if last else spark.createDataFrame([], counts.schema)


@R.add("r2_previous_score_stream", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def previous_score_stream(spark, sf_dir):
    """The score before of the same worker, as state over the tailed log."""
    root = _store(spark).path
    rows = _tailed_events(spark, _events_log(spark, sf_dir, root)).select(F.col("worker").alias("function"), "ts", F.col("event_id").alias("place"), F.col("value").alias("score"))
    return _to_end(logs.previous_scores(rows), root, "scores").select(F.col("place").alias("event_id"), "previous")


#: A worker of the recorded log is lost after so many hours without a sign; a purchase ends its run, any other event is a sign of life.
_SILENT_HOURS = 6


@R.add("r5_heartbeat", f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS worker, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'alive' END AS state FROM events),
    s AS (SELECT *, ts + INTERVAL {_SILENT_HOURS} HOUR AS due, lead(ts) OVER w AS following, lag(state) OVER w AS before, lag(ts) OVER w AS earlier, max(ts) OVER () AS clock FROM e WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id))
    SELECT worker, ts AS at, state FROM s WHERE before IS NULL OR before <> state OR (before = 'alive' AND ts > earlier + INTERVAL {_SILENT_HOURS} HOUR)
    UNION ALL SELECT worker, due, 'lost' FROM s WHERE state = 'alive' AND due < coalesce(following, clock)""")  # fmt: skip
def heartbeat_changes(spark, sf_dir):
    """Every change of a worker's state, by timers on the clock of the recorded log."""
    root = _store(spark).path
    rows = _tailed_events(spark, _events_log(spark, sf_dir, root))
    signs = rows.select("worker", "ts", F.col("event_id").alias("place"), F.when(F.col("event_type") == "purchase", "done").otherwise("running").alias("status"))
    with heartbeat.timer_settings(spark):
        out = _to_end(heartbeat.worker_states(signs, _SILENT_HOURS * 3600, recorded=True), root, "changes")
    return out.select("worker", F.col("at").cast("timestamp_ntz").alias("at"), "state")


@R.add("g19_bounded_expansion", "WITH RECURSIVE s AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS v, 0 AS d FROM part UNION SELECT CASE WHEN k = 0 THEN v * 2 ELSE v + 3 END, d + 1 FROM s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) o WHERE d < 6) SELECT v, min(d) AS depth FROM s GROUP BY v")
def bounded_expansion(spark, sf_dir):
    """States reached from the sizes of parts by doubling or adding three in at most six steps, each once."""
    seen = staged(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("v"), F.lit(0).alias("depth")).distinct())
    for d in range(1, 7):
        last = seen.filter(F.col("depth") == d - 1)
        fresh = last.select(F.explode(F.array(F.col("v") * 2, F.col("v") + 3)).alias("v")).distinct().join(seen, "v", "left_anti").withColumn("depth", F.lit(d))
        seen = staged(seen.unionByName(fresh))
    return seen
