"""Queries of the remaining sources, functions and receipts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import matching, sequences, text
from factloom.operators import graphs, order, statistics
from factloom.plans.registry import Registry, statement, table
from factloom.sources import loaders
from factloom.sources.staging import staged
from factloom.sources.store import Store
from factloom.streaming import logs

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _folder(spark) -> str:
    staged(spark.range(1))  # names a shared folder where the session has none
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/factloom/extra-{uuid.uuid4().hex}"


R.sql("s1_read_only_scan", "SELECT event_id, user_id, ts, event_type, value, props FROM events")
R.sql("s18_sql_text", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type ORDER BY n DESC, event_type")
R.sql("f1_sql_scalars", "SELECT doc_id, coalesce(lang, 'none') AS lang, length(text) AS n, CASE WHEN length(text) BETWEEN 100 AND 1000 THEN 1 ELSE 0 END AS medium FROM documents WHERE text IS NOT NULL AND lang LIKE '%'")
R.sql("l15_look_ledger", "SELECT count(*) AS looks, count(DISTINCT user_id) AS readers FROM events WHERE event_type = 'view'")
R.sql("l5_immutable_keys", "SELECT count(*) AS n FROM (SELECT event_id FROM events GROUP BY event_id HAVING count(*) = 1) x")


@R.add("s6_linker_map", "SELECT 'build/' || replace(p_brand, '#', '') || '.o' AS object_path, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1")
def linker_map(spark, sf_dir):
    path = _folder(spark)
    line = F.format_string(" .text          0x%08x       0x%x build/%s.o", F.col("p_partkey") + 0x80000000, F.col("p_size"), F.regexp_replace("p_brand", "#", ""))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return loaders.sections(spark, path).groupBy("object_path").agg(F.sum("size").alias("size"))


@R.add("s6_symbols_of_objects", "SELECT 'part_' || CAST(p_partkey AS VARCHAR) AS name, p_partkey * 64 + 2147483648 AS addr, 'build/' || replace(p_brand, '#', '') || '_' || CAST(p_partkey // 8 AS VARCHAR) || '.o' AS object_path, '.text' AS section FROM part")
def symbols_of_objects(spark, sf_dir):
    """Symbols and the object that each stands in, from linker maps in which each section line has its symbols below it."""
    path = _folder(spark)
    part = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 8).alias("tu"), F.regexp_replace("p_brand", "#", "").alias("brand"))
    each = part.groupBy("tu", "brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))  # of one object
    section = F.format_string(" .text          0x%08x       0x%x build/%s_%d.o", F.col("keys")[0] * 64 + 0x80000000, F.size("keys") * 64, "brand", "tu")
    names = F.transform("keys", lambda k: F.format_string("                0x%08x                part_%d", k * 64 + 0x80000000, k))
    each.select(F.array_join(F.concat(F.array(section), names, F.array(F.lit(" *fill*         0x80000000        0x4 "))), "\n").alias("value")).write.text(path)
    return loaders.map_symbols(spark, path).select("name", "addr", "object_path", "section")


@R.add("s7_symbol_file", "SELECT 'part_' || CAST(p_partkey AS VARCHAR) AS name, p_partkey + 2147483648 AS addr, CASE WHEN p_size % 2 = 0 THEN 'func' END AS kind FROM part")
def symbol_file(spark, sf_dir):
    path = _folder(spark)
    kind = F.when(F.col("p_size") % 2 == 0, " // type:func").otherwise("")
    table(spark, sf_dir, "part").select(F.concat(F.format_string("part_%d = 0x%08X;", "p_partkey", F.col("p_partkey") + 0x80000000), kind).alias("value")).write.text(path)
    return loaders.symbols(spark, path)


@R.add("s9_file_scan", "SELECT lang, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY lang")
def file_scan(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("x"), F.regexp_replace("text", "[\r\n]", " ")).alias("value")).write.partitionBy("lang").text(path)
    files = loaders.source_files(spark, path, "*.txt", ["lang=de"])
    lines = files.select(F.regexp_extract("path", "lang=(\\w+)", 1).alias("lang"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("lang").agg(F.count("*").alias("n"))


#: An image of each part in hexadecimal digits, in words both engines take: magic, entry, title, code and the name behind them.
_IMAGE = "concat('8037124000000000', lpad(hex(p_partkey), 8, '0'), repeat('00', 20), hex(rpad(p_brand, 20, ' ')), repeat('00', 7), hex(rpad(substr(p_type, 1, 4), 4, ' ')), '00', hex(rpad(p_name, 64, '.')))"


@R.add("s5_image_headers", f"""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'z64' WHEN 1 THEN 'v64' ELSE 'n64' END AS byte_order, CAST(128 AS BIGINT) AS size, sha1(unhex({_IMAGE})) AS sha1,
    p_partkey AS entry, trim(p_brand) AS title, rpad(substr(p_type, 1, 4), 4, ' ') AS game_code FROM part""")  # fmt: skip
def image_headers(spark, sf_dir):
    """Images of all parts in three byte orders, brought into one."""
    digits = table(spark, sf_dir, "part").select("p_partkey", F.expr(_IMAGE).alias("d"))
    stored = F.when(F.col("p_partkey") % 3 == 0, F.col("d")).when(F.col("p_partkey") % 3 == 1, F.regexp_replace("d", "(..)(..)", "$2$1")).otherwise(F.regexp_replace("d", "(..)(..)(..)(..)", "$4$3$2$1"))
    found = loaders.image_headers(digits.select(F.col("p_partkey").cast("string").alias("path"), F.unhex(stored).alias("content")))
    return found.select(F.col("path").cast("long").alias("id"), "byte_order", "size", "sha1", "entry", "title", "game_code")


@R.add("s13_json_lines_written", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def json_lines_written(spark, sf_dir):
    path = _folder(spark)
    loaders.write_json_lines(table(spark, sf_dir, "events").select("event_id", "user_id"), path)
    return spark.read.schema("event_id long, user_id long").json(path).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@R.add("s14_commit_history", """SELECT sha1(concat(conv_id, '/', turn)) AS sha, role AS author, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS message,
    CASE WHEN turn % 2 = 1 THEN concat('a/', conv_id) END AS old_path, concat('b/', turn) AS path, CASE WHEN turn % 2 = 1 THEN 'R100' ELSE 'M' END AS status FROM conversations""")  # fmt: skip
def commit_history(spark, sf_dir):
    """Every turn written as a commit and read back, a row for each change."""
    sha = F.sha1(F.concat_ws("/", "conv_id", "turn").cast("binary"))
    change = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("R100\ta/"), "conv_id", F.lit("\tb/"), "turn")).otherwise(F.concat(F.lit("M\tb/"), "turn"))
    head = F.concat_ws(loaders.FIELD, sha, F.lit("2024-01-01T00:00:00Z"), "role", F.coalesce("text", F.lit("")))
    path = _folder(spark)
    table(spark, sf_dir, "conversations").select(F.concat(head, F.lit(f"\n{loaders.MESSAGE_END}\n"), change, F.lit("\n")).alias("value")).write.option("lineSep", loaders.RECORD).text(path)
    found = loaders.commits(spark, path).select("sha", "author", F.md5("message").alias("message"), F.explode("changes").alias("c"))
    return found.select("sha", "author", "message", "c.old_path", "c.path", "c.status")


@R.add("s17_csv_row", "SELECT p_partkey, p_size, p_name FROM part")
def csv_row(spark, sf_dir):
    line = F.concat_ws(",", "p_partkey", "p_size", "p_name")
    parsed = table(spark, sf_dir, "part").select(F.from_csv(line, "p_partkey long, p_size int, p_name string").alias("r"))
    return parsed.select("r.*")


@R.add("s21_markdown_report", """SELECT '## brands' AS line UNION ALL SELECT '| p_brand | n |' UNION ALL SELECT '|---|---|'
    UNION ALL SELECT '| ' || p_brand || ' | ' || CAST(n AS VARCHAR) || ' |' FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10) x""")  # fmt: skip
def markdown_report(spark, sf_dir):
    top = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")
    return spark.createDataFrame([(line,) for line in loaders.report(top, "brands", 10).split("\n")], "line string")


@R.add("o5_best_first_beam", """WITH RECURSIVE b AS (SELECT p_partkey AS v, p_retailprice AS s, 0 AS d FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3) x
    UNION ALL SELECT v, s, d FROM (SELECT c.p_partkey AS v, c.p_retailprice AS s, b.d + 1 AS d, row_number() OVER (ORDER BY c.p_retailprice DESC, c.p_partkey) AS rn FROM b JOIN part c ON CAST(floor(b.v / 2) AS BIGINT) = c.p_partkey WHERE b.d < 4) y WHERE rn <= 3) SELECT DISTINCT v, d FROM b""")  # fmt: skip
def beam(spark, sf_dir):
    """A beam of three over a few rounds; each round is one small join and one top-k."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_retailprice").alias("s"))
    best = [F.desc("s"), F.asc("v")]
    front = staged(part.orderBy(*best).limit(3).withColumn("d", F.lit(0)))
    seen = front
    for d in range(1, 5):
        nxt = front.select(F.floor(F.col("v") / 2).alias("v")).join(part, "v")
        front = staged(nxt.orderBy(*best).limit(3).withColumn("d", F.lit(d)))
        seen = seen.unionByName(front)
    return seen.select("v", "d").distinct()


@R.add("f5_masked_names", "SELECT regexp_replace(p_name, '[a-z]+$', '$R') AS masked, count(*) AS n FROM part GROUP BY 1")
def masked_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.regexp_replace("p_name", "[a-z]+$", "\\$R").alias("masked")).agg(F.count("*").alias("n"))


@R.add("f8_number_tokens", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS number FROM events")
def number_tokens(spark, sf_dir):
    spelled = F.concat(F.lit("0x"), F.hex(F.get_json_object("props", "$.k").cast("long")))
    return table(spark, sf_dir, "events").select("event_id", F.conv(F.substring(spelled, 3, 20), 16, 10).cast("long").alias("number"))


@R.add("f9_novelty_key")
def novelty_key(spark, sf_dir):
    """Turns that are equal but for their names (words of more than three letters) share a key."""
    t = F.transform(F.split("text", " "), lambda w: F.when(F.length(w) > 3, F.concat(F.lit("$"), w)).otherwise(w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(sequences.renamed_apart(t), 256).alias("novelty"))


@R.add("f14_change_vector")
def change_vectors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "[.\\n]").alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", matching.change_vector("w", "v").alias("c")).select("conv_id", "turn", "c.*")


@R.add("f22_pack_and_unpack", "SELECT item_id, md5(text) AS digest FROM benchmark")
def pack_and_unpack(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(sequences.unpacked(sequences.packed("text"))).alias("digest"))


@R.add("f26_remapped_ids", "SELECT event_id, '{\"parent\":' || CAST(event_id + 1000000 AS VARCHAR) || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS record FROM events")
def remapped_ids(spark, sf_dir):
    r = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct((F.col("event_id") + 1_000_000).alias("parent"), r["k"].alias("k"))).alias("record"))


#: Small flow graphs with jumps ahead (diamonds) and back (cycles): 16 parts each, from part 0 to part 15.
_FLOW = """n AS (SELECT CAST(floor(p_partkey / 16) AS BIGINT) AS grp, p_partkey % 16 AS node, CAST(p_size AS BIGINT) AS size FROM part),
    e AS (SELECT grp, node AS src, node + 1 AS dst FROM n WHERE node < 15 UNION SELECT grp, node AS src, (node * 5 + size) % 16 AS dst FROM n)"""


def _dominated(name: str, edges: str, entry: int) -> str:
    """Recursive SQL for the pairs (d, node) of a graph, as :func:`graphs.dominators` has them."""
    return f"""{name}_r AS (SELECT DISTINCT grp, CAST({entry} AS BIGINT) AS node FROM {edges} UNION SELECT x.grp, x.dst FROM {name}_r r JOIN {edges} x ON x.grp = r.grp AND x.src = r.node),
    {name}_a AS (SELECT grp, node AS d, CAST({entry} AS BIGINT) AS node FROM {name}_r WHERE node <> {entry} UNION SELECT x.grp, a.d, x.dst FROM {name}_a a JOIN {edges} x ON x.grp = a.grp AND x.src = a.node AND x.dst <> a.d),
    {name} AS (SELECT x.grp, x.node AS d, y.node FROM {name}_r x JOIN {name}_r y ON x.grp = y.grp LEFT JOIN {name}_a a ON a.grp = x.grp AND a.d = x.node AND a.node = y.node WHERE a.node IS NULL)"""


@R.add("g20_dominators", f"""WITH RECURSIVE {_FLOW}, b AS (SELECT grp, dst AS src, src AS dst FROM e), {_dominated('f', 'e', 0)}, {_dominated('p', 'b', 15)},
    k AS (SELECT grp, node, count(*) AS n FROM f GROUP BY grp, node), i AS (SELECT f.grp, f.node, max_by(f.d, k.n) AS idom FROM f JOIN k ON k.grp = f.grp AND k.node = f.d WHERE f.d <> f.node GROUP BY f.grp, f.node),
    h AS (SELECT DISTINCT e.grp, e.src, e.dst FROM e JOIN f ON f.grp = e.grp AND f.d = e.dst AND f.node = e.src),
    l AS (SELECT grp, head, node FROM (SELECT grp, dst AS head, dst AS node FROM h UNION SELECT grp, dst, src FROM h) x UNION SELECT l.grp, l.head, e.src FROM l JOIN e ON e.grp = l.grp AND e.dst = l.node AND l.node <> l.head JOIN f_r ON f_r.grp = e.grp AND f_r.node = e.src),
    c AS (SELECT grp, node, count(*) AS loops FROM l GROUP BY grp, node), q AS (SELECT grp, node, count(*) AS post FROM p GROUP BY grp, node)
    SELECT k.grp, k.node, k.n AS dominators, i.idom, coalesce(c.loops, 0) AS loops, q.post AS post_dominators FROM k LEFT JOIN i ON i.grp = k.grp AND i.node = k.node LEFT JOIN c ON c.grp = k.grp AND c.node = k.node LEFT JOIN q ON q.grp = k.grp AND q.node = k.node""")  # fmt: skip
def dominators(spark, sf_dir):
    """Of each node of the flow graphs: how many dominate it, the nearest of them, in how many natural loops it is, and how
    many dominate it on the way to the exit."""
    e = statement(spark, sf_dir, f"WITH {_FLOW} SELECT grp, src, dst FROM e")
    at = lambda k: e.select("grp", F.lit(k).cast("long").alias("node")).distinct()
    pairs = staged(graphs.dominators(e, at(0)))
    post = graphs.dominators(e.select("grp", F.col("dst").alias("src"), F.col("src").alias("dst")), at(15)).groupBy("grp", "node").agg(F.count("*").alias("post_dominators"))
    loops = graphs.natural_loops(e, pairs).groupBy("grp", "node").agg(F.count("*").alias("loops"))
    out = graphs.immediate(pairs).join(loops, ["grp", "node"], "left").join(post, ["grp", "node"], "left")
    return out.select("grp", "node", F.col("n").alias("dominators"), "idom", F.coalesce("loops", F.lit(0)).alias("loops"), "post_dominators")


@R.add("g21_liveness", f"""WITH RECURSIVE {_FLOW}, l AS (SELECT grp, node, size % 5 AS name FROM n UNION SELECT e.grp, e.src, l.name FROM l JOIN e ON e.grp = l.grp AND e.dst = l.node LEFT JOIN n ON n.grp = e.grp AND n.node = e.src AND (n.size + n.node) % 5 = l.name WHERE n.node IS NULL)
    SELECT grp, node, count(*) AS live, min(name) AS least, max(name) AS most FROM l GROUP BY grp, node""")  # fmt: skip
def liveness(spark, sf_dir):
    """Names that are live before each node of the flow graphs; each node uses one name and sets one."""
    e = statement(spark, sf_dir, f"WITH {_FLOW} SELECT grp, src, dst FROM e")
    uses = statement(spark, sf_dir, f"WITH {_FLOW} SELECT grp, node, size % 5 AS name FROM n")
    kills = statement(spark, sf_dir, f"WITH {_FLOW} SELECT grp, node, (size + node) % 5 AS name FROM n")
    return graphs.live_in(e, uses, kills).groupBy("grp", "node").agg(F.count("*").alias("live"), F.min("name").alias("least"), F.max("name").alias("most"))


@R.add("x4_sign_test_power", """WITH n AS (SELECT count(DISTINCT p_brand) AS n FROM part), t AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) AS c FROM (SELECT n, unnest(range(n + 1)) AS k FROM n) x),
    p AS (SELECT a.k, least(1, 2 * sum(b.c * pow(0.5, b.n))) AS p FROM t a JOIN t b ON b.k <= least(a.k, a.n - a.k) GROUP BY a.k), s AS (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS share)
    SELECT n AS groups, share, round(sum(c * pow(share, t.k) * pow(1 - share, n - t.k)), 9) AS power FROM t JOIN p ON p.k = t.k CROSS JOIN s WHERE p.p <= 0.05 GROUP BY n, share""")  # fmt: skip
def power(spark, sf_dir):
    groups = table(spark, sf_dir, "part").agg(F.count_distinct("p_brand").alias("groups"))
    cases = groups.crossJoin(F.broadcast(spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "share double")))  # three rows
    return statistics.sign_test_powers(cases).withColumn("power", F.round("power", 9))


@R.add("c6_explicit_split", "SELECT lang, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'train' WHEN 'de' THEN 'dev' WHEN 'es' THEN 'test' END AS split, count(*) AS n FROM documents GROUP BY 1, 2")
def explicit_split(spark, sf_dir):
    named = F.create_map(*[F.lit(x) for x in ("en", "train", "fr", "train", "de", "dev", "es", "test")])[F.col("lang")]
    split = F.when(named.isNull(), F.raise_error(F.concat(F.lit("no split for "), F.coalesce("lang", F.lit("null")))).cast("string")).otherwise(named)
    return table(spark, sf_dir, "documents").groupBy("lang", split.alias("split")).agg(F.count("*").alias("n"))


@R.add("l9_pointer_replaced", "SELECT max(p_size) AS most, count(*) AS n FROM part")
def pointer_replaced(spark, sf_dir):
    s, part = Store(spark, _folder(spark)), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    s.publish("t", part.filter("p_size < 10"))
    s.publish("t", part)
    return s.read("t").agg(F.max("p_size").alias("most"), F.count("*").alias("n"))


@R.add("l16_packed_columns", "SELECT count(*) AS n, count(DISTINCT text) AS texts FROM documents")
def packed_columns(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))


@R.add("l17_keyed_cache", "SELECT md5(event_type) AS key, count(*) AS uses FROM events GROUP BY 1")
def keyed_cache(spark, sf_dir):
    s, e = Store(spark, _folder(spark)), table(spark, sf_dir, "events").select(F.md5("event_type").alias("key"), "event_type")
    s.append_missing("cache", e.distinct(), ["key"])
    return e.join(s.read("cache").select("key"), "key").groupBy("key").agg(F.count("*").alias("uses"))


_RUNS = """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, max(value) > 400 AS paused, min(value) < 0.1 AS changed,
    CASE WHEN max_by(event_type, event_id) = 'purchase' THEN 0 ELSE 1 END AS code FROM events GROUP BY user_id"""


@R.add("r6_retry_decisions", f"SELECT user_id, CASE WHEN paused THEN 'wait' WHEN changed THEN 'restart' WHEN code = 0 THEN 'finish' WHEN failures < 60 THEN 'retry' ELSE 'stop' END AS decision FROM ({_RUNS}) x")
def retry_decisions(spark, sf_dir):
    runs = statement(spark, sf_dir, _RUNS)
    return runs.select("user_id", logs.retry_decision(F.col("paused"), F.col("changed"), F.col("code"), F.col("failures"), 60).alias("decision"))


@R.add("s4_decoded_rows", "SELECT p_partkey * 4 + 4096 AS addr, p_type AS op, p_name AS args, 'f' || CAST(CAST(floor((p_partkey * 4 + 4096) / 64) AS BIGINT) AS VARCHAR) AS function FROM part")
def decoded_rows(spark, sf_dir):
    path = _folder(spark)
    at = F.col("p_partkey") * 4 + 4096
    row = F.concat(F.lit("  "), F.lower(F.hex(at)), F.lit(":\t"), F.lpad(F.lower(F.hex("p_size")), 8, "0"), F.lit(" \t"), "p_type", F.lit("\t"), "p_name")
    # a listing for each 64 KiB of addresses; the functions' first lines may stand anywhere in it
    part = table(spark, sf_dir, "part").withColumn("section", F.floor(at / 65536))
    begins = part.select("section", (F.floor(at / 64) * 64).alias("a")).distinct().select("section", F.concat(F.lower(F.hex("a")), F.lit(" <f"), F.floor(F.col("a") / 64).cast("string"), F.lit(">:")).alias("value"))
    other = part.select("section", F.lit("Disassembly of section .text:").alias("value")).distinct()
    part.select("section", row.alias("value")).unionByName(begins).unionByName(other).repartition("section").write.partitionBy("section").text(path)
    return loaders.decoded(spark, path).select("addr", "op", "args", "function")


@R.add("s19_status_sink", "SELECT user_id AS function, count(*) AS tries, max(value) AS best FROM events GROUP BY user_id")
def status_sink(spark, sf_dir):
    """A log of JSON lines kept as a status table by a stream, batch after batch; a dashboard reads the store."""
    root = _folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("function"), F.col("event_type").alias("status"), F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("part"))
    store = Store(spark, root + "/store")
    for k in range(3):  # the log grows between the runs
        e.filter(F.col("part") == k).drop("part").write.mode("append").json(root + "/log")
        logs.run_to_end(logs.tail(spark, root + "/log"), root + "/ck", logs.status_sink(store, "status"))
    return store.read("status").select(F.col("function").cast("long").alias("function"), "tries", "best")


@R.add("r7_import_once", "SELECT count(*) AS n FROM events WHERE event_type = 'purchase'")
def import_once(spark, sf_dir):
    s, rows = Store(spark, _folder(spark)), table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "value")
    for _ in range(2):
        s.import_job("log", rows, "event_id", "worker-1")
    return s.read("log").agg(F.count("*").alias("n"))


@R.add("r8_ordered_import", "SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS place FROM events")
def ordered_import(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return order.numbered(ids, [F.asc("id")]).withColumn("place", F.col("place") + 1)


@R.add("r8_parallel_dispatch", """WITH w AS (SELECT user_id % 6 AS job, user_id, count(*) AS n, max(value) AS best FROM events GROUP BY 1, 2)
    SELECT row_number() OVER (ORDER BY job >= 4, job, user_id) AS id, job, n, best FROM w""")  # fmt: skip
def parallel_dispatch(spark, sf_dir):
    """Jobs worked on side by side, each in tasks of its own; two rounds of results, the second with jobs that came before."""
    work = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 6).alias("job"), F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max("value").alias("best"))
    store = Store(spark, _folder(spark))
    for jobs in (4, 6):
        store.import_jobs("log", work.filter(F.col("job") < jobs), "id", "job")
    return store.read("log").select("id", "job", "n", "best")


@R.add("f7_windows_of_words", "SELECT item_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS words FROM benchmark")
def words_of_items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(text.words(F.col("text"))).cast("long").alias("words"))
