"""Queries of text, similarity, statistics and split operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import leakage, similarity, statistics
from factloom.plans.registry import Registry, statement, table
from factloom.sources.staging import staged

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_W = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')"
_GRAMS = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i+{k}-1], ' ')) END"
_SKETCH = f"list_sort(list_distinct(list_transform({_GRAMS.format(k=5)}, lambda g: substring(md5(g), 1, 16))))[1:96]"
_SKETCHED = f"WITH d AS (SELECT doc_id, source, {_W} AS w FROM documents), s AS (SELECT doc_id, source, len(w) AS tokens, {_SKETCH} AS sketch FROM d)"


def _sketched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"), text.words(F.col("text")).alias("w"))
    return d.select("id", "owner", F.size("w").cast("long").alias("tokens"), text.sketch(F.col("w")).alias("sketch"))


@R.add("m1_sketch", _SKETCHED + " SELECT doc_id, tokens, array_to_string(sketch[1:3], ' ') AS least FROM s")
def sketches(spark, sf_dir):
    return _sketched(spark, sf_dir).select(F.col("id").alias("doc_id"), "tokens", F.array_join(F.slice("sketch", 1, 3), " ").alias("least"))


_OVERLAP = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) END"


@R.add("m2_sketch_overlap", _SKETCHED + f" SELECT x.doc_id AS a, y.doc_id AS b, {_OVERLAP.format(a='x.sketch', b='y.sketch')} AS shared FROM s x JOIN s y ON y.doc_id = x.doc_id + 1")
def sketch_overlap(spark, sf_dir):
    s = _sketched(spark, sf_dir)
    nxt = s.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("sketch").alias("other"))
    return s.join(nxt, "id").select(F.col("id").alias("a"), "b", text.overlap(F.col("sketch"), F.col("other")).alias("shared"))


@R.add("m3_similar_top_k", _SKETCHED + """, p AS (SELECT x.doc_id AS left_id, y.doc_id AS right_id, round_even(CAST(len(list_intersect(x.sketch, y.sketch)) AS DOUBLE) / least(len(x.sketch), len(y.sketch)), 6) AS similarity,
    abs(y.tokens - x.tokens) AS far, y.source FROM s x JOIN s y ON x.source <> y.source AND y.tokens >= greatest(1, floor(x.tokens / 3)) AND y.tokens <= greatest(3, 3 * x.tokens) WHERE x.doc_id % 100 = 0 AND len(list_intersect(x.sketch, y.sketch)) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, far, source, right_id) AS rank FROM p) SELECT left_id, right_id, similarity, rank FROM r WHERE rank <= 5""")  # fmt: skip
def similar_top_k(spark, sf_dir):
    s = staged(_sketched(spark, sf_dir))
    return similarity.similar(s.filter("id % 100 = 0"), s, 5)


@R.add("m4_index_verdict", f"""WITH c AS (SELECT doc_id AS id, {_W} AS w FROM documents), i AS (SELECT item_id AS id, {_W} AS w FROM benchmark),
    cs AS (SELECT id, len(w) AS tokens, array_to_string(w, ' ') AS t, {_SKETCH} AS sketch FROM c), ix AS (SELECT id, len(w) AS tokens, array_to_string(w, ' ') AS t, {_SKETCH} AS sketch FROM i),
    n AS (SELECT DISTINCT a.id FROM cs a JOIN ix b ON a.tokens >= 40 AND b.tokens >= 40 AND len(list_intersect(a.sketch, b.sketch)) > 0 AND len(list_intersect(a.sketch, b.sketch)) >= 0.5 * least(len(a.sketch), len(b.sketch)))
    SELECT id, CASE WHEN t IN (SELECT t FROM ix) THEN 'exact' WHEN id IN (SELECT id FROM n) THEN 'near' ELSE 'clean' END AS verdict FROM cs""")  # fmt: skip
def index_verdict(spark, sf_dir):
    def rows(name, key):
        d = table(spark, sf_dir, name).select(F.col(key).alias("id"), text.words(F.col("text")).alias("w"))
        return d.select("id", F.sha2(F.array_join("w", " "), 256).alias("digest"), F.size("w").alias("tokens"), text.sketch(F.col("w")).alias("sketch"))

    return similarity.verdicts(rows("documents", "doc_id"), rows("benchmark", "item_id"), 0.5, 40)


@R.add("m6_weighted_rerank", """WITH x AS (SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN CAST(l.quality AS DOUBLE) END AS assembly, least(d.n_chars / 4000.0, 1) AS size, CASE WHEN d.lang <> 'de' THEN CAST(d.doc_id % 2 AS DOUBLE) END AS leaf FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, round((coalesce(assembly * 0.6, 0) + coalesce(size * 0.15, 0) + coalesce(leaf * 0.1, 0)) / (CASE WHEN assembly IS NULL THEN 0 ELSE 0.6 END + 0.15 + CASE WHEN leaf IS NULL THEN 0 ELSE 0.1 END), 6) AS score FROM x""")  # fmt: skip
def weighted_rerank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    x = d.select("doc_id", F.col("quality").cast("double").alias("assembly"), F.least(F.col("n_chars") / 4000, F.lit(1.0)).alias("size"), F.when(F.col("lang") != "de", (F.col("doc_id") % 2).cast("double")).alias("leaf"))
    return x.select("doc_id", F.round(similarity.weighted_mean({"assembly": 0.6, "size": 0.15, "leaf": 0.1}), 6).alias("score"))


@R.add("m7_affinity_edges", _SKETCHED + """, h AS (SELECT doc_id, len(sketch) AS n, unnest(sketch) AS h FROM s), e AS (SELECT x.doc_id AS a, y.doc_id AS b, CAST(count(*) AS DOUBLE) / (x.n + y.n - count(*)) AS j FROM h x JOIN h y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n)
    SELECT a, b, round(j, 9) AS affinity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS rn FROM e WHERE j >= 0.45) r WHERE rn <= 4""")  # fmt: skip
def affinity_edges(spark, sf_dir):
    pairs = similarity.similar_pairs(_sketched(spark, sf_dir), "sketch", 0.45)
    top = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("jaccard"), "right_id"))).filter("rn <= 4")
    return top.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("jaccard", 9).alias("affinity"))


_NGRAM = f"WITH d AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, unnest({_GRAMS.format(k=2)}) AS gram FROM d WHERE len(w) >= 2)"


@R.add("a20_ngram_counts", _NGRAM + " SELECT gram, count(*) AS n, min(doc_id) AS example FROM g GROUP BY gram HAVING count(*) >= 8")
def ngram_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w")).filter("size(w) >= 2")
    g = d.select("doc_id", F.explode(text.windows(F.col("w"), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc_id").alias("example")).filter("n >= 8")


@R.add("m9_idiom_score", _NGRAM + """ SELECT gram, n, round(CASE WHEN hot = 0 THEN 0 ELSE hot / 2.0 - 0.3 * dull / 2.0 END, 6) AS score FROM (SELECT gram, count(*) AS n,
    len(list_filter(string_split(gram, ' '), lambda x: length(x) >= 6)) AS hot, len(list_filter(string_split(gram, ' '), lambda x: length(x) <= 2)) AS dull FROM g GROUP BY gram HAVING count(*) >= 8) x ORDER BY score DESC, n DESC, gram""")  # fmt: skip
def idiom_score(spark, sf_dir):
    g = ngram_counts(spark, sf_dir).drop("example")
    count = lambda cond: F.size(F.filter(F.split("gram", " "), cond))
    hot, dull = count(lambda x: F.length(x) >= 6), count(lambda x: F.length(x) <= 2)
    return g.select("gram", "n", F.round(F.when(hot == 0, 0.0).otherwise(hot / 2 - 0.3 * dull / 2), 6).alias("score")).orderBy(F.desc("score"), F.desc("n"), "gram")


@R.add("a22_multiset_intersection", f"""WITH w AS (SELECT doc_id, unnest({_W}) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY 1, 2)
    SELECT x.doc_id AS a, y.doc_id AS b, CAST(sum(least(x.n, y.n)) AS BIGINT) AS shared FROM c x JOIN c y ON x.t = y.t AND y.doc_id = x.doc_id + 1 GROUP BY 1, 2""")  # fmt: skip
def multiset_intersection(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("t"))
    c = w.groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    nxt = c.select((F.col("doc_id") - 1).alias("doc_id"), "t", F.col("n").alias("k"))
    return c.join(nxt, ["doc_id", "t"]).groupBy(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).agg(F.sum(F.least("n", "k")).alias("shared"))


@R.add("m11_coverage_of_residuals", f"""WITH d AS (SELECT doc_id, lang, {_W} AS w FROM documents), g AS (SELECT DISTINCT doc_id, lang, unnest({_GRAMS.format(k=3)}) AS g FROM d WHERE len(w) >= 3),
    r AS (SELECT g FROM g GROUP BY g HAVING count(*) <= 0.05 * (SELECT count(*) FROM documents)), s AS (SELECT DISTINCT g FROM g WHERE doc_id % 2 = 1), t AS (SELECT doc_id, lang, g, g IN (SELECT g FROM r) AS rare, g IN (SELECT g FROM s) AS hit FROM g WHERE doc_id % 2 = 0)
    SELECT doc_id, CASE WHEN count(*) FILTER (WHERE rare) = 0 THEN 'unshaped' WHEN count(*) FILTER (WHERE rare AND hit) >= 1 AND count(*) FILTER (WHERE hit) >= 0.25 * count(*) THEN 'reproduced' ELSE 'gap' END AS verdict FROM t GROUP BY doc_id""")  # fmt: skip
def coverage_of_residuals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d, most = docs.select("doc_id", text.words(F.col("text")).alias("w")).filter("size(w) >= 3"), 0.05 * docs.count()
    g = d.select("doc_id", F.explode(F.array_distinct(text.windows(F.col("w"), 3))).alias("g"))
    rare = g.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("g", F.lit(True).alias("rare"))
    sample = g.filter("doc_id % 2 = 1").select("g").distinct().withColumn("hit", F.lit(True))
    t = g.filter("doc_id % 2 = 0").join(rare, "g", "left").join(sample, "g", "left")
    x = t.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("rare").alias("r"), F.count_if(F.col("rare") & F.col("hit")).alias("rh"), F.count_if("hit").alias("h"))
    return x.select("doc_id", F.when(F.col("r") == 0, "unshaped").when((F.col("rh") >= 1) & (F.col("h") >= 0.25 * F.col("n")), "reproduced").otherwise("gap").alias("verdict"))


@R.add("c10_token_leaks", f"""WITH a AS (SELECT item_id AS id, {_W} AS w FROM benchmark), p AS (SELECT {_W} AS w FROM documents), b AS (SELECT conv_id AS id, {_W} AS w FROM conversations), bg AS (SELECT DISTINCT id, unnest({_GRAMS.format(k=8)}) AS g FROM b WHERE len(w) > 0), ag AS (SELECT DISTINCT id, unnest({_GRAMS.format(k=8)}) AS g FROM a WHERE len(w) > 0),
    common AS (SELECT g FROM bg GROUP BY g HAVING count(DISTINCT id) >= 2), pg AS (SELECT DISTINCT unnest({_GRAMS.format(k=8)}) AS g FROM p)
    SELECT a.id, (SELECT count(*) FROM ag WHERE ag.id = a.id AND g IN (SELECT g FROM pg) AND g NOT IN (SELECT g FROM common)) AS shared FROM a""")  # fmt: skip
def token_leaks(spark, sf_dir):
    # words are a column of their own, so that no window works them out again
    words = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), text.words(F.col("text")).alias("w"))
    grams = lambda name, key: words(name, key).select("id", text.windows(F.col("w"), 8).alias("grams"))
    return similarity.leaks(grams("benchmark", "item_id"), grams("documents", "doc_id"), grams("conversations", "conv_id"))


#: Words that keep their place in the skeleton of a text, as keywords do in code.
_SKELETON = "a an and as at by for from in is it of on or that the to was with de des du en et la le les que un une das dem den der des die ein eine ist und von zu al con del el las los no por se su y".split()
_TOKENS_SQL = "regexp_extract_all(regexp_replace(coalesce(text, ''), '(?s)/\\*.*?\\*/|//[^\n]*', ' ', 'g'), '(0[xX][0-9a-fA-F]+|[0-9]+(?:\\.[0-9]*)?|[\\p{L}_][\\p{L}\\p{M}\\p{N}_]*|->|<<=|>>=|&&|\\|\\||\\+\\+|--|<<|>>|[-+*/%&|^!=<>]=|[^\\s\\p{L}\\p{N}_])')"
_MASKED = f"list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '^[\\p{{L}}_]') AND NOT list_contains({_SKELETON}, x) THEN 'ID' ELSE x END)"


def _window_sql(kind: str, k: int) -> str:
    gram = lambda t: f"SELECT id, i, array_to_string({kind}[i:i + {k - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len({kind}) - {k - 2})) AS i FROM {t}) z"
    return f"""{kind}_b AS (SELECT g FROM (SELECT DISTINCT id, g FROM ({gram('b')}) y) x GROUP BY g HAVING count(*) >= 2), {kind}_a AS (SELECT * FROM ({gram('a')}) y WHERE g NOT IN (SELECT g FROM {kind}_b)),
    {kind}_p AS (SELECT * FROM ({gram('p')}) y WHERE g IN (SELECT g FROM {kind}_a)), {kind}_m AS (SELECT x.id, y.id AS page, x.i, y.i AS j FROM {kind}_a x JOIN {kind}_p y USING (g)),
    {kind}_r AS (SELECT id, page, d, i - row_number() OVER (PARTITION BY id, page, d ORDER BY i) AS isl, i FROM (SELECT *, j - i AS d FROM {kind}_m) z), {kind}_l AS (SELECT id, max(n) + {k - 1} AS longest FROM (SELECT id, page, d, isl, count(*) AS n FROM {kind}_r GROUP BY ALL) z GROUP BY id),
    {kind}_n AS (SELECT id, max(n) AS n FROM (SELECT id, page, count(DISTINCT i) AS n FROM {kind}_m GROUP BY ALL) z GROUP BY id)"""


@R.add("c10_structural_leaks", f"""WITH t AS (SELECT 'a' AS kind, item_id AS id, {_TOKENS_SQL} AS raw FROM benchmark UNION ALL SELECT 'p', doc_id, {_TOKENS_SQL} FROM documents UNION ALL SELECT 'b', conv_id * 100 + turn, {_TOKENS_SQL} FROM conversations), s AS MATERIALIZED (SELECT *, {_MASKED} AS structural FROM t),
    a AS (SELECT * FROM s WHERE kind = 'a'), p AS (SELECT * FROM s WHERE kind = 'p'), b AS (SELECT * FROM s WHERE kind = 'b'), {_window_sql('raw', 12)}, {_window_sql('structural', 24)},
    f AS (SELECT doc_id AS page, ' ' || trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) || ' ' AS flat FROM documents), ln AS (SELECT id, k, trim(regexp_replace(line, '[ \\t-\\r]+', ' ', 'g')) AS line FROM (SELECT item_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM benchmark) z),
    lg AS (SELECT * FROM ln WHERE length(line) >= 16 AND len(string_split(line, ' ')) >= 3 AND line NOT LIKE '//%' AND line NOT LIKE '/*%'), lt AS (SELECT id, count(*) AS n FROM lg GROUP BY id),
    lh AS (SELECT id, max(h) AS h FROM (SELECT id, page, count(*) AS h FROM lg JOIN f ON contains(flat, ' ' || line || ' ') GROUP BY ALL) z GROUP BY id),
    o AS (SELECT item_id AS id, coalesce(raw_n.n, 0) AS raw, coalesce(raw_l.longest, 0) AS longest_raw, coalesce(structural_n.n, 0) AS structural, coalesce(structural_l.longest, 0) AS longest_structural, coalesce(round(lh.h / CAST(lt.n AS DOUBLE), 3), 0) AS lines
      FROM benchmark LEFT JOIN raw_n ON raw_n.id = item_id LEFT JOIN raw_l ON raw_l.id = item_id LEFT JOIN structural_n ON structural_n.id = item_id LEFT JOIN structural_l ON structural_l.id = item_id LEFT JOIN lt ON lt.id = item_id LEFT JOIN lh ON lh.id = item_id)
    SELECT *, raw > 0 OR structural > 0 OR lines >= 0.3 AS leak FROM o""")  # fmt: skip
def structural_leaks(spark, sf_dir):
    """Benchmark items that stand in documents: word for word, with their names changed, or line by line."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    background = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return leakage.leak_report(b.select(F.col("item_id").alias("id"), "text"), d.select(F.col("doc_id").alias("id"), "text"), background, _SKELETON)


@R.add("m14_group_balanced_forecast", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT t.vec_id AS id, k.label AS grp, k.vec_id AS outcome,
    list_sum(list_transform(list_zip(t.v, k.v), lambda z: abs(z[1] - z[2]))) / len(t.v) AS d FROM v t JOIN v k ON k.vec_id <> t.vec_id WHERE t.vec_id % 100 = 0),
    n AS (SELECT id, grp, min(d) AS d, avg(outcome) AS outcome FROM (SELECT *, rank() OVER (PARTITION BY id, grp ORDER BY d) AS r FROM p WHERE d <= 0.6) x WHERE r = 1 GROUP BY id, grp),
    f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, grp) AS g FROM n), s AS (SELECT id, sum(outcome / (0.05 + d)) / sum(1 / (0.05 + d)) AS f, count(*) AS n FROM f WHERE g <= 5 GROUP BY id)
    SELECT v.vec_id AS id, CASE WHEN n >= 2 THEN round(f, 6) END AS forecast, coalesce(n, 0) AS groups FROM v LEFT JOIN s ON v.vec_id = s.id WHERE v.vec_id % 100 = 0""")  # fmt: skip
def group_balanced_forecast(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    known = v.select(F.col("vec_id").alias("known_id"), F.col("label").alias("grp"), "v", F.col("vec_id").cast("double").alias("outcome"))
    return similarity.forecast(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "v"), known).withColumn("forecast", F.round("forecast", 6))


@R.add("m15_feature_scaling", "WITH m AS (SELECT max(abs(ln(1 + abs(value)))) AS m FROM events) SELECT event_id, round(sign(value) * ln(1 + abs(value)) / m, 9) AS scaled FROM events CROSS JOIN m")
def feature_scaling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = e.agg(F.max(F.abs(text.log_signed(F.col("value")))).alias("m"))  # one row
    return e.join(F.broadcast(top)).select("event_id", F.round(text.log_signed(F.col("value")) / F.col("m"), 9).alias("scaled"))


@R.add("m16_hypothesis_lookup", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'wid') OR contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'econ')")
def hypothesis_lookup(spark, sf_dir):
    hay = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").filter(F.exists(F.array(F.lit("wid"), F.lit("econ")), lambda t: hay.contains(t))).select("p_partkey")


@R.add("m10_rare_anchor_rate", f"WITH d AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format(k=3)}) AS g FROM d WHERE len(w) >= 3), n AS (SELECT count(*) AS n FROM documents) SELECT g, count(*) / CAST(max(n) AS DOUBLE) AS rate FROM g CROSS JOIN n GROUP BY g HAVING count(*) <= 0.05 * max(n) AND count(*) >= 3")
def rare_anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    d, n = docs.select("doc_id", text.words(F.col("text")).alias("w")).filter("size(w) >= 3"), docs.count()
    g = d.select("doc_id", F.explode(F.array_distinct(text.windows(F.col("w"), 3))).alias("g"))
    return g.groupBy("g").agg(F.count("*").alias("n")).filter((F.col("n") <= 0.05 * n) & (F.col("n") >= 3)).select("g", (F.col("n") / n).alias("rate"))


@R.add("m20_permutation_recovery", """WITH a AS (SELECT conv_id, list(role || CAST(turn AS VARCHAR) ORDER BY turn) AS x, list(role || CAST(turn AS VARCHAR) ORDER BY length(text), turn) AS y FROM conversations GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_transform(y, lambda v: list_position(x, v)), ',') AS places FROM a WHERE x <> y""")  # fmt: skip
def permutations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.concat("role", F.col("turn").cast("string")))
    a = c.groupBy("conv_id").agg(F.expr("transform(array_sort(collect_list(struct(turn, k))), s -> s.k)").alias("x"), F.expr("transform(array_sort(collect_list(struct(length(text) AS l, turn, k))), s -> s.k)").alias("y"))
    return a.filter("x <> y").select("conv_id", F.expr("array_join(transform(y, v -> array_position(x, v)), ',')").alias("places"))


@R.add("j15_postings_candidates", _SKETCHED + ", m AS (SELECT doc_id, unnest(sketch) AS h FROM s) SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS shared FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 20")
def postings(spark, sf_dir):
    return similarity.overlapping_pairs(_sketched(spark, sf_dir), "sketch", 20)


@R.add("f15_jaccard", f"WITH d AS (SELECT doc_id, list_distinct({_W}) AS w FROM documents) SELECT a.doc_id, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def jaccards(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(nxt, "doc_id").select("doc_id", text.jaccard(F.col("w"), F.col("v")).alias("jaccard"))


@R.add("f4_normalised_messages", "WITH m AS (SELECT 'f' || CAST(event_id AS VARCHAR) || ':12: bad ''' || event_type || '''  at 0x' || printf('%x', event_id) AS m FROM events) SELECT substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '^\\S+:\\d+(:\\d+)?:\\s*', ''), '''[^'']*''', '''X''', 'g'), '0x[0-9a-fA-F]+', '0xN', 'g'), '\\s+', ' ', 'g')), 1, 110) AS message, count(*) AS n FROM m GROUP BY 1".replace("\\\\", "\\"))
def normalised_messages(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(":12: bad '"), "event_type", F.lit("'  at 0x"), F.lower(F.hex("event_id"))).alias("m"))
    return m.groupBy(text.plain_message(F.col("m")).alias("message")).agg(F.count("*").alias("n"))


@R.add("f21_hash_buckets", "SELECT p_partkey, CAST(('0x' || substring(sha256('s:' || p_brand), 1, 2)) AS INT) < 64 AS sealed, CAST(('0x' || substring(sha256(CAST(p_partkey AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS family FROM part")
def hash_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.sealed("s", F.col("p_brand"), 0.25).alias("sealed"), text.hash_bucket(F.col("p_partkey").cast("string"), 8, 100).alias("family"))


@R.add("f24_half_even_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount, 1) AS rounded FROM lineitem WHERE l_quantity = 1")
def half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_quantity = 1").select("l_orderkey", "l_linenumber", text.half_even(F.col("l_extendedprice") * F.col("l_discount"), 1).alias("rounded"))


@R.add("f17_distances", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS l1 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distances(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(text.l1(F.col("v"), F.col("w")), 6).alias("l1"))


@R.add("f12_alignment")
def alignments(spark, sf_dir):
    from factloom.functions.matching import block_distance, change_vector
    from factloom.functions.sequences import aligned

    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", "[.\\n]").alias("w"))
    nxt = d.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    x = d.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", aligned("w", "v").alias("a"), block_distance("w", "v").alias("blocks"), change_vector("w", "v").alias("c"))
    return x.select("conv_id", "turn", "a.cost", "a.ways", "blocks", "c.added", "c.removed", "c.changed")


# --- statistics ---
_ARMS = "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS control, count(*) FILTER (WHERE event_type = 'view') AS treatment FROM events GROUP BY user_id"


@R.add("x2_paired_verdict", f"""WITH a AS (SELECT user_id, control > 12 AS c, treatment > 12 AS t, control AS cc, treatment AS tc FROM ({_ARMS}) x), s AS (SELECT count(*) FILTER (WHERE c IS NULL OR t IS NULL) AS missing, count(*) FILTER (WHERE c AND NOT t) AS lost,
    count(*) FILTER (WHERE NOT c AND t) AS gained, sum(cc) AS c, sum(tc) AS t FROM a) SELECT missing, lost, gained, CASE WHEN missing > 0 THEN 'incomplete' WHEN lost > 0 THEN 'refuse' WHEN gained > 0 THEN 'accept' WHEN t < c THEN 'accept_cheaper' ELSE 'keep' END AS verdict FROM s""")  # fmt: skip
def paired_verdict(spark, sf_dir):
    a = statement(spark, sf_dir, _ARMS)
    return statistics.verdict(a.select((F.col("control") > 12).alias("control"), (F.col("treatment") > 12).alias("treatment"), F.col("control").alias("control_cost"), F.col("treatment").alias("treatment_cost")))


@R.add("x3_sign_test", f"""WITH RECURSIVE d AS (SELECT user_id % 12 AS g, sum(treatment - control) AS d FROM ({_ARMS}) x GROUP BY 1), s AS (SELECT count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses FROM d),
    b AS (SELECT 0 AS k, 1.0::DOUBLE AS c, wins, losses FROM s UNION ALL SELECT k + 1, c * (wins + losses - k) / (k + 1), wins, losses FROM b WHERE k < least(wins, losses))
    SELECT CAST(wins AS INT) AS wins, CAST(losses AS INT) AS losses, round(least(1.0, 2 * sum(c) / pow(2, wins + losses)), 9) AS p FROM b GROUP BY wins, losses""")  # fmt: skip
def sign_test(spark, sf_dir):
    a = statement(spark, sf_dir, _ARMS).withColumn("g", F.col("user_id") % 12)
    return statistics.sign_test(a, "g", F.col("treatment") - F.col("control")).withColumn("p", F.round("p", 9))


@R.add("x5_two_proportions", """WITH s AS (SELECT count(*) FILTER (WHERE event_type = 'click') AS na, count(*) FILTER (WHERE event_type = 'click' AND value > 50) AS a, count(*) FILTER (WHERE event_type = 'view') AS nb, count(*) FILTER (WHERE event_type = 'view' AND value > 50) AS b FROM events)
    SELECT round((a / na - b / nb) / sqrt((a + b) / (na + nb) * (1 - (a + b) / (na + nb)) * (1 / na + 1 / nb)), 9) AS z FROM s""")  # fmt: skip
def two_proportions(spark, sf_dir):
    s = table(spark, sf_dir, "events").agg(*[F.count_if((F.col("event_type") == t) & (F.col("value") > v)).alias(f"{t}_{n}") for t in ("click", "view") for n, v in (("n", -1), ("hit", 50))])
    return s.select(F.round(statistics.two_proportions(F.col("click_hit"), F.col("click_n"), F.col("view_hit"), F.col("view_n")), 9).alias("z"))


@R.add("o7_pareto", "WITH p AS (SELECT user_id, event_id, value, length(props) + event_id % 50 AS cost FROM events) SELECT user_id, event_id, value, cost FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.user_id = a.user_id AND b.value >= a.value AND b.cost <= a.cost AND (b.value > a.value OR b.cost < a.cost))")
def pareto(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.length("props") + F.col("event_id") % 50).alias("cost"))
    return statistics.pareto(p, ["user_id"], "value", "cost").select("user_id", "event_id", "value", "cost")


@R.add("x8_label_set_changes", """WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS x FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00' GROUP BY user_id), b AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS y FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY user_id)
    SELECT user_id, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS gone, array_to_string(list_sort(list_filter(y, lambda v: NOT list_contains(x, v))), ',') AS fresh FROM a JOIN b USING (user_id)""")  # fmt: skip
def label_set_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.filter("ts < '2024-01-03'").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("x"))
    b = e.filter("ts >= '2024-01-28'").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("y"))
    return a.join(b, "user_id").select("user_id", F.array_join(F.array_except("x", "y"), ",").alias("gone"), F.array_join(F.array_except("y", "x"), ",").alias("fresh"))


@R.add("j19_paired_arms", f"SELECT user_id, control, treatment FROM ({_ARMS}) x")
def paired_arms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct()
    arm = lambda kind: users.join(e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").fillna(0, ["n"])
    return statistics.paired(arm("click"), arm("view"), "user_id", "n")


# --- more aggregates ---
@R.add("a12_label_set_histogram", "WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS c FROM events WHERE value > 100 GROUP BY user_id) SELECT array_to_string(c, '+') AS labels, len(c) AS size, count(*) AS n FROM s GROUP BY 1, 2")
def label_sets(spark, sf_dir):
    s = table(spark, sf_dir, "events").filter("value > 100").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("c"))
    return s.groupBy(F.array_join("c", "+").alias("labels"), F.size("c").cast("long").alias("size")).agg(F.count("*").alias("n"))


@R.add("a15_signed_vote", """SELECT l_partkey AS place, max(l_quantity) AS width, count(*) FILTER (WHERE l_linestatus = 'O') >= count(*) FILTER (WHERE l_linestatus = 'F') AS signed, count(DISTINCT l_suppkey) AS contributors FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2""")
def signed_vote(spark, sf_dir):
    yes, no = F.count_if(F.col("l_linestatus") == "O"), F.count_if(F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("place")).agg(F.max("l_quantity").alias("width"), (yes >= no).alias("signed"), F.count_distinct("l_suppkey").alias("contributors")).filter("contributors >= 2")


@R.add("a16_widest_per_key", "SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) x WHERE rn = 1")
def widest(spark, sf_dir):
    best = F.max_by(F.struct("l_orderkey", "l_quantity"), F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("b")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(best).select("l_partkey", "b.l_orderkey", "b.l_quantity")


@R.add("a18_majority_with_share", "WITH c AS (SELECT l_suppkey AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY k) AS DOUBLE) AS share, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS rn FROM c) SELECT k, CASE WHEN share >= 0.35 THEN v ELSE 'unknown' END AS kind, round(share, 2) AS agreement FROM s WHERE rn = 1")
def majority(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["a18_majority_with_share"])


@R.add("a17_leave_one_out", "SELECT a.l_suppkey AS k, a.l_partkey AS target, count(DISTINCT b.l_returnflag) AS pooled FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a LEFT JOIN lineitem b ON b.l_suppkey = a.l_suppkey AND b.l_partkey <> a.l_partkey GROUP BY 1, 2")
def leave_one_out(spark, sf_dir):
    """The pool of a key without a target's own rows: distinct values of the key, less those that only the target has."""
    l = table(spark, sf_dir, "lineitem")
    each = l.select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    owners = each.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("owners"))
    pool = owners.groupBy("l_suppkey").agg(F.count("*").alias("values"))
    only = each.join(owners.filter("owners = 1"), ["l_suppkey", "l_returnflag"]).groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("only"))
    t = l.select("l_suppkey", "l_partkey").distinct().join(pool, "l_suppkey", "left").join(only, ["l_suppkey", "l_partkey"], "left")
    return t.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("target"), (F.coalesce("values", F.lit(0)) - F.coalesce("only", F.lit(0))).cast("long").alias("pooled"))


@R.add("a13_masking_fan_out", """WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-02 00:00:00')) AS x, list(DISTINCT event_type) FILTER (WHERE ts >= TIMESTAMP '2024-01-02 00:00:00') AS y FROM events GROUP BY user_id),
    f AS (SELECT unnest(x) AS start, len(list_filter(y, lambda v: NOT list_contains(x, v))) AS fresh FROM s WHERE x IS NOT NULL AND y IS NOT NULL) SELECT start, count(*) AS n, CAST(sum(fresh) AS BIGINT) AS revealed FROM f GROUP BY start""")  # fmt: skip
def fan_out(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("ts") < "2024-01-02", F.col("event_type"))).alias("x"), F.collect_set(F.when(F.col("ts") >= "2024-01-02", F.col("event_type"))).alias("y"))
    f = s.filter("size(x) > 0 AND size(y) > 0").select(F.explode("x").alias("start"), F.size(F.array_except("y", "x")).alias("fresh"))
    return f.groupBy("start").agg(F.count("*").alias("n"), F.sum("fresh").alias("revealed"))


@R.add("a24_feature_success", "SELECT feature, count(*) AS n, count(*) FILTER (WHERE value > 50) AS hits, round((count(*) FILTER (WHERE value > 50) + 1) / CAST(count(*) + 5 AS DOUBLE), 9) AS prior FROM (SELECT value, unnest([event_type, 'k' || CAST(user_id % 5 AS VARCHAR)]) AS feature FROM events) x GROUP BY feature")
def feature_success(spark, sf_dir):
    f = table(spark, sf_dir, "events").select("value", F.explode(F.array("event_type", F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")))).alias("feature"))
    hits = F.count_if(F.col("value") > 50)
    return f.groupBy("feature").agg(F.count("*").alias("n"), hits.alias("hits"), F.round((hits + 1) / (F.count("*") + 5), 9).alias("prior"))


@R.add("a25_rule_mining", "WITH s AS (SELECT event_type || ':' || CAST(user_id % 10 AS VARCHAR) AS rule, event_type AS family, count(*) FILTER (WHERE value <= 30) AS noop, count(*) FILTER (WHERE value > 30) AS changed, count(DISTINCT user_id) AS functions FROM events GROUP BY 1, 2), f AS (SELECT family, sum(changed) / CAST(sum(changed) + sum(noop) AS DOUBLE) AS rate FROM s GROUP BY family) SELECT rule, noop, changed, functions, CASE WHEN rate > 0.3 THEN 'demoted' WHEN changed = 0 AND noop >= 5 AND functions >= 3 THEN 'equivalent' ELSE 'open' END AS class FROM s JOIN f USING (family)")
def rule_mining(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["a25_rule_mining"].replace("VARCHAR", "STRING"))


@R.add("a27_transition_mass", "WITH t AS (SELECT DISTINCT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events), w AS (SELECT user_id, a, b, 1.0 / count(*) OVER (PARTITION BY user_id) AS w FROM t WHERE a IS NOT NULL), s AS (SELECT count(DISTINCT user_id) AS support FROM w) SELECT a, b, round(sum(CAST(w AS DOUBLE)) / (max(support) + 1), 9) AS mass FROM w CROSS JOIN s GROUP BY a, b")
def transition_mass(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["a27_transition_mass"])


@R.add("a30_upper_median", "SELECT user_id, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median, list_sort(list(value))[CAST(floor(count(*) * 0.7) AS BIGINT) + 1] AS q70 FROM events GROUP BY user_id")
def upper_median(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return statistics.order_statistic(e, ["user_id"], "value", 0.5, "upper_median").join(statistics.order_statistic(e, ["user_id"], "value", 0.7, "q70"), "user_id")


# --- joins and sets by operators ---
@R.add("j11_row_diff", """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, round(o_totalprice, 0) AS p FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, round(o_totalprice, 0) + o_orderkey % 2 AS p FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' ELSE 'changed' END AS status, CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END) END AS fields
    FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p""")  # fmt: skip
def row_diff(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["j11_row_diff"])


@R.add("t3_three_way_status", "WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE value > 200), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error' AND value > 100) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' ELSE 'both' END AS status FROM a FULL OUTER JOIN b ON a.k = b.k")
def three_way(spark, sf_dir):
    return statement(spark, sf_dir, ORACLES["t3_three_way_status"])


@R.add("t4_panel_difference", "(SELECT c_custkey AS id, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)) UNION ALL (SELECT DISTINCT user_id, 'right' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def panel_difference(spark, sf_dir):
    c, e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return c.join(e, "id", "left_anti").select("id", F.lit("left").alias("side")).union(e.join(c.filter("c_acctbal > 0"), "id", "left_anti").withColumn("side", F.lit("right")))


@R.add("t6_union_with_conflicts", "WITH u AS (SELECT o_custkey AS id, o_orderstatus AS payload FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_custkey, 'F' FROM orders WHERE o_orderpriority = '5-LOW') SELECT id, CASE WHEN count(DISTINCT payload) = 1 THEN 'agreed' ELSE 'conflict' END AS status, count(*) AS n FROM u GROUP BY id")
def union_with_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    u = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("payload")).unionByName(o.filter("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("id"), F.lit("F").alias("payload")))
    return u.groupBy("id").agg(F.when(F.count_distinct("payload") == 1, "agreed").otherwise("conflict").alias("status"), F.count("*").alias("n"))


@R.add("p16_closed_mapping", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS label FROM orders")
def closed_mapping(spark, sf_dir):
    labels = F.create_map(*[F.lit(x) for x in ("P", "pending", "F", "final", "O", "open")])
    label = labels[F.col("o_orderstatus")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(label.isNull(), F.raise_error(F.concat(F.lit("no label for "), "o_orderstatus")).cast("string")).otherwise(label).alias("label"))


# --- facts with scoped identity ---
_FACTS = """SELECT CASE WHEN l_partkey % 2 = 0 THEN 'global:' || CAST(l_partkey AS {s}) ELSE 'param' || CAST(l_partkey % 4 AS {s}) END AS base, CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_suppkey END AS func, l_linenumber * 4 AS off,
    CAST(l_quantity / 10 AS INT) + 1 AS width, l_returnflag AS class, l_linestatus AS sign, l_orderkey * 10 + l_linenumber AS id FROM lineitem""".replace("CAST(l_quantity / 10 AS INT)", "CAST(floor(l_quantity / 10) AS INT)")  # fmt: skip


@R.add("d1_contradictions", f"""WITH f AS ({_FACTS.format(s='VARCHAR')}), g AS (SELECT base, func, off, count(*) AS n, count(DISTINCT width) AS w, count(DISTINCT class) AS c, count(DISTINCT sign) AS s FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 2)
    SELECT base, func, off, 'width' AS kind FROM g WHERE w > 1 UNION ALL SELECT base, func, off, 'class' FROM g WHERE c > 1 UNION ALL SELECT base, func, off, 'note:signedness' FROM g WHERE s > 1""")  # fmt: skip
def contradictions(spark, sf_dir):
    """One pass over the facts; global bases are one place for all functions, others one for each function."""
    f = statement(spark, sf_dir, _FACTS.format(s="STRING"))
    g = f.groupBy("base", "func", "off").agg(F.count("*").alias("n"), F.count_distinct("width").alias("w"), F.count_distinct("class").alias("c"), F.count_distinct("sign").alias("s")).filter("n >= 2")
    kinds = F.filter(F.array(F.when(F.col("w") > 1, "width"), F.when(F.col("c") > 1, "class"), F.when(F.col("s") > 1, "note:signedness")), lambda x: x.isNotNull())
    return g.select("base", "func", "off", F.explode(kinds).alias("kind"))


@R.add("d2_sweep", f"""WITH f AS (SELECT * FROM ({_FACTS.format(s='VARCHAR')}) y WHERE base LIKE 'global:%'), p AS (SELECT base, off, max(width) AS span, count(DISTINCT class) AS c FROM f GROUP BY base, off),
    n AS (SELECT *, lead(off) OVER (PARTITION BY base ORDER BY off) AS nxt FROM p) SELECT base, off, CASE WHEN c > 1 THEN 'class' ELSE 'overlap' END AS kind FROM n WHERE c > 1 OR nxt < off + span""")  # fmt: skip
def sweep(spark, sf_dir):
    from factloom.operators.intervals import overlaps_next

    f = statement(spark, sf_dir, _FACTS.format(s="STRING")).filter(F.col("base").startswith("global:"))
    p = f.groupBy("base", "off").agg(F.max("width").alias("span"), F.count_distinct("class").alias("c")).withColumn("end", F.col("off") + F.col("span"))
    over = overlaps_next(p, ["base"], "off", "end", "off").select("base", "off", F.lit("overlap").alias("kind"))
    hard = p.filter("c > 1").select("base", "off", F.lit("class").alias("kind"))
    return hard.unionByName(over.join(hard, ["base", "off"], "left_anti"))
