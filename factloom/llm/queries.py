"""The registered queries of the operators and their DuckDB SQL, where SQL can express one."""

from __future__ import annotations

import public_tokenizers

from factloom.llm import bpe, language_model, mixing, pages, periodic, quality, repeats, resampling, shards, simhash, token_files, topk, warc
from factloom.llm.shared import documents

#: The vocabulary of the queries; every operator takes its path as a parameter.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_top_k(spark, sf_dir):
    vectors = topk.finite_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip_digests(documents(spark, sf_dir), WORD_BPE)


def op3_minimax_shards(spark, sf_dir):
    return shards.shard_documents(documents(spark, sf_dir), 24)


def op4_rans_token_files(spark, sf_dir):
    return token_files.token_file_digests(documents(spark, sf_dir), WORD_BPE, end_id=2)


def op5_quality_divergence(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.judged(docs, carried=["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rules in plain SQL: words and classes are counted as rows, medians and sums taken by language.
OP5_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) x WHERE c > 1) y GROUP BY rid),
b AS (
  SELECT d.rid, doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN r ON r.rid = d.rid),
k AS (SELECT rid, CAST(unnest([1, 2, 3, 4, 5, 6]) AS INT) AS pos, unnest(['[a-z]', '[ \t-\r]', '[A-Z]', '[.,;:!?''"()-]', '[0-9]', '[#*$%&|<>]']) AS class, t FROM b),
c AS (SELECT rid, pos, CAST(length(t) - length(regexp_replace(t, class || '+', '', 'g')) AS BIGINT) AS n FROM k),
cls AS (SELECT rid, pos, n FROM c UNION ALL SELECT b.rid, 7, length(any_value(t)) - sum(n) FROM c JOIN b ON b.rid = c.rid GROUP BY b.rid),
big AS (SELECT lang FROM b GROUP BY lang HAVING count(*) >= 50),
each AS (SELECT rid, lang, unnest(w) AS word FROM b WHERE lang IN (SELECT lang FROM big)),
seen AS (SELECT lang, word, count(DISTINCT rid) AS n FROM each WHERE regexp_full_match(word, '\p{L}+') GROUP BY lang, word),
common AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS pos FROM seen QUALIFY pos <= 32),
hit AS (SELECT e.rid, coalesce(m.pos, 33) AS pos, count(*) AS n FROM each e LEFT JOIN common m ON m.lang = e.lang AND m.word = e.word GROUP BY 1, 2),
wrd AS (SELECT b.rid, p.pos, coalesce(hit.n, 0) AS n FROM b JOIN big ON big.lang = b.lang CROSS JOIN (SELECT unnest(range(1, 34)) AS pos) p LEFT JOIN hit ON hit.rid = b.rid AND hit.pos = p.pos),
good AS (SELECT b.rid, b.lang, length(t) AS chars, n_words FROM b JOIN big ON big.lang = b.lang WHERE NOT base_failed),
cref AS (SELECT lang, pos, list_sort(list(s))[(count(*) + 1) // 2] AS ref FROM (SELECT good.lang, pos, 1000 * n // chars AS s FROM good JOIN cls ON cls.rid = good.rid) x GROUP BY lang, pos),
wref AS (SELECT lang, pos, sum(1000000 * n // n_words) AS ref FROM good JOIN wrd ON wrd.rid = good.rid GROUP BY lang, pos),
pair AS (
  SELECT 'c' AS kind, b.rid, n / CAST(sum(n) OVER v AS DOUBLE) AS a, ref / CAST(sum(ref) OVER v AS DOUBLE) AS q FROM b JOIN cls ON cls.rid = b.rid JOIN cref ON cref.lang = b.lang AND cref.pos = cls.pos WHERE length(t) >= 200 WINDOW v AS (PARTITION BY b.rid)
  UNION ALL
  SELECT 'w', b.rid, n / CAST(sum(n) OVER v AS DOUBLE), ref / CAST(sum(ref) OVER v AS DOUBLE) FROM b JOIN wrd ON wrd.rid = b.rid JOIN wref ON wref.lang = b.lang AND wref.pos = wrd.pos WHERE n_words >= 50 WINDOW v AS (PARTITION BY b.rid)),
far AS (
  SELECT rid FROM (SELECT kind, rid, sqrt(abs(sum((CASE WHEN a > 0 THEN a * log2(2 * a / (a + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (a + q)) ELSE 0 END) / 2))) AS dist FROM pair GROUP BY kind, rid) x
  WHERE dist > CASE kind WHEN 'c' THEN 0.18 ELSE 0.42 END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM far) AS kept FROM b
"""


def op6_prefix_free_repeats(spark, sf_dir):
    # the contract's strings of 400 bytes, and behind them passages of 50 words, most of which are shorter
    return repeats.removals(documents(spark, sf_dir), 400, passages=200, least_words=50, texts=False)


def op7_gru_score(spark, sf_dir):
    return language_model.score_documents(documents(spark, sf_dir))


def op8_text_density(spark, sf_dir):
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_entropy_mix(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mixed(docs).select("row.doc_id", "size", "source_size", "target", "taken")


def op11_grammar_runs(spark, sf_dir):
    return periodic.run_digests(periodic.periodic_runs(documents(spark, sf_dir), periodic.repeated_tails, carried=["doc_id"]))


def op12_warc_archives(spark, sf_dir):
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS place, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 OR payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 AND payload_bytes >= 100 THEN least END AS refers_to FROM o
"""


def op13_target_resampling(spark, sf_dir):
    docs, target = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resampled(docs, target, carried=["doc_id"]).select("row.doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its table, a byte at a time, of distinct words.
OP13_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT 0 AS target, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
each AS (SELECT target, rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM each) x),
bytes AS (SELECT w, list_transform(range(1, length(h), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT)) AS b FROM hexed),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 10000 AS k FROM bytes, tab),
seen AS (SELECT target, rid, k, count(*) AS n FROM each JOIN bucket USING (w) GROUP BY ALL),
per AS (SELECT k, sum(n) FILTER (target = 0) AS s, sum(n) FILTER (target = 1) AS t FROM seen GROUP BY k),
size AS (SELECT coalesce(sum(s), 0) AS a, coalesce(sum(t), 0) AS b FROM per),
gain AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (a + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (b + 10000)::DOUBLE))) AS BIGINT) AS g FROM per, size),
weighed AS (SELECT rid, sum(n) AS n_features, sum(n * g) AS weight FROM seen JOIN gain USING (k) WHERE target = 0 GROUP BY rid),
scored AS (
  SELECT d.rid, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts d LEFT JOIN weighed w ON w.rid = d.rid WHERE target = 0),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (rid)
"""


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_minimax_shards": op3_minimax_shards,
    "op4_rans_token_files": op4_rans_token_files,
    "op5_quality_divergence": op5_quality_divergence,
    "op6_prefix_free_repeats": op6_prefix_free_repeats,
    "op7_gru_score": op7_gru_score,
    "op8_text_density": op8_text_density,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_grammar_runs": op11_grammar_runs,
    "op12_warc_archives": op12_warc_archives,
    "op13_target_resampling": op13_target_resampling,
}
ORACLES: dict[str, str] = {"op1_exact_top_k": OP1_SQL, "op5_quality_divergence": OP5_SQL, "op12_warc_archives": OP12_SQL, "op13_target_resampling": OP13_SQL}
