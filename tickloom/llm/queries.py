"""One query for each operator over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (ann_tree, arc_warc, conversation_trie, importance, jaccard_join, license_scan, lm_score, mixing, pii, quality_ledger, sentencepiece_codec,
                          simhash, url_filter)
from tickloom.llm.shared import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str = sentencepiece_codec.DEFAULT_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_codec.round_trip(docs, sentencepiece_codec.model_bytes(model))
    return both.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.xxhash64("decoded").alias("decoded_hash"), "same")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(list(license_scan.TEMPLATES.items()), "license string, text string")
    found = license_scan.scan(table(spark, sf_dir, "documents"), templates)
    return found.select(F.col("key").alias("doc_id"), "license", F.round("containment", 6).alias("containment"))


_NOTICES = ",\n  ".join("({!r}, '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())
OP3_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES
  {_NOTICES}) x(license, text)),
tw AS (SELECT license, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM t),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tm AS (SELECT license, count(*) AS m, CASE WHEN count(*) >= 32 THEN 64 ELSE pow(2, ceil(log2(count(*))))::INT END AS s FROM ts GROUP BY license),
d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT k, doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hits AS (SELECT k, doc_id, pos, ts.license, ts.sh, m, s FROM ds JOIN ts USING (sh) JOIN tm USING (license)),
placed AS (
  SELECT *, CASE WHEN m > 64 THEN -1 ELSE pos // s END AS win FROM hits
  UNION ALL SELECT *, pos // s - 1 AS win FROM hits WHERE m <= 64 AND pos // s > 0 AND pos % s <> s - 1),
held AS (SELECT k, doc_id, license, win, count(DISTINCT sh) / any_value(m) AS share FROM placed GROUP BY k, doc_id, license, win)
SELECT doc_id, license, round(max(share), 6) AS containment FROM held WHERE share >= 0.8 GROUP BY doc_id, license
"""


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scored(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"),
                      F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"), F.col("seen").alias("n_seen"))


OP4_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS MATERIALIZED (
  SELECT k, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u
  FROM (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM t) WINDOW o AS (PARTITION BY k ORDER BY i)),
total AS (SELECT count(*) AS n FROM w),
size AS (SELECT k, count(*) AS n FROM w GROUP BY k),
c1 AS MATERIALIZED (SELECT k, w, sum(count(*)) OVER (PARTITION BY w) - count(*) AS c FROM w GROUP BY k, w),
c2 AS MATERIALIZED (SELECT k, v, w, sum(count(*)) OVER (PARTITION BY v, w) - count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY k, v, w),
c3 AS MATERIALIZED (SELECT k, u, v, w, sum(count(*)) OVER (PARTITION BY u, v, w) - count(*) AS c FROM w WHERE u IS NOT NULL GROUP BY k, u, v, w),
s AS (
  SELECT w.k, coalesce(c3.c, 0) > 0 AS seen,
    CASE WHEN coalesce(c3.c, 0) > 0 THEN ln(c3.c) - ln(uv.c)
         WHEN coalesce(vw.c, 0) > 0 THEN CASE WHEN w.i > 2 THEN ln(0.4) ELSE 0 END + ln(vw.c) - ln(v1.c)
         ELSE least(w.i - 1, 2) * ln(0.4) + CASE WHEN w1.c > 0 THEN ln(w1.c) ELSE ln(0.4) END - ln(greatest(total.n - size.n, 1)) END AS s
  FROM w JOIN size USING (k) JOIN c1 w1 ON w1.k = w.k AND w1.w = w.w LEFT JOIN c1 v1 ON v1.k = w.k AND v1.w = w.v
  LEFT JOIN c2 vw ON vw.k = w.k AND vw.v = w.v AND vw.w = w.w LEFT JOIN c2 uv ON uv.k = w.k AND uv.v = w.u AND uv.w = w.v
  LEFT JOIN c3 ON c3.k = w.k AND c3.u = w.u AND c3.v = w.v AND c3.w = w.w, total),
d AS (SELECT k, sum(s) AS s, count(*) FILTER (seen) AS seen FROM s GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, round(s, 4) AS log_score, round(s / len(words), 6) AS mean_log_score, coalesce(seen, 0)::BIGINT AS n_seen
FROM t LEFT JOIN d USING (k)
"""


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann_tree.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, keep_text=False)
    shares = [F.round(F.get("posterior", k), 6).alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return out.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_ledger.apply_policy(quality_ledger.ledger(docs), "base", "passes_base")
    judged = quality_ledger.apply_policy(judged, "v1")
    return judged.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT passes_base AS base_failed", "kept", "failed")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT k, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (
  SELECT k, i, array_to_string(words[i:i + 4], ' ') AS win
  FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY k),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (k)),
f AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (10 * word_chars < 25 * n_words)::INT
    + 32 * (word_chars > 15 * n_words)::INT)::INT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 7) = 0 AS kept, failed
FROM f
"""

def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.labelled_urls(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("spans").alias("found"))
    counts = [F.expr(f"size(filter(found, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    weak = F.filter("found", lambda s: s["score"] < pii.THRESHOLD)
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"),
                        F.size(weak).cast("long").alias("n_low_score"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = arc_warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP11_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT k, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.k AS a, y.k AS b, count(*) AS m FROM s x JOIN s y USING (shingle) GROUP BY x.k, y.k) p
  JOIN n na ON na.k = p.a JOIN n nb ON nb.k = p.b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_id, doc_id) AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN (SELECT r.a AS k, min(o.doc_id) AS least_id FROM reach r JOIN d o ON o.k = r.b GROUP BY r.a) USING (k)
"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 from its polynomial: a table of 256 states, then a fold over the bytes of each distinct word.
OP12_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
texts AS (
  SELECT row_number() OVER () AS k, doc_id, text, 1 AS raw FROM documents UNION ALL SELECT NULL, NULL, text, 0 FROM benchmark),
split AS MATERIALIZED (
  SELECT k, doc_id, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
each AS MATERIALIZED (SELECT k, raw, word, count(*) AS n FROM (SELECT k, raw, unnest(words) AS word FROM split) GROUP BY ALL),
bytes AS (
  SELECT word, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM each)),
bucket AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
held AS (SELECT bucket, sum(n * raw) AS s, sum(n * (1 - raw)) AS t FROM each JOIN bucket USING (word) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM held),
gain AS (
  SELECT bucket, floor(1000 * ln(((h.t + 1)::DOUBLE * (w.s + 10000)::DOUBLE) / ((h.s + 1)::DOUBLE * (w.t + 10000)::DOUBLE))) AS gain FROM held h, whole w),
mean AS (SELECT k, floor(sum(n * gain) / sum(n)) AS weight FROM each JOIN bucket USING (word) JOIN gain USING (bucket) WHERE raw = 1 GROUP BY k),
scored AS (
  SELECT k, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM split LEFT JOIN mean USING (k) WHERE raw = 1),
drawn AS (
  SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END::BIGINT AS rank FROM scored LEFT JOIN drawn USING (k)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_simhash": op2_simhash, "op3_license_scan": op3_license_scan, "op4_lm_score": op4_lm_score, "op5_nearest": op5_nearest, "op6_mixing": op6_mixing, "op7_quality_rules": op7_quality_rules, "op8_url_filter": op8_url_filter, "op9_pii": op9_pii, "op10_warc": op10_warc,
           "op11_jaccard_join": op11_jaccard_join, "op12_importance": op12_importance, "op13_prefix_trie": op13_prefix_trie}
SQL = {"op3_license_scan": OP3_SQL, "op4_lm_score": OP4_SQL, "op7_quality_rules": OP7_SQL, "op11_jaccard_join": OP11_SQL, "op12_importance": OP12_SQL}
