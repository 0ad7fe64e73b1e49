"""The registered queries of this subpackage, and their SQL."""

import corpus_pipeline
from pyspark.sql import functions as F

from .align import alignment_digest
from .bm25 import top_documents
from .chat import preference_pairs
from .common import table
from .decontam import contamination
from .divergence import divergence_audit
from .license import license_scan
from .lm import lm_scores
from .mix import mix_sizes
from .pii import pii_digest
from .quality import quality_scores
from .shard import shard_documents
from .simhash import simhash_documents
from .tokens import token_histogram


def op1_mix_sources(spark, sf_dir):
    return mix_sizes(table(spark, sf_dir, "documents"))


def op2_preference_pairs(spark, sf_dir):
    """Every conversation against itself with its last assistant turn taken from the conversation of the next id (empty, if there is none)."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    swapped = (F.col("role") == "assistant") & F.struct("turn", "text").eqNullSafe(F.col("last"))
    both = turns.join(last, "conv_id", "left").join(other, "conv_id", "left").select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_rejected"))
    both = both.withColumn("text", F.when(F.col("is_rejected") & F.coalesce(swapped, F.lit(False)), F.col("other")).otherwise(F.col("text")))
    got = preference_pairs(both, F.col("conv_id"), F.col("is_rejected"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["first"], F.lit("-"), s["last"])), ",").alias(c)
    return got.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", text("chosen_spans"), text("rejected_spans"), "differs")


def op3_lm_scores(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op4_winnow_benchmark(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_index(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_simhash_tiles(spark, sf_dir):
    return simhash_documents(table(spark, sf_dir, "documents"))


def op7_quality_nbsvm(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_feistel_shards(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_token_histogram(spark, sf_dir):
    return token_histogram(table(spark, sf_dir, "documents"))


def op10_bm25_wand(spark, sf_dir):
    """Queries: the documents whose id is divisible by 20, whole."""
    return top_documents(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0).drop("query_row")


def op11_source_divergence(spark, sf_dir):
    return divergence_audit(table(spark, sf_dir, "documents"))


def op12_personal_data(spark, sf_dir):
    return pii_digest(table(spark, sf_dir, "documents"))


def op13_align_tokenizers(spark, sf_dir):
    return alignment_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (
        op1_mix_sources, op2_preference_pairs, op3_lm_scores, op4_winnow_benchmark, op5_license_index, op6_simhash_tiles, op7_quality_nbsvm, op8_feistel_shards, op9_token_histogram,
        op10_bm25_wand, op11_source_divergence, op12_personal_data,
        op13_align_tokenizers,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15)) AS BIGINT) AS position
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
v AS (SELECT *, CAST(CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM w),
f AS (SELECT *, cap / weight AS full_at FROM v),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM f)::DOUBLE - (sum(cap) OVER upto - cap))
            / ((SELECT sum(weight) FROM f) - sum(weight) OVER upto + weight) AS level
  FROM f WINDOW upto AS (ORDER BY full_at, nth ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, (SELECT arg_min(level, (full_at, nth)) FROM l WHERE level <= full_at) * weight) AS target FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM k),
p AS (SELECT source, position, sum(size) AS size, count(*) AS n FROM d GROUP BY source, position),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY position ROWS UNBOUNDED PRECEDING) AS upto FROM p),
e AS (
  SELECT b.source, min(c.position) AS at, arg_min(ceil((b.budget - (c.upto - c.size)::DOUBLE) / (c.size::DOUBLE / c.n) - 0.5), c.position) AS wanted
  FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source WHERE b.budget > 0 AND c.upto > b.budget GROUP BY b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source, position) AS nth FROM d),
x AS (
  SELECT r.doc_id, r.size, b.source_size, b.target,
         b.whole + CASE WHEN r.position < e.at OR r.position = e.at AND r.nth <= e.wanted THEN 1 ELSE 0 END AS copies
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM x
""",
    "op4_winnow_benchmark": r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dg AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
m AS (SELECT dg.rid, dg.i, dg.n, ig.item_id FROM dg JOIN ig ON dg.n = ig.n AND dg.gram = ig.gram),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS df FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n_lang FROM c GROUP BY ALL HAVING sum(df) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS lang_total FROM k GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(any_value(v), 0)::HUGEINT AS v, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) USING (lang, source) LEFT JOIN l USING (lang) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p,
         1 + 1000000000::HUGEINT * (k.n_lang + 1) // (l.lang_total + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
""",
    "op2_preference_pairs": r"""
WITH l AS (
  SELECT conv_id, turn, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS nth FROM conversations WHERE conv_id IS NOT NULL AND role = 'assistant')
  WHERE nth = 1),
b AS (
  SELECT conv_id, 0 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c.conv_id, 1, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn IS NOT DISTINCT FROM l.turn AND c.text IS NOT DISTINCT FROM l.text AND l.conv_id IS NOT NULL THEN o.text ELSE c.text END
  FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id LEFT JOIN l o ON c.conv_id = o.conv_id - 1 WHERE c.conv_id IS NOT NULL),
t AS (
  SELECT conv_id AS pair_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM b),
n AS (
  SELECT pair_id, max(CASE WHEN side = 0 THEN nth ELSE 0 END) AS cs, max(CASE WHEN side = 1 THEN nth ELSE 0 END) AS rs FROM t GROUP BY pair_id),
d AS (
  SELECT a.pair_id, min(a.nth) AS first_other FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.nth = b.nth AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
k AS (SELECT n.*, CAST(coalesce(first_other - 1, least(cs, rs)) AS BIGINT) AS n_prefix FROM n LEFT JOIN d USING (pair_id)),
r AS (
  SELECT t.*, k.n_prefix, nth > n_prefix AS own, concat('<|', role, '|>', chr(10), text, '<|end|>', chr(10)) AS line, length(role) + 5 AS head
  FROM t JOIN k USING (pair_id)),
s AS (
  SELECT *, sum(CASE WHEN own THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY nth ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT pair_id, any_value(n_prefix) AS n_prefix,
       coalesce(string_agg(line, '' ORDER BY nth) FILTER (WHERE NOT own AND side = 0), '') AS prompt,
       CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(line, '' ORDER BY nth) FILTER (WHERE own AND side = 0), '') END AS chosen,
       CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(line, '' ORDER BY nth) FILTER (WHERE own AND side = 1), '') END AS rejected,
       CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(concat(CAST(upto - length(line) + head AS BIGINT), '-', CAST(upto AS BIGINT)), ',' ORDER BY nth) FILTER (WHERE own AND side = 0 AND role = 'assistant'), '') END AS chosen_spans,
       CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(concat(CAST(upto - length(line) + head AS BIGINT), '-', CAST(upto AS BIGINT)), ',' ORDER BY nth) FILTER (WHERE own AND side = 1 AND role = 'assistant'), '') END AS rejected_spans,
       coalesce(chosen <> rejected, false) AS differs
FROM s GROUP BY pair_id
""",
}
