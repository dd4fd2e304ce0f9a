"""The queries of this subpackage, and SQL for those that SQL can express.

The others have none: op1, op5 and op6 fit models, op2, op7 and op10 need a tokenizer, op4 needs sketches. The
tests hold them against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, hard_negatives, lang_id, minmax_dedup, mixing, order_minhash, prefix_counts, pseudo_likelihood, quality, sstable, warc, winnowing, word_bpe
from .common import table

#: Fixed by the contract of op3.
OP3_SHINGLE, OP3_THRESHOLD = 3, 85
#: Fixed by the contracts of op11 and op13.
OP11_WINDOW, OP13_WRONG, OP13_ANCHORS = 10, 7, 50


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(table(spark, sf_dir, "documents")))


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), OP3_SHINGLE, OP3_THRESHOLD)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihoods(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages")))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), OP11_WINDOW)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of some rows are wrong on purpose, by the contract."""
    label = F.when(F.col("vec_id") % OP13_WRONG == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % OP13_ANCHORS == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OPS = (op1_language_id, op2_token_shards, op3_minmax_dedup, op4_order_minhash, op5_quality_rules, op6_pseudo_likelihood, op7_token_counts, op8_warc_bundles, op9_source_mix, op10_word_bpe, op11_decontamination, op12_fill_in_middle, op13_hard_negatives, pipeline)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPS}

_OP3 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {OP3_SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= {OP3_THRESHOLD} * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, v FROM reach JOIN both_ways ON r = u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

_OP9 = """
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    coalesce(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text)), 1, 7))::BIGINT, 0) AS place
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.5 ELSE 0 END::DOUBLE AS a
  FROM s GROUP BY source),
fill(step, capped, rest, weights) AS (
  SELECT 0, CAST([] AS VARCHAR[]), (SELECT sum(source_size) FROM per)::BIGINT, (SELECT sum(weight) FROM per WHERE source_size > 0)::BIGINT
  UNION ALL
  SELECT step + 1, list_concat(capped, x.names), (rest - x.size)::BIGINT, (weights - x.weight)::BIGINT
  FROM fill, LATERAL (
    SELECT list(coalesce('s' || source, 'null')) AS names, sum(3 * source_size)::BIGINT AS size, sum(weight)::BIGINT AS weight
    FROM per WHERE source_size > 0 AND NOT list_contains(fill.capped, coalesce('s' || source, 'null')) AND fill.rest * per.weight > 3 * source_size * fill.weights) x
  WHERE x.size IS NOT NULL),
settled AS (SELECT * FROM fill ORDER BY step DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN list_contains(capped, coalesce('s' || source, 'null')) THEN (3 * source_size)::DOUBLE
    ELSE (rest * weight)::DOUBLE / weights END AS target, a
  FROM per, settled),
r AS (
  SELECT doc_id, size, source_size, target, a, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole,
    sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (size * whole + greatest(0, least(size, round_even(target - whole * source_size, 0)::BIGINT - before)))::BIGINT AS taken, least(1.0, before / target) AS share FROM r)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(2 * share / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * share)), 9) END AS position
FROM k
"""

_OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
owned AS (SELECT DISTINCT item_id, least({OP11_WINDOW}, len(w)) AS n, unnest(list_transform(range(1, len(w) - least({OP11_WINDOW}, len(w)) + 2), lambda i: array_to_string(w[i:i + least({OP11_WINDOW}, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM owned),
placed AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM placed) p JOIN owned o ON p.g = o.g AND p.n = o.n),
spots AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP12 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('{fill_in_middle.SEED}:' || doc_id) AS h FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM t),
p AS (SELECT doc_id, text, n, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= {fill_in_middle.FIM_PERCENT} THEN 'plain' WHEN d < {fill_in_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

_OP13 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {OP13_WRONG} = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {OP13_ANCHORS} = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {hard_negatives.POSITIVES}),
n AS (SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN {hard_negatives.LOW} * positive_score AND {hard_negatives.HIGH} * positive_score)
SELECT * FROM n WHERE rank <= {hard_negatives.NEGATIVES}
"""

ORACLE_SQL: dict[str, str] = {"op3_minmax_dedup": _OP3, "op8_warc_bundles": _OP8, "op9_source_mix": _OP9, "op11_decontamination": _OP11, "op12_fill_in_middle": _OP12, "op13_hard_negatives": _OP13}
