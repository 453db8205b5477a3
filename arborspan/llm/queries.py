"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, line_align, minhash, mixture, quality, secret_spans, token_counts, toxicity, vector_join

#: The query's score thresholds and label folds.
TOXIC_FOLDS, TOXIC_HELD, QUALITY_FOLDS, QUALITY_HELD = 3, 1, 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op1_html_main_text(spark, sf_dir):
    out = html_text.extract_main_text(table(spark, sf_dir, "pages"), keep=("url",))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_weighted_fair_mix(spark, sf_dir):
    return mixture.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _held(scored, folds, held):
    return scored.select("doc_id", (fold(folds) == held).alias("held_out"), "score", "predicted")


def op4_nnpu_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), fold(TOXIC_FOLDS) != TOXIC_HELD)
    return _held(toxicity.score_toxicity(docs, model), TOXIC_FOLDS, TOXIC_HELD)


def op5_token_efficiency_secrets(spark, sf_dir):
    spans = secret_spans.scan_secrets(table(spark, sf_dir, "documents"))
    written = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return spans.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", written), ",").alias("spans"),
    )


def op6_pivot_range_join(spark, sf_dir):
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_bradley_terry_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), fold(QUALITY_FOLDS) != QUALITY_HELD)
    return _held(quality.score_quality(docs, model), QUALITY_FOLDS, QUALITY_HELD)


def op8_prefix_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_patience_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_align.remove_duplicate_lines(docs).select("doc_id", "lines_cut", "words_cut", "text")


def op10_automaton_decontamination(spark, sf_dir):
    found = decontaminate.find_benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.coalesce((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")), F.lit(False)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_main_text, op2_minhash_near_dedup, op3_weighted_fair_mix, op4_nnpu_toxicity, op5_token_efficiency_secrets, op6_pivot_range_join,
        op7_bradley_terry_quality, op8_prefix_token_counts, op9_patience_line_dedup, op10_automaton_decontamination,
    )
}

_MIX_SQL = """
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM rows GROUP BY source),
caps AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3 AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS rnk,
    ((SELECT sum(source_size) FROM caps)::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM caps WINDOW o AS (ORDER BY cap::DOUBLE / w, k)),
rest AS (SELECT rnk, lvl FROM levels WHERE cap > lvl * w ORDER BY rnk LIMIT 1),
targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN r.rnk IS NULL OR l.rnk < r.rnk THEN l.cap::DOUBLE ELSE r.lvl * l.w END AS target
  FROM levels l LEFT JOIN rest r ON true),
queued AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.turn) - r.size AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(greatest(floor(target) - start, 0), size) + least(greatest(floor(target) - start - source_size, 0), size)
    + least(greatest(floor(target) - start - 2 * source_size, 0), size))::BIGINT AS taken
FROM queued
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Least member of each component of ``links (a, b)`` over ``nodes (id)``.
_REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, label) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.id),
parts AS (SELECT id, min(label) AS label FROM reach GROUP BY id)"""

_NEAR_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),{_REACH}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(p.label, d.doc_id) AS component_id, coalesce(p.label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN parts p ON p.id = d.doc_id"""

_VECTOR_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),{_REACH},
degrees AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(p.label, e.vec_id)::BIGINT AS component_id, coalesce(p.label, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN parts p ON p.id = e.vec_id LEFT JOIN degrees d ON d.id = e.vec_id"""

_WINDOW_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM words, lengths WHERE len(w) >= k),
found AS (SELECT doc_id, k, i, item FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM grams) JOIN windows USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.list, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hits h USING (doc_id) LEFT JOIN held t USING (doc_id)"""

ORACLE_SQL = {
    "op2_minhash_near_dedup": _NEAR_SQL, "op3_weighted_fair_mix": _MIX_SQL, "op6_pivot_range_join": _VECTOR_SQL, "op10_automaton_decontamination": _WINDOW_SQL,
}
