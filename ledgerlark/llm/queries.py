"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .features import fold


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, listed

    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_examples

    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return digests(format_examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    out = assign_shards(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    held = fold(F.col("doc_id"), 4) == 2
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_components

    return similarity_components(table(spark, sf_dir, "documents"))


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_copies

    mixed = mix_copies(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def op7_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import backoff_scores

    return backoff_scores(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_matches

    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, toxicity_scores

    held = fold(F.col("doc_id"), 3) == 1
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_spans

    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed")
    return out.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened_vectors

    rows = whitened_vectors(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", "explained", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("k")].alias("explained"), "identity_error")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_boosting,
        op2_prefix_targets,
        op3_hilbert_sharding,
        op4_quality_nbsvm,
        op5_ngram_jaccard,
        op6_entropy_mixing,
        op7_embedding_pq,
        op8_stupid_backoff,
        op9_decontamination,
        op10_toxicity_ftrl,
        op11_bucket_pointer_dedup,
        op12_source_divergence,
        op13_embedding_whitening,
        pipeline,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

ORACLE: dict[str, str] = {
    "op2_prefix_targets": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length('<|im_start|>') + length(replace({_ESCAPED.format("role")}, chr(10), '&#10;')) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) OVER o AS upto
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id""",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)""",
    "op7_embedding_pq": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(u, v) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.u, l.b FROM reach r JOIN links l ON l.a = r.v),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op8_stupid_backoff": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
t AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w),
g AS (SELECT *, lag(w, 1) OVER o AS p1, lag(w, 2) OVER o AS p2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT p1, w, count(*) AS c FROM g WHERE p1 IS NOT NULL GROUP BY p1, w),
c3 AS (SELECT p2, p1, w, count(*) AS c FROM g WHERE p2 IS NOT NULL GROUP BY p2, p1, w),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT g.doc_id, CASE
    WHEN c3.c >= 2 THEN ln(c3.c / x2.c)
    WHEN c2.c >= 2 THEN ln(c2.c / x1.c) + ln(0.4) * (least(g.i, 3) - 2)
    ELSE ln(c1.c / n) + ln(0.4) * (least(g.i, 3) - 1) END AS l
  FROM g CROSS JOIN total JOIN c1 ON c1.w = g.w LEFT JOIN c1 x1 ON x1.w = g.p1 LEFT JOIN c2 ON c2.p1 = g.p1 AND c2.w = g.w
  LEFT JOIN c2 x2 ON x2.p1 = g.p2 AND x2.w = g.p1 LEFT JOIN c3 ON c3.p2 = g.p2 AND c3.p1 = g.p1 AND c3.w = g.w),
d AS (SELECT doc_id, count(*) AS n_words, CAST(sum(CAST(round(l * 1e6) AS BIGINT)) AS BIGINT) AS log_micros FROM s GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, log_micros, log_micros / n_words / 1e6 AS score
FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id""",
    "op11_bucket_pointer_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, unnest(range(0, len(h) // 2 - 49, 256)) AS b, h FROM d),
b AS (SELECT r, doc_id, b, substring(h, 2 * b + 1, 610) AS h FROM c),
g AS (SELECT r, doc_id, b, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM b),
w AS (SELECT r, doc_id, b + i AS i, substring(h, 2 * i + 1, 100) AS s FROM g),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.r, w.i, coalesce(w.i - lag(w.i) OVER (PARTITION BY w.r ORDER BY w.i) > 50, true) AS new
  FROM w JOIN m USING (s) WHERE m.least < coalesce(w.doc_id, 9223372036854775807)),
run AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS lo, max(i) + 50 AS hi FROM run GROUP BY r, k),
piece AS (SELECT r, k, hi, hi - lo AS n, substring(h, 2 * coalesce(lag(hi) OVER o, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER o, 0))) AS p
  FROM span JOIN d USING (r) WINDOW o AS (PARTITION BY r ORDER BY k)),
kept AS (SELECT r, sum(n) AS n_removed, count(*) AS n_spans, max(hi) AS hi, string_agg(p, '' ORDER BY k) AS p FROM piece GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(p, '') || substring(h, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term FROM d GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM d JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)::HUGEINT) // (coalesce(n, 0) + v) AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000 * (sum(c) + 1)::HUGEINT) // ((SELECT sum(n) FROM n WHERE n.lang = p.lang) + any_value(v)) AS q
  FROM p JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM out)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
