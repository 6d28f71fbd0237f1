"""One query per operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import functions as F

from dossier.llm import bpe, centroids, decontamination, filter_audit, language_model, license_scan, line_dedup, near_dedup, pii, secret_scan, topk, toxicity, warc
from dossier.llm.registry import QUERIES, SQL, query
from dossier.session import shared_dir

__all__ = ["QUERIES", "SQL"]

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS g, least(10, len(w)) AS size
  FROM i, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(s) WHERE len(w) > 0),
dw AS (SELECT k, s, size, array_to_string(w[s : s + size - 1], ' ') AS g
  FROM d, (SELECT DISTINCT size FROM iw), unnest(generate_series(1, len(w) - size + 1)) AS t(s) WHERE len(w) >= size),
h AS (SELECT k, s, dw.size, item_id FROM dw JOIN iw USING (g)),
p AS (SELECT k, count(DISTINCT s + o) AS n_hit FROM h, unnest(generate_series(0, size - 1)) AS t(o) GROUP BY k),
n AS (SELECT k, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT k, item_id::VARCHAR AS item_id FROM h) GROUP BY k)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN n USING (k)
"""
OP6_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.n, c.n), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.n) = len(c.n) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
x AS (SELECT k, doc_id, len(s) AS n, unnest(s) AS h FROM g),
l AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.h = b.h AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT k AS a, k AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS k, min(g.doc_id) AS component_id FROM r JOIN g ON g.k = r.b GROUP BY r.a)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN c USING (k)
"""
OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS lead_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN lead_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN lead_id < page_id THEN lead_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first_of AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
mark AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(first_id < t.doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t JOIN first_of USING (text) LEFT JOIN mark ON mark.doc_id = t.doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
g AS (SELECT part, filter_order, step, n, good, toxic,
    least(CASE WHEN a THEN strpos(filter_order, 'A') END, CASE WHEN b THEN strpos(filter_order, 'B') END, CASE WHEN c THEN strpos(filter_order, 'C') END,
      CASE WHEN d THEN strpos(filter_order, 'D') END, CASE WHEN e THEN strpos(filter_order, 'E') END, 6) AS gone,
    CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails
  FROM m, o, unnest([1, 2, 3, 4, 5]) AS s(step)),
r AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r
"""


def _rounds_sql(rounds: int = 10, centroids: int = 8) -> str:
    """The rounds of clustering, each as two tables: the assignment and the centroids after it."""
    start = """
v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), n) - 1 AS c, n AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < %d)""" % centroids
    parts = [start]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT k, arg_min(c, distance * 100 + c) AS c, min(distance) AS distance
  FROM (SELECT k, c, list_sum(list_transform(list_zip(n, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{i}) GROUP BY k)""")
        if i < rounds:
            parts.append(f"""
u{i} AS (SELECT c, i, sum(n[i])::BIGINT AS s, count(*) AS z FROM a{i} JOIN v USING (k), unnest(generate_series(1, 64)) AS t(i) GROUP BY c, i),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(moved, m) AS m FROM c{i} LEFT JOIN
  (SELECT c, list(((s - ((s % z) + z) % z) // z)::BIGINT ORDER BY i) AS moved FROM u{i} GROUP BY c) USING (c))""")
    return f"""WITH {",".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (k) JOIN c{rounds} USING (c)
"""


OP13_SQL = _rounds_sql()


@query("op2_bpe")
def op2_bpe(spark, folder):
    """Encode and decode every document with the byte-level vocabulary."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=())
    return made.select("doc_id", "n_tokens", "ids_sha256", F.col("decoded_sha256"))


@query("op10_toxicity")
def op10_toxicity(spark, folder):
    """Score every document; the model never sees the held-out fifth of the labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op4_pii")
def op4_pii(spark, folder):
    """Personal data in every document: pattern spans and those that the field adds."""
    found = pii.find_spans(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op7_warc", OP7_SQL)
def op7_warc(spark, folder):
    """Write every page into archives, read them back, and return what the records say."""
    path = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_topk", OP6_SQL)
def op6_topk(spark, folder):
    """The five best rows for every fiftieth vector."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark, folder):
    """Which words of each document belong to windows of benchmark items."""
    return decontamination.find_overlaps(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op9_near_dedup", OP9_SQL)
def op9_near_dedup(spark, folder):
    """The component of each document over links of similarity 0.85 or more on three-word shingles."""
    return near_dedup.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


@query("op3_line_dedup")
def op3_line_dedup(spark, folder):
    """Every document without the lines whose template recurs."""
    kept = line_dedup.drop_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op5_secrets")
def op5_secrets(spark, folder):
    """Secrets in every document, as start:end in code points."""
    found = secret_scan.scan_texts(spark.read.parquet(f"{folder}/documents.parquet"))
    spans = F.array_join(F.transform("secrets", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"))


@query("op8_licenses")
def op8_licenses(spark, folder):
    """License notices and texts in every document, as name:coverage:first word:end."""
    found = license_scan.scan_texts(spark.read.parquet(f"{folder}/documents.parquet"))
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["coverage"], x["start"], x["end"])), ",")
    return found.select("doc_id", "n_found", "best", spans.alias("licenses"))


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark, folder):
    """What every order of five filters removes from each source."""
    return filter_audit.audit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op12_lm_scores")
def op12_lm_scores(spark, folder):
    """Score every document under the model learned from six of seven."""
    return language_model.score_texts(spark.read.parquet(f"{folder}/documents.parquet"))


@query("op13_centroids", OP13_SQL)
def op13_centroids(spark, folder):
    """Ten rounds of eight centroids over every vector, in exact whole numbers."""
    return centroids.cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
