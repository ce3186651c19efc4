"""The queries of the thirteen operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embeddings, fim, ordinal, packing, pii, resample, rules, simhash, substring, tokenfile, toxicity, warc
from .common import cut, table

GRADES = 3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 2048 words, one of a source and of a cluster of copies in a bin."""
    out = packing.pack(packing.sizes(table(spark, sf_dir, "documents")), capacity=2048)
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("bin", "bin_id")


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and the probability of a good grade of every document; kept if that is a half or more."""
    docs, ratings = table(spark, sf_dir, "documents"), grades(table(spark, sf_dir, "labels"))
    model = ordinal.fit(docs, ratings.where(~toxicity.held_out()), GRADES)
    out = ordinal.score(docs, model, GRADES, tail=1)
    return out.select(F.col("id").alias("doc_id"), "expected_grade", "p_tail", (F.col("p_tail") >= 0.5).alias("keep"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as token files and read back."""
    import public_tokenizers

    out = tokenfile.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.scan(docs, pii.fit(docs))
    kinds = F.transform(F.split("pii_base", ","), lambda s: F.split_part(s, F.lit(":"), F.lit(1)))
    of = lambda name: F.size(F.filter(kinds, lambda k: k == F.lit(name))).cast("long")
    counts = [of(name).alias(f"n_{name}") for name in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2("pii_base", 256).alias("base_sha256"), F.col("pii_spans").alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    out = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"), segment_bytes=4096, chunk_bytes=1024)
    return out.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated passages of 35 words or more leave."""
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items they come from."""
    out = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the base rules and of a decision list learned on rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = cut(rules.statistics(docs), "statistics")
    out = rules.judge(stats, rules.learn(stats, labels.where(~toxicity.held_out())))
    return out.select(F.col("id").alias("doc_id"), *rules.COUNTS[:5], "base_failed", "kept", "rule")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at lines, its middle last, and the text rebuilt from that."""
    out = fim.transform(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50, unit="line")
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the words of the benchmark; every document's weight and score."""
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), dims=10_000, longest=1, percent=10, least_words=20, seed=2024)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_quality, op4_tokens, op5_pii, op6_simhash, op7_embeddings, op8_warc, op9_substring, op10_decontamination, op11_rules, op12_fim, op13_resampling)}

_WORDS = r"[^\x20\x09-\x0D]+"
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op7_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.y FROM r JOIN p ON p.x = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.x = c.vec_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f""",
    "op9_substring": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
r AS (SELECT s FROM e GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM e JOIN r USING (s), unnest(range(35)) AS t(j) GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ITEM_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ITEM_WORDS}') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
e AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM x), unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT DISTINCT doc_id, n, i, s FROM e SEMI JOIN x USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(n)) AS t(j) GROUP BY doc_id),
o AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS l FROM h JOIN x USING (n, s) WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(l), 0) AS n_items,
  sha256(coalesce(array_to_string(list_sort(l), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op12_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
    WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c""",
    "op13_resampling": rf"""
WITH tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS z FROM range(256) AS r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_ITEM_WORDS}') AS w FROM documents),
dw AS MATERIALIZED (SELECT r, f, count(*) AS k FROM (SELECT r, unnest(w) AS f FROM d) GROUP BY r, f),
bw AS MATERIALIZED (SELECT f, count(*) AS k FROM (SELECT unnest(regexp_extract_all({_LOW}, '{_ITEM_WORDS}')) AS f FROM benchmark) GROUP BY f),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(CAST(octet_length(encode(f)) AS BIGINT)), lambda j: CAST('0x' || hex(encode(f))[2 * j + 1:2 * j + 2] AS BIGINT)),
  lambda c, y: xor(c >> 8, z[xor(c, y) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM dw UNION SELECT f FROM bw) CROSS JOIN tab),
g AS (SELECT q.bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT range AS bucket FROM range(10000)) q
  LEFT JOIN (SELECT bucket, sum(k) AS s FROM dw JOIN b USING (f) GROUP BY bucket) x USING (bucket)
  LEFT JOIN (SELECT bucket, sum(k) AS t FROM bw JOIN b USING (f) GROUP BY bucket) y USING (bucket)),
e AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM g),
v AS (SELECT r, sum(k * gain) AS weight FROM dw JOIN b USING (f) JOIN e USING (bucket) GROUP BY r),
c AS (SELECT r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN v USING (r)),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS total FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * total // 100 THEN place END AS rank FROM k""",
}
