"""One query per operator, over its whole table with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklens.llm import bpe, clustering, embedding_dedup, language, licenses, line_dedup, lm_scoring, mixing, near_dup, phrases, quality, sharding, token_files
from decklens.llm.common import table


def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with recurring lines taken out."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids")
    return encoded.select("doc_id", "n_tokens", bpe.ids_digest("ids").alias("ids_sha256"), F.sha2(bpe.decode("ids"), 256).alias("decoded_sha256"))


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = lm_scoring.good_documents(docs, table(spark, sf_dir, "labels"))
    return lm_scoring.score(docs, target).drop("text")


def prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored(table(spark, sf_dir, "documents"), ids=False, crc=True)


def pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).drop("text")


def heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def sampled_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return rows.select("doc_id", "size", crc, "law", "shard", "slot", "grown_shard")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, which imports this package and so is imported here."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_templates": line_templates,
    "op2_fair_queueing": fair_queueing,
    "op3_byte_bpe": byte_bpe,
    "op4_cross_entropy": cross_entropy,
    "op5_prob_minhash": prob_minhash,
    "op6_license_rules": license_rules,
    "op7_string_kernel": string_kernel,
    "op8_patched_frames": patched_frames,
    "op9_pigeonhole": pigeonhole,
    "op10_boosted_trees": boosted_trees,
    "op11_heap_bounds": heap_bounds,
    "op12_sampled_phrases": sampled_phrases,
    "op13_external_shuffle": external_shuffle,
    "pipeline": pipeline,
}

#: all pairs of one label, then the closure of the links
_PIGEONHOLE = f"""
  WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {embedding_dedup.COSINE} ELSE false END),
  reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
  counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
  firsts AS (SELECT a, min(b) AS first FROM reached GROUP BY a)
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(first, vec_id)) AS component_id,
    vec_id <= coalesce(first, vec_id) AS kept
  FROM v LEFT JOIN counts ON counts.a = vec_id LEFT JOIN firsts ON firsts.a = vec_id"""



def _lloyd() -> str:
    """Ten plain rounds, every vector against every centroid; each centroid is one array."""
    nearest = """SELECT x, arg_min(c.no, (d, c.no)) AS cluster, min(d) AS distance FROM (
        SELECT p.x, p.point, c.no, list_sum(list_transform(list_zip(p.point, c.point), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM points p, centroids_{r} c) c GROUP BY x"""
    rounds = ", ".join(
        f"""assigned_{r} AS MATERIALIZED ({nearest.format(r=r)}),
  sums_{r} AS (SELECT cluster, i, sum(v) AS s, count(*) AS n FROM (
    SELECT cluster, unnest(point) AS v, generate_subscripts(point, 1) AS i FROM assigned_{r} JOIN points USING (x)) GROUP BY cluster, i),
  centroids_{r + 1} AS MATERIALIZED (SELECT no, coalesce(new, c.point) AS point FROM centroids_{r} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS new FROM sums_{r} GROUP BY cluster) ON cluster = no)"""
        for r in range(clustering.ROUNDS))
    return f"""
  WITH points AS MATERIALIZED (SELECT row_number() OVER () AS x, vec_id,
    list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {clustering.SCALE}) AS BIGINT)) AS point FROM embeddings
    WHERE len(embedding) = {clustering.DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  centroids_0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS no, point FROM (
    SELECT sha256('{clustering.SEED}:' || vec_id) AS h, point FROM points ORDER BY h LIMIT {clustering.CLUSTERS})),
  {rounds},
  last AS MATERIALIZED ({nearest.format(r=clustering.ROUNDS)})
  SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.point, ',')) AS centroid_sha256
  FROM last JOIN points USING (x) JOIN centroids_{clustering.ROUNDS} c ON c.no = cluster"""



def _fair_queue() -> str:
    """Running totals by source in the order of the hash, cut at the targets, then the rounds of filling."""
    w = ", ".join(map(str, mixing.WEIGHTS))
    fills = ", ".join(f"""
  gap_{r} AS (SELECT source, target, target - sum(size * copies) AS gap FROM taken_{r} GROUP BY source, target),
  best_{r} AS (SELECT n FROM (SELECT t.n, row_number() OVER (PARTITION BY t.source ORDER BY size DESC, text_key DESC, doc_id DESC NULLS LAST, n DESC) AS place
    FROM taken_{r} t JOIN gap_{r} g ON g.source IS NOT DISTINCT FROM t.source WHERE copies < {mixing.MAX_REPEATS} AND size > 0 AND size <= gap) WHERE place = 1),
  taken_{r + 1} AS MATERIALIZED (SELECT t.* REPLACE (copies + CAST(n IN (SELECT n FROM best_{r}) AS INTEGER) AS copies) FROM taken_{r} t)""" for r in range(mixing.FILLS))
    copies = " + ".join(f"CAST(source_size * {e} + upto <= target AS INTEGER)" for e in range(mixing.MAX_REPEATS))
    return f"""
  WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS text_key FROM documents),
  totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
  ranked AS (SELECT *, CAST([{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight,
    CAST(source_size * {mixing.MAX_REPEATS} AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM totals),
  levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > cap / weight AS capped FROM ranked),
  shares AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS spent, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS open FROM levels),
  targets AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, (budget - spent) / open * weight) END AS target FROM shares),
  queued AS (SELECT r.*, source_size, target,
    sum(size) OVER (PARTITION BY r.source ORDER BY text_key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM rows r JOIN targets t ON t.source IS NOT DISTINCT FROM r.source),
  taken_0 AS MATERIALIZED (SELECT n, doc_id, source, size, text_key, source_size, target, {copies} AS copies FROM queued), {fills}
  SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, copies FROM taken_{mixing.FILLS}"""


#: every phrase of every text, counted and cut without a sample
_PHRASES = f"""
  WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
  spoken AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
  found AS MATERIALIZED (SELECT lang, words, array_to_string(words, ' ') AS phrase, f FROM (
    SELECT lang, words, count(*) AS f FROM (
      SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS words
      FROM spoken, (SELECT unnest(range(1, {phrases.WORDS + 1})) AS k) WHERE len(w) >= k) GROUP BY lang, words HAVING count(*) >= {phrases.LEAST})),
  totals AS (SELECT lang, sum(len(w)) AS n FROM spoken GROUP BY lang),
  cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, len(words))) AS k FROM found WHERE len(words) >= 2) c
    JOIN found l ON l.lang = c.lang AND l.words = c.words[1:c.k] JOIN found r ON r.lang = c.lang AND r.words = c.words[c.k + 1:] JOIN totals t ON t.lang = c.lang),
  lowest AS (SELECT lang, phrase, a, n, unnest(min(struct_pack(score := score, k := k, l := l, r := r))) FROM cuts GROUP BY lang, phrase, a, n),
  inside AS (SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(f) AS longer
    FROM (SELECT *, unnest(range(1, len(words) - s + 2)) AS i FROM (SELECT *, unnest(range(2, len(words))) AS s FROM found WHERE len(words) >= 3)) GROUP BY ALL)
  SELECT * FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a) WHERE rank <= {phrases.TOP}"""

#: The others hold trained models, signatures, codecs or hashes that DuckDB does not have.
ORACLES: dict[str, str] = {"op2_fair_queueing": _fair_queue(), "op9_pigeonhole": _PIGEONHOLE, "op11_heap_bounds": _lloyd(), "op12_sampled_phrases": _PHRASES}
