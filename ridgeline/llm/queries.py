"""The subpackage's registered queries, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import balls, infilling, language, lines, mixing, pieces, pii, quality, sharding, simhash, tokens, toxicity, vectors
from ridgeline.llm.common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), prior=quality.PRIOR)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), limit=2048)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(documents(spark, sf_dir), shards=40)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs, where=~language.held_out(F.col("doc_id")))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(documents(spark, sf_dir), pii.session_key(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=lambda i: ~toxicity.held_out(i))
    found = toxicity.score(docs, model, threshold=0.3)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_copies(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.fill_in_middle(documents(spark, sf_dir), share=50, spm_share=80, seed=42)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infilling.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dim=64, scale=64.0, seed="1:")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_byte_shards": op4_byte_shards,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_toxicity": op8_toxicity,
    "op9_vectors": op9_vectors,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ball_kmeans": op13_ball_kmeans,
}


def _lloyd(rounds: int) -> str:
    """Rounds of comparing all vectors with all 16 centroids; a distance and a number are compared as distance * 16 + number."""
    near = "min(CAST(list_sum(list_transform(range(1, 65), lambda j: (q[j] - c[j]) * (q[j] - c[j]))) AS BIGINT) * 16 + i)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, {near} AS v FROM kept, c{k} GROUP BY r)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT v % 16 AS i, unnest(range(1, 65)) AS j, unnest(q) AS x FROM a{k})")
            steps.append(f"f{k} AS (SELECT i, j, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM s{k} GROUP BY i, j)")
            steps.append(f"c{k + 1} AS (SELECT c{k}.i, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT i, list(CAST(x AS BIGINT) ORDER BY j) AS c FROM f{k} GROUP BY i) m ON m.i = c{k}.i)")
    return ",\n".join(steps)


#: op4: the checksum by its bytewise table, then one running sum over all rows. op9: all pairs in double precision,
#: components by reachability; brute force, for small tables. op11: the list of repeated keys, searched for each line.
#: op13: all vectors against all centroids in each round.
ORACLE_SQL = {
    "op4_byte_shards": """
WITH RECURSIVE steps(n, k, c) AS (
  SELECT n, 0, n FROM (SELECT unnest(range(256)) AS n)
  UNION ALL SELECT n, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM steps WHERE k < 8
), crc(t) AS (SELECT list(c ORDER BY n) FROM steps WHERE k = 8
), bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents
), keyed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, crc
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM keyed
), middles AS (
  SELECT *, 2 * upto - size AS middle, (2 * total) // 40 AS width, (2 * total) % 40 AS longer FROM placed
), dealt AS (
  SELECT *, CASE WHEN middle < longer * (width + 1) THEN middle // (width + 1) ELSE least(longer + (middle - longer * (width + 1)) // greatest(width, 1), 39) END AS shard FROM middles
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM dealt
""",
    "op9_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e, len(e) AS d FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND a.d = b.d
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT s.a AS vec_id, coalesce(c.n, 0) AS n_links, s.component_id, s.a = s.component_id AS kept
FROM smallest s LEFT JOIN counts c ON c.a = s.a
""",
    "op11_line_dedup": """
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), keyed AS (
  SELECT *, list_transform(l, lambda x: translate(trim(x, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM split
), hot AS (
  SELECT coalesce(list(k), []) AS h FROM (SELECT k FROM (SELECT DISTINCT r, unnest(k) AS k FROM keyed) WHERE k <> '' GROUP BY k HAVING count(*) >= 10)
), kept AS (
  SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(h, k[i])) AS stay FROM keyed, hot
)
SELECT doc_id, len(l) AS n_lines, len(l) - len(stay) AS n_dropped, sha256(coalesce(array_to_string(list_transform(stay, lambda i: l[i]), chr(10)), '')) AS kept_sha256 FROM kept
""",
    "op12_fill_in_middle": r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), units AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn
), ranks AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM ranks
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(concat(p, m, s)) AS restored_sha256 FROM parts
""",
    "op13_ball_kmeans": f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT i, c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS i, q AS c FROM kept) WHERE i < 16
), {_lloyd(3)}
SELECT vec_id, CAST(v % 16 AS INT) AS cluster, v // 16 AS distance, CAST(sum(v // 16) OVER (PARTITION BY v % 16) AS BIGINT) AS cluster_inertia,
  CAST(sum(v // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.i = v % 16
""",
}
