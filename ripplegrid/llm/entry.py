"""The queries of this subpackage, by name: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm import syncmers as S

    found = S.edited(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), S.as_text(F.col("own")).alias("fingerprint"), S.as_text(F.col("edited")).alias("edited_fingerprint"),
        S.likeness(F.col("own"), F.col("edited")).alias("near_edited"), S.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op2_block_max_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.common import held_out
    from ripplegrid.llm.toxicity import score

    found = score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours")


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_fixed_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.substring_dedup import repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_deficit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ripplegrid.llm.packing import pack

    found = pack(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op6_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.near_dedup import groups

    return groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_m_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.mtree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.pseudo_likelihood import score

    return score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.common import held_out
    from ripplegrid.llm.language_id import fit, identify

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")), carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_ratio_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.prefix_trie import trie

    return trie(_table(spark, sf_dir, "conversations"))


def op13_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplegrid.llm.centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_closed_syncmers, op2_block_max_toxicity, op3_sainte_lague_mix, op4_fixed_block_repeats, op5_deficit_packing, op6_license_set_join, op7_bag_minhash, op8_m_tree, op9_masked_pseudo_likelihood, op10_language_codes, op11_ratio_content, op12_prefix_trie, op13_threshold_centroids)
}

#: crc32 of the decimal form of c, byte by byte and bit by bit.
_CRC = "xor(list_reduce(flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [ascii(substr(c::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295)"


def _rounds(n: int) -> str:
    """Assignments (a) and centroids (c) of n rounds and the last assignment."""
    near = "a{0} AS MATERIALIZED (SELECT rid, vec_id, v, arg_min(k, [d, k]) AS k, min(d) AS d FROM (SELECT v.*, c.k, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{0} c) GROUP BY rid, vec_id, v)"
    move = "c{1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM a{0}) GROUP BY k, i) GROUP BY k) m USING (k))"
    return ", ".join(part.format(r, r + 1) for r in range(n) for part in (near, move)) + ", " + near.format(n)


ORACLE_SQL: dict[str, str] = {
    "op4_fixed_block_repeats": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
s AS (SELECT doc_id, i, word, word || {" || ".join(f"' ' || lead(word, {n}) OVER w" for n in range(1, 13))} AS long FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT long, min(doc_id) AS first FROM s WHERE long IS NOT NULL GROUP BY long),
m AS (SELECT s.doc_id, i, word, coalesce(first < s.doc_id, false) AS met FROM s LEFT JOIN f USING (long)),
g AS (SELECT doc_id, i, word, bool_or(met) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op8_m_tree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op12_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS b, length(coalesce(text, '')) AS m, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS i FROM t),
k AS (SELECT c, b, {_CRC} % 6 AS h FROM (SELECT DISTINCT c, b FROM t)),
p AS (SELECT k.c, i, g, m FROM k JOIN o ON o.c = k.b AND i <= h UNION ALL SELECT k.c, i, g, m FROM k JOIN o ON o.c = k.c AND i > h),
l AS (SELECT k.c, coalesce(string_agg(g, '' ORDER BY i), '') AS path, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), []) AS ms FROM k LEFT JOIN p USING (c) GROUP BY k.c),
s AS (SELECT c, len(ms) AS n, d, path[:32 * d] AS key, CASE WHEN d = 0 THEN 0 ELSE ms[d] END AS m FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM l)),
n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(m) AS m, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM s GROUP BY key, d),
q AS (SELECT key, d, count(*) AS children FROM (SELECT key[:32 * (d - 1)] AS key, d - 1 AS d FROM n WHERE d > 0) GROUP BY ALL),
w AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN q USING (key, d)),
u AS (SELECT key[:32 * a] AS key, a AS d, sum((children = 0)::INT)::BIGINT AS leaves, sum((n_convs - 1) * m)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, y.conv_id AS parent_conv_id, w.n_convs, w.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN u USING (key, d) LEFT JOIN n y ON y.d = w.d - 1 AND y.key = w.key[:32 * (w.d - 1)]
""",
    "op13_threshold_centroids": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM v QUALIFY k < 8), {_rounds(10)},
f AS (SELECT k, sha256(array_to_string(v, ',')) AS sha FROM c10)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a10 JOIN f USING (k)
""",
}
