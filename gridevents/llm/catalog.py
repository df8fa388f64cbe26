"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridevents.llm.bloomlm import score
from gridevents.llm.centroids import CLUSTERS, ROUNDS, clusters
from gridevents.llm.chat import chat
from gridevents.llm.collocations import collocations
from gridevents.llm.htmltext import extract
from gridevents.llm.maxscore import top_k
from gridevents.llm.mixing import mixture
from gridevents.llm.neardup import near_duplicates
from gridevents.llm.packing import pack
from gridevents.llm.passages import passages
from gridevents.llm.quality import quality
from gridevents.llm.secrets import joined, secrets
from gridevents.llm.transducer import encode_decode

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_dartminhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op6_compression_bands")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))


@query("op7_passages")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return passages(table(spark, folder, "documents"))


@query("op5_assignment_secrets")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    counts = [F.size(F.filter(F.col("spans.kind"), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}")
              for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query("op8_first_fit_decreasing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op10_bpe_transducer")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_decode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_bloom_lm")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))


@query("op3_maxscore", """
WITH whole AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.terms, c.terms, true), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON c.vec_id <> q.vec_id
    WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op1_role_repair")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return chat(table(spark, folder, "conversations"))


@query("op9_boosted_dom")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op11_branch_and_bound", r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(part, '[ \t]+'), lambda w: w <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[.,;:!?\x0A-\x0D]')) AS part
          FROM documents)),
grams AS MATERIALIZED (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) AS sizes(m) WHERE len(w) >= m)
    GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 100),
inner_part AS (
    SELECT DISTINCT c.lang, array_to_string(c.w[i:i + size - 1], ' ') AS phrase, c.f
    FROM cand c, range(2, 5) AS sizes(size), range(1, 5) AS starts(i)
    WHERE size < c.m AND i + size - 1 <= c.m),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN inner_part p USING (lang, phrase) WHERE 100 * p.f >= 100 * c.f),
cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, t.n,
           CAST(1000 * CAST(c.f AS HUGEINT) * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM cand c JOIN totals t USING (lang), range(1, 5) AS ks(k),
         grams l, grams r
    WHERE k < c.m AND l.lang = c.lang AND r.lang = c.lang
      AND l.phrase = array_to_string(c.w[:k], ' ') AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM worst ANTI JOIN gone USING (lang, phrase))
WHERE rank <= 2000
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def centroid_sql() -> str:
    """The rounds of centroid clustering written out one after another."""
    kept = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT r, unnest(range(64)) AS j, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (
    SELECT k, unnest(range(64)) AS j, unnest(v) AS x
    FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL)
    WHERE k < {CLUSTERS})"""
    assign = """
a{0} AS MATERIALIZED (
    SELECT r, k, distance FROM (
        SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM cells v JOIN c{0} c USING (j) GROUP BY v.r, c.k)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)"""
    update = """
c{1} AS MATERIALIZED (
    SELECT c.k, c.j, coalesce((s.total - ((s.total % s.n) + s.n) % s.n) // s.n, c.x) AS x
    FROM c{0} c LEFT JOIN (SELECT k, j, CAST(sum(x) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS n
                           FROM a{0} JOIN cells USING (r) GROUP BY k, j) s USING (k, j))"""
    steps = [part for n in range(ROUNDS) for part in (assign.format(n), update.format(n, n + 1))] + [assign.format(ROUNDS)]
    return ",".join([kept, *steps]) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r)
JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k) USING (k)"""


@query("op13_incremental_centroids", centroid_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(table(spark, folder, "embeddings"))


@query("op12_subset_sum_mixture")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"))


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
