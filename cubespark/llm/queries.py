"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, langid, minhash, mixing, packing, pii, sharding, tokens, urlfilter


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), target_entropy=0.95, max_repetition=2.0)


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def queries() -> dict:
    named = (op1_mix_sources, op2_wavelet_tokens, op3_vector_shards, op4_exact_dedup, op5_nearest_vectors, op6_near_classes, op7_personal_data, op8_language, op9_url_verdicts, op10_pack)
    return {f.__name__: f for f in named}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIX_SQL = """
WITH thin AS (SELECT doc_id, source, CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT) AS tokens FROM documents),
stats AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS t FROM thin GROUP BY source),
shares AS (SELECT source, t, t / CAST((SELECT greatest(sum(t), 1) FROM stats) AS DOUBLE) AS share FROM stats),
ends AS (SELECT max(share) AS top, min(share) AS low, count(*) AS k FROM shares WHERE share > 0),
grid AS (SELECT j / 4096.0::DOUBLE AS a FROM generate_series(0, 4096) AS g(j)),
curve AS (SELECT a, sum(pow(share, a)) AS z, ln(sum(pow(share, a))) - a * sum(pow(share, a) * ln(share)) / sum(pow(share, a)) AS h
          FROM grid, shares WHERE share > 0 GROUP BY a),
usual AS (SELECT coalesce(max(a), 0) AS a FROM curve, ends WHERE h >= 0.95::DOUBLE * ln(k)),
chosen AS (SELECT CASE WHEN pow(top / low, 1 - n.a) <= 2 THEN n.a
                       ELSE (SELECT coalesce(min(g.a), 1) FROM grid g WHERE pow(top / low, 1 - g.a) <= 4) END AS a
           FROM usual n, ends),
plan AS (SELECT source, t, CASE WHEN share > 0 THEN pow(share, a) / (SELECT sum(pow(share, a)) FROM shares WHERE share > 0) ELSE 0 END AS weight,
                CASE WHEN share > 0 THEN pow(top / share, 1 - a) ELSE 1 END AS epochs FROM shares, ends, chosen),
quota AS (SELECT *, CAST(floor(epochs) AS INT) AS whole, CAST(floor((epochs - floor(epochs)) * t) AS BIGINT) AS rest FROM plan),
last AS (SELECT d.*, q.whole, q.rest, md5('17:' || q.whole || ':' || d.doc_id) AS key
         FROM thin d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
fits AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id) AS upto FROM last),
rows_ AS (SELECT doc_id, source, tokens, e AS epoch FROM (SELECT *, unnest(range(0, whole)) AS e FROM last)
          UNION ALL SELECT doc_id, source, tokens, whole FROM fits WHERE rest > 0 AND upto <= rest),
keyed AS (SELECT *, md5('17:' || epoch || ':' || doc_id) AS key FROM rows_)
SELECT k.doc_id, k.source, CAST(k.epoch AS INT) AS epoch, CAST(('0x' || substr(key, 1, 2)) AS INT) AS block, k.tokens,
       CAST(sum(tokens) OVER (PARTITION BY k.source, epoch ORDER BY key, doc_id) - tokens AS BIGINT) AS start, round(p.weight, 9) AS weight
FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
"""

EXACT_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""


URL_SQL = f"""
WITH RECURSIVE parts AS (SELECT page_id, html,
    CASE WHEN position('://' IN url) > 0 THEN translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
    CASE WHEN position('://' IN url) > 0 THEN regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
-- the longest first
rules(verdict, h, p, n) AS (VALUES ('block', 'example.org', '/en/1', 5), ('block', 'example.org', '/es/', 4), ('allow', 'com', '/fr/', 3), ('block', 'com', '/de/', 2), ('allow', 'org', '/', 1)),
judged AS (SELECT page_id, html, host, path, (SELECT arg_max(h || p, n) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
                  (SELECT arg_max(verdict, n) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS ruled FROM parts),
hosts AS (SELECT DISTINCT host FROM judged WHERE host <> ''),
climb AS (SELECT host AS src, CASE WHEN len(string_split(host, '.')) > 2 THEN substr(host, position('.' IN host) + 1) END AS dst FROM hosts
          UNION SELECT dst, CASE WHEN len(string_split(dst, '.')) > 2 THEN substr(dst, position('.' IN dst) + 1) END FROM climb WHERE dst IS NOT NULL),
up AS (SELECT DISTINCT src, dst FROM climb WHERE dst IS NOT NULL),
found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{urlfilter.LINK.replace("'", "''")}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM judged WHERE host <> ''),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM found WHERE src <> dst GROUP BY src, dst
          UNION ALL SELECT src, dst, 1.0::DOUBLE FROM up UNION ALL SELECT dst, src, 1.0::DOUBLE FROM up) GROUP BY src, dst),
both_ AS (SELECT 0 AS kind, src, dst, w FROM edges UNION ALL SELECT 1, dst, src, w FROM edges),
steps AS (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) * 0.85::DOUBLE AS p FROM both_),
own AS (SELECT host, ruled, count(*) AS n FROM judged WHERE ruled IS NOT NULL AND host <> '' GROUP BY host, ruled),
seeds AS (SELECT CASE WHEN ruled = 'allow' THEN 0 ELSE 1 END AS kind, host, n / CAST(sum(n) OVER (PARTITION BY ruled) AS DOUBLE) AS mass FROM own),
-- the share of each walk that is still under way after each step; a score is 0.15 times the sum of all
walk AS (SELECT 0 AS step, kind, host, mass FROM seeds
         UNION ALL SELECT w.step + 1, s.kind, s.dst, sum(w.mass * s.p) FROM walk w JOIN steps s ON w.kind = s.kind AND w.host = s.src WHERE w.step < 200 GROUP BY w.step + 1, s.kind, s.dst),
scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0) AS good, coalesce(sum(mass) FILTER (kind = 1), 0) AS bad FROM walk GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.ruled, CASE WHEN round(s.bad / (s.good + s.bad), 6) > 0.5 THEN 'block' WHEN s.host IS NOT NULL THEN 'allow' END, 'allow') AS verdict
FROM judged j LEFT JOIN scores s ON j.host = s.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": MIX_SQL, "op4_exact_dedup": EXACT_SQL, "op9_url_verdicts": URL_SQL}
