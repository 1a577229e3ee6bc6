"""The queries of this subpackage: each operator with production parameters over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import align, chunk_dedup, decontaminate, exact_dedup, langid, ngram_join, piece_bpe, secrets, suffix_dedup, toxicity, url_filter, warc, whiten
from tidemark.llm.common import read


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoded(read(spark, sf_dir, "documents"), tokenizer())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measured(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.measured(read(spark, sf_dir, "documents"), extend=True)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(read(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_langid, op2_decontaminate, op3_url_filter, op4_sentencepiece, op5_suffix_dedup, op6_exact_dedup, op7_toxicity, op8_ngram_join),
        *(op9_warc, op10_chunk_dedup, op11_whitening, op12_alignment, op13_secrets),
    )
}

ORACLES = {
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, p, list_slice(w, p + 1, p + 12) AS v FROM (SELECT doc_id, w, unnest(range(0, len(w) - 11)) AS p FROM d WHERE len(w) >= 12)),
bw AS (SELECT item_id, p, list_slice(w, p + 1, p + 12) AS v FROM (SELECT item_id, w, unnest(range(0, len(w) - 11)) AS p FROM b WHERE len(w) >= 12)),
m AS (SELECT * FROM (VALUES (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)) t(i, j)),
ds AS (SELECT doc_id, p, v, i, j, concat_ws(' ', v[i+1], v[i+5], v[i+9], v[j+1], v[j+5], v[j+9]) AS seed FROM dw, m),
bs AS (SELECT DISTINCT item_id, v, i, j, concat_ws(' ', v[i+1], v[i+5], v[i+9], v[j+1], v[j+5], v[j+9]) AS seed FROM bw, m),
hits AS (SELECT doc_id, item_id, p, list_sum(list_transform(range(1, 13), lambda k: CASE WHEN ds.v[k] = bs.v[k] THEN 1 ELSE 0 END)) AS n FROM ds JOIN bs USING (i, j, seed)),
short AS (SELECT doc_id, item_id, p, len(b.w) AS n FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d WHERE len(w) > 0) x JOIN b ON len(b.w) BETWEEN 1 AND 11 AND list_slice(x.w, p + 1, p + len(b.w)) = b.w),
pos AS (SELECT doc_id, item_id, p, max(n) AS n FROM (SELECT * FROM hits WHERE n >= 10 UNION ALL SELECT * FROM short) GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS n_equal, count(*) AS n_windows FROM pos GROUP BY ALL
""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), q AS (SELECT page_id, t, strlen(t) AS n, min(page_id) OVER (PARTITION BY t) AS r FROM p)
SELECT page_id, n AS payload_bytes, sha256(t) AS payload_digest, CASE WHEN n >= 100 AND page_id <> r THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> r THEN r END AS refers_to FROM q
""",
    "op3_url_filter": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) t(word, rule)),
w AS (SELECT page_id, host, path, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS site FROM u),
c AS (SELECT site, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS g, string_split(site, '.') AS l
      FROM w LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM labels) l ON l.doc_id = w.page_id GROUP BY site),
v AS (SELECT site, n, g, l, regexp_full_match(site, '[0-9]+([.][0-9]+){3}') AS num, array_to_string(l[-2:], '.') AS two,
             array_to_string(l[-2:], '.') IN (TWO_LEVEL) AS wide FROM c),
h AS (SELECT site, n, g, CASE WHEN num THEN '' WHEN wide THEN two ELSE l[-1] END AS suffix,
             CASE WHEN num THEN site WHEN wide THEN array_to_string(l[-3:], '.') ELSE two END AS domain FROM v),
d AS (SELECT suffix, domain, sum(n) AS n, sum(g) AS g FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(g) AS g FROM d GROUP BY ALL),
m AS (SELECT lvl, sum(n) AS t, sum(g) AS g, sum(n * n) AS sq, count(*) AS c, sum(g * g / n) AS a
      FROM (SELECT 'h' AS lvl, n, g FROM h UNION ALL SELECT 'd', n, g FROM d UNION ALL SELECT 's', n, g FROM s) WHERE n > 0 GROUP BY lvl),
q AS (SELECT lvl, (g + 1) / (t + 2) AS mean, (g / t) * (1 - g / t) AS w, a - g * (g / t) AS spread, t, sq, c FROM m),
e AS (SELECT lvl, mean, CASE WHEN w * (t - sq / t - (c - 1)) > 0 THEN (spread - w * (c - 1)) / (w * (t - sq / t - (c - 1))) ELSE 0 END AS alike FROM q),
k AS (SELECT lvl, mean, CASE WHEN alike <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, 1 / alike - 1)) END AS k FROM e),
z AS (SELECT coalesce((SELECT mean FROM k WHERE lvl = 's'), 0.5::DOUBLE) AS mean, coalesce((SELECT k FROM k WHERE lvl = 's'), 1::DOUBLE) AS ks,
             coalesce((SELECT k FROM k WHERE lvl = 'd'), 1::DOUBLE) AS kd, coalesce((SELECT k FROM k WHERE lvl = 'h'), 1::DOUBLE) AS kh),
p AS (SELECT h.site, h.g + kh * dm AS a, h.n - h.g + kh * (1 - dm) AS b
      FROM h JOIN (SELECT d.domain, (d.g + kd * sm) / (d.n + kd) AS dm, kh FROM d JOIN (SELECT s.suffix, (s.g + ks * mean) / (s.n + ks) AS sm, kd, kh FROM s, z) x USING (suffix)) y USING (domain)),
b AS (SELECT site, list_sum(list_transform(range(0, 200 + 4 * CAST(a + b AS BIGINT)), lambda i: exp(lgamma(a + b + i) - lgamma(a + i + 1) - lgamma(b) - (a + b + i) * ln(2e0)))) > 95e-2 AS bad FROM p),
j AS (SELECT page_id, w.host, path, (SELECT max_by(rule, length(rule)) FROM r WHERE (w.host = split_part(rule, '/', 1) OR ends_with(w.host, '.' || split_part(rule, '/', 1)))
             AND starts_with(w.path, substr(rule, instr(rule, '/')))) AS rule, bad FROM w JOIN b ON b.site = w.site)
SELECT page_id, host, path, rule, coalesce((SELECT word FROM r WHERE r.rule = j.rule), CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM j
""".replace("TWO_LEVEL", ", ".join(f"'{x}'" for x in url_filter.TWO_LEVEL)),
}
