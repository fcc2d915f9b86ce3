"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, exact_dedup, hard_negatives, html_text, line_dedup, ngram_join, packing, quality, sharding, unigram, url_filter, warc
from .common import scratch_path, table, without_blanks

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]
BLOCKED_HOSTS = ["cheap-pills.example.com", "spam-farm.example.org", "casino.example.net"]
#: Further listed hosts, made by a rule: ``ads-0.example.net`` and so on.
MORE_HOSTS = 30_000


def blocked_hosts(spark: SparkSession) -> DataFrame:
    named = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    return named.unionByName(spark.range(MORE_HOSTS).select(F.concat(F.lit("ads-"), "id", F.lit(".example.net")).alias("host")))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES, blocked_hosts(spark))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.ShardTree.uniform(40, regions=4, racks=2))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_duplicates(docs, carry={"text_sha256": F.sha2(without_blanks(F.col("text")), 256)})


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_captures(spark, path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     listed(h) AS (VALUES ('cheap-pills.example.com'), ('spam-farm.example.org'), ('casino.example.net') UNION ALL SELECT 'ads-' || i || '.example.net' FROM range(30000) t(i)),
     hosts AS (SELECT host, max((host = h OR ends_with(host, '.' || h))::INT) AS bad FROM (SELECT DISTINCT host FROM u), listed GROUP BY host),
     fits AS (SELECT u.page_id, max({'n': length(h || p), 'rule': h || p, 'v': v}) AS best FROM u, rules
              WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.page_id)
SELECT u.page_id, host, path, best.rule AS rule,
       coalesce(best.v, CASE WHEN bad = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits USING (page_id) LEFT JOIN hosts USING (host)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
     e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
           GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
     l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
     r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP6_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

OP10_SQL = r"""
WITH h AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


OP11_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id) WHERE own <> label AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM t),
     k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     d AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT doc_id, i, line, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN d USING (key)) GROUP BY doc_id
"""

OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
     g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m)),
     f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
     n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
     c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
     i AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c o ON s.lang = o.lang AND s.m < o.m AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * o.a >= 100 * s.a),
     k AS (SELECT lang, phrase, a, ws, unnest(range(1, m)) AS k FROM c ANTI JOIN i USING (lang, phrase)),
     x AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n.n, (1000 * a::HUGEINT * n.n) // (l.f::HUGEINT * r.f) AS score
           FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = k.lang),
     b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM b QUALIFY rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html_extraction, op2_url_filters, op3_ngram_jaccard, op4_nearest_neighbours, op5_sharding, op6_exact_dedup, op7_sentencepiece, op8_packing, op9_quality, op10_warc, op11_hard_negatives, op12_line_dedup, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
