"""The registered queries of the operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokens
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.llm import bpe, counts, lexical, ngramjoin, packing, passages, ppm, quality, simhash, topk, toxicity, trie, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.document_pieces(docs, tokens.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled("embedding").alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode_documents(table(spark, sf_dir, "documents"), path, tokens.PATTERN)
    raw = ids.select("*", bpe.decode_ids("ids", path, tokens.PATTERN).alias("raw"))
    return raw.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), tokens.path("word_bpe_49k.json"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.predict_languages(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op2_topk"] = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


# All terms are plain words, so a bounded hit is a maximal run of letters and digits that equals a term.
SQL["op10_url_filter"] = f"""
WITH soft AS (SELECT unnest({list(urls.SOFT_TERMS)}) AS term, unnest({list(urls.SOFT_TERMS.values())}) AS weight),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract_all(lower(url), '[\\p{{L}}\\p{{N}}]+') AS runs FROM r),
v AS (SELECT *, len(list_filter(runs, lambda x: list_contains({list(urls.STRICT_TERMS)}, x))) AS n_strict,
  list_filter((SELECT list({{'t': term, 'w': weight}}) FROM soft), lambda s: list_contains(runs, s.t)) AS hits FROM h),
j AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM v)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN n_strict > 0 OR (len(hits) >= 2 AND list_sum(list_transform(hits, lambda s: s.w)) >= 3) THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n_strict AS INTEGER) AS n_strict, CAST(len(hits) AS INTEGER) AS n_soft FROM j
"""


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op13_lexical_search"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{TERM}') AS ts FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERM}')) AS term FROM benchmark),
ic AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
l AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
t AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM ic) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, l),
s AS (SELECT ic.item_id, tf.doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM ic JOIN tf USING (term) JOIN w USING (term), l GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_tree(table(spark, sf_dir, "conversations"))


# crc32 bit by bit over the decimal digits; of turns with one number the digest decides, as in the operator.
SQL["op11_prefix_trie"] = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'r': r, 'x': x} ORDER BY pos) AS own, 4294967295 AS ones FROM t GROUP BY c),
h AS (SELECT c, own, c - c % 20 AS base, xor(ones, list_reduce(list_prepend(ones, [CAST(ascii(s) AS BIGINT) FOR s IN string_split(CAST(c AS VARCHAR), '')]),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 4 AS h FROM o),
b AS (SELECT h.c, list_concat(coalesce(g.own[1:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN o g ON g.c = h.base),
p AS (SELECT c, len(seq) AS n, d, seq[1:d] AS pre, seq[d].x AS x FROM b, unnest(range(0, len(seq) + 1)) AS u(d)),
n AS (SELECT d, pre, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(x), '') AS x,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY d, pre),
m AS (SELECT p.c, p.d, n.conv_id FROM p JOIN n ON p.d = n.d AND p.pre = n.pre),
k AS (SELECT n.d, n.conv_id, n.n_convs, n.ends_sha256, (n.n_convs - 1) * len(regexp_extract_all(n.x, '[^\\x20\\x09-\\x0D]+')) AS saved, m.conv_id AS parent
  FROM n LEFT JOIN m ON m.c = n.conv_id AND m.d = n.d - 1),
ch AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
z AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN ch USING (d, conv_id)),
s AS (SELECT m.d, m.conv_id, CAST(sum(CAST(z.n_children = 0 AS INTEGER)) AS BIGINT) AS n_leaves, CAST(sum(z.saved) AS BIGINT) AS saved_tokens
  FROM z JOIN m ON m.c = z.conv_id AND m.d <= z.d GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM z JOIN s USING (d, conv_id)
"""


@query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(table(spark, sf_dir, "documents"))


SQL["op12_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')][1:len(ws)] ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.c AS component_id FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = s.doc_id
"""
