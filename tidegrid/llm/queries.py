"""The registered queries of the operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.bpe import bpe_round_trip
from tidegrid.llm.common import is_bucket, written
from tidegrid.llm.conversations import damage_and_repair
from tidegrid.llm.decontaminate import contamination
from tidegrid.llm.language import identify_languages, learn_languages
from tidegrid.llm.licenses import scan_licenses
from tidegrid.llm.lm_score import score_documents
from tidegrid.llm.mixing import by_length, mix_sources, with_size
from tidegrid.llm.near_dedup import near_duplicates
from tidegrid.llm.quality import MODEL_BUCKETS, quality_rules
from tidegrid.llm.resample import resample
from tidegrid.llm.tokens import length_histogram, suffix_sums, with_token_count
from tidegrid.llm.url_filter import filter_urls, rule_table
from tidegrid.llm.warc import archive_pages, read_archives

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


# The rules of the URL query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

_URL_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
split AS (
  SELECT page_id, row_number() OVER () AS id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
hits AS (
  SELECT p.id, max({{'n': length(r.host) + length(r.path), 'h': length(r.host), 'b': r.verdict = 'block',
                    'rule': r.host || r.path, 'verdict': r.verdict}}) AS best
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN hits USING (id)"""


@register("op2_url_filter", _URL_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules(docs, _table(spark, sf_dir, "labels"), buckets=MODEL_BUCKETS, threshold=None)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *base, "score")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         2 * source_size AS cap
  FROM s),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
         sum(cap) OVER o - cap AS cap_before, sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST)),
c AS (SELECT *, cap * weight_left <= weight * (budget - cap_before) AS capped FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE weight * (budget - CAST(coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE))
                   / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target
  FROM c),
g AS (
  SELECT source, CAST(length(bin(size)) AS DOUBLE) AS k, CAST(sum(size) AS DOUBLE) AS words FROM d GROUP BY ALL),
h AS (
  SELECT g.source, k, words, target,
         2 * (SELECT sum(o.k * o.words) FROM g o WHERE o.source IS NOT DISTINCT FROM g.source AND o.k <= g.k)
         <= k * (target - 2 * coalesce(
           (SELECT sum(o.words) FROM g o WHERE o.source IS NOT DISTINCT FROM g.source AND o.k > g.k), 0)) AS at_limit
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
m AS (
  SELECT source, (any_value(target) - 2 * coalesce(sum(words) FILTER (at_limit), 0))
                 / nullif(sum(k * words) FILTER (NOT at_limit), 0) AS scale
  FROM h GROUP BY source),
e AS (
  SELECT doc_id, d.source, size, source_size, target,
         least(coalesce(CAST(length(bin(size)) AS DOUBLE) * scale, 2), 2) AS expected,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), 1, 13) AS BIGINT)
           + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS draw
  FROM d LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source),
q AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS whole,
         CASE WHEN expected > floor(expected)
              THEN draw / (1 - draw) * ((1 - (expected - floor(expected))) / (expected - floor(expected))) END AS ord
  FROM e),
r AS (
  SELECT *, target - CAST(sum(whole * size) OVER (PARTITION BY source) AS DOUBLE) AS room,
         CAST(CASE WHEN ord IS NOT NULL THEN sum(size) OVER (
           PARTITION BY source, ord IS NULL ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) END AS DOUBLE) AS reach
  FROM q)
SELECT doc_id, size, source_size, target, (whole + picked) * size AS taken
FROM (SELECT *, CASE WHEN ord IS NOT NULL AND 2 * (reach - size) + size <= 2 * room THEN 1 ELSE 0 END AS picked FROM r)
"""


@register("op9_mix_sources", MIX_SQL.replace("{docs}", "documents"))
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = with_size(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return mix_sources(written(sized), inclusion=by_length()).select("doc_id", "size", "source_size", "target", "taken")


@register("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = is_bucket("doc_id", 4, 2)
    model = learn_languages(docs.where(~held_out).select("text", "lang"))
    judged = identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_token_count(_table(spark, sf_dir, "documents").select("text")).select("n_tokens")
    return suffix_sums(written(length_histogram(counted)))


@register("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("spans", "expressions")


_HIT_SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
covered AS (SELECT id, count(DISTINCT p) AS n_hit
            FROM (SELECT DISTINCT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id),
named AS (SELECT id, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids
          FROM hits GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (id) LEFT JOIN named USING (id)"""


@register("op5_decontamination", _HIT_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.drop("text_key", "matches")


_WARC_SQL = """
WITH h AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), '') AS b FROM h),
d AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(b, 5 * j + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * j + 2, 1) AS INTEGER)
      + 4 * CAST(substr(b, 5 * j + 3, 1) AS INTEGER) + 2 * CAST(substr(b, 5 * j + 4, 1) AS INTEGER)
      + CAST(substr(b, 5 * j + 5, 1) AS INTEGER), 1)), '') AS digest FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS kept FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM m"""


@register("op10_warc", _WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = read_archives(archive_pages(_table(spark, sf_dir, "pages"))).where("is_last")
    stored = F.col("record_type") == "response"
    return ends.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.when(stored, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


_NEAR_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN m ON m.a = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id"""


@register("op3_near_dedup", _NEAR_SQL)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


@register("op1_lm_score")
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = is_bucket("doc_id", 5, 1)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("is_train"))
    scored = score_documents(docs)
    return scored.select(
        "doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@register("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@register("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.drop("text")


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(_table(spark, sf_dir, "conversations"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
