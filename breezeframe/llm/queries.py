"""One query for each operator over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup, language, line_dedup, main_text, mixing, packing, personal_data, revisits, sketch_dedup, spelling, toxicity, vector_dedup, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(pages: DataFrame) -> DataFrame:
    """An archive's records, made of the pages: each page is captured once in full and revisited twice.

    The capture of page p is dated p minutes after an epoch; revisits follow 9 hours and 4 days later, so that a
    later page of the same URL may lie between. Tags are hashes of the page; every fifth first revisit has another
    tag, every seventh second one only a date, every eleventh page no validator. Revisits write the URL with
    a fragment and a tracking parameter.
    """
    p = F.col("page_id").cast("long")
    tag = F.md5(F.coalesce("html", F.lit("")))
    date = F.concat(F.lit("day "), F.floor(p / 1440).cast("string"))
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    none = F.lit(None).cast("string")
    marked = F.concat("url", F.when(F.col("url").contains("?"), "&utm_source=feed").otherwise("?utm_source=feed"), F.lit("#again"))
    bare = p % 11 == 0

    def record(k: int, url, status: int, minutes: int, **headers) -> F.Column:
        names = F.array(*(F.lit(n.replace("_", "-")) for n in headers))
        held = F.map_filter(F.map_from_arrays(names, F.array(*headers.values())), lambda _, v: v.isNotNull())
        at = F.timestamp_seconds((p + minutes) * 60 + F.lit(1_500_000_000))
        return F.struct((p * 3 + k).alias("record_id"), url.alias("url"), at.alias("at"), F.lit(status).alias("status"), held.alias("headers"))

    full = record(
        0, F.col("url"), 200, 0, ETag=F.when(~bare, tag), Last_Modified=F.when(~bare, date), Content_Length=length, Cache_Control=F.lit("max-age=60")
    )
    first = record(
        1, marked, 304, 540, ETag=F.when(~bare, F.when(p % 5 == 0, F.md5(tag)).otherwise(F.concat(F.lit("W/"), tag))), Content_Length=F.lit("0"),
        Cache_Control=F.concat(F.lit("max-age="), (p % 100).cast("string")), X_Seen=F.lit("1"),
    )
    second = record(2, marked, 304, 5760, ETag=F.when(~bare & (p % 7 != 0), tag), Last_Modified=F.when(p % 7 == 0, date), Age=F.when(p % 2 == 0, "5").otherwise(none))
    return pages.select(F.explode(F.array(full, first, second)).alias("r")).select("r.*")


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(_table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "url_key", "outcome", "response_id", F.unix_seconds("response_at").alias("response_second"), listed.alias("headers"))


def op2_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, threshold=80)


def op3_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal words are a duplicate cluster."""
    docs = _table(spark, sf_dir, "documents")
    cluster = F.xxhash64(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", ""))
    return packing.pack(docs, mixing.n_words(F.col("text")), F.col("source"), cluster)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return personal_data.find(docs, personal_data.fit(docs))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).drop("taken_first", "taken_again")


def op8_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, labels.where(~held_out(F.col("doc_id"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines cut, and length and hash of the text that stays."""
    left = line_dedup.without_repeats(_table(spark, sf_dir, "documents"), whole=True)
    return left.select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_cut").cast("long").alias("n_cut"),
        F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = language.predict(docs, language.fit(docs.where(~held)))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


_OP1_SQL = r"""
WITH c AS (
  SELECT page_id p, url, coalesce(html, '') html, md5(coalesce(html, '')) tag, 'day ' || (page_id // 1440) d FROM pages),
r AS (
  SELECT p * 3 id, url, p * 60 + 1500000000 t, 200 status, CASE WHEN p % 11 <> 0 THEN tag END etag, CASE WHEN p % 11 <> 0 THEN d END lm,
    CAST(length(html) AS VARCHAR) cl, 'max-age=60' cc, NULL age, NULL seen FROM c
  UNION ALL
  SELECT p * 3 + 1, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed#again', (p + 540) * 60 + 1500000000, 304,
    CASE WHEN p % 11 <> 0 THEN CASE WHEN p % 5 = 0 THEN md5(tag) ELSE 'W/' || tag END END, NULL, NULL, 'max-age=' || (p % 100), NULL, '1' FROM c
  UNION ALL
  SELECT p * 3 + 2, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed#again', (p + 5760) * 60 + 1500000000, 304,
    CASE WHEN p % 11 <> 0 AND p % 7 <> 0 THEN tag END, CASE WHEN p % 7 = 0 THEN d END, NULL, NULL, CASE WHEN p % 2 = 0 THEN '5' END, NULL FROM c),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') bare FROM r),
q AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', '') host, regexp_extract(bare, '^[^/?]*([^?]*)', 1) path,
    list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) query FROM b),
k AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END url_key FROM q),
f AS (SELECT url_key, t, max(id) id FROM k WHERE status = 200 GROUP BY 1, 2),
n AS (SELECT v.*, f.id fid, f.t ft FROM (SELECT * FROM k WHERE status = 304) v ASOF LEFT JOIN f ON v.url_key = f.url_key AND v.t > f.t),
m AS (
  SELECT n.*, s.etag se, s.lm sl, s.cl sc, s.cc scc, coalesce(regexp_replace(s.etag, '^W/', '') = regexp_replace(n.etag, '^W/', ''), s.lm = n.lm) agree
  FROM n LEFT JOIN k s ON n.fid = s.id),
o AS (SELECT *, CASE WHEN fid IS NULL THEN 'missing' WHEN agree THEN 'resolved' WHEN NOT agree THEN 'changed' ELSE 'unproven' END outcome FROM m)
SELECT id record_id, url_key, outcome, CASE WHEN outcome = 'resolved' THEN fid END response_id, CASE WHEN outcome = 'resolved' THEN ft END response_second,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_filter([
    'etag=' || coalesce(etag, se), 'last-modified=' || coalesce(lm, sl), 'content-length=' || coalesce(cl_new, sc), 'cache-control=' || coalesce(cc, scc),
    'age=' || age, 'x-seen=' || seen], lambda x: x IS NOT NULL)), ';') END headers
FROM (SELECT *, CAST(NULL AS VARCHAR) cl_new FROM o)
"""

_OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) sha FROM documents),
g AS (SELECT sha, count(*) n, arg_min(doc_id, (-points, doc_id)) keep_id FROM t GROUP BY sha)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, t.sha AS text_sha256 FROM t JOIN g ON t.sha = g.sha
"""


def queries() -> dict[str, Query]:
    ops = (
        op1_revisits, op2_sketch_near_dedup, op3_grace_exact_dedup, op4_best_fit_packing, op5_main_text, op6_personal_data, op7_source_mix,
        op8_vector_near_dedup, op9_toxicity, op10_line_dedup, op11_whitening, op12_language, op13_spelling_variants,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_revisits": _OP1_SQL, "op3_grace_exact_dedup": _OP3_SQL}
