"""The operators over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import embedding_dedup, license_scan, near_dedup, packing, pieces, quality_classifier, quality_rules, substring_dedup, suffix_tree_lm, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digest(substring_dedup.substring_dedup(docs, keep=["doc_id"]))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    out = url_filter.url_filter(url_filter.page_captures(pages), url_filter.page_entries(pages))
    return out.select("page_id", "url", "host", F.col("day").cast("string").alias("day"), "n_lists", "first_list", "kept")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, _vocabulary("piece_bpe_32k.model"), keep=["doc_id"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.quality_rules(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


#: The list log and the as-of join of op8 in DuckDB's SQL; crc32 is computed bit by bit, as DuckDB has none.
OP8_SQL = r"""
with recursive bytes as (select i, i as c, 0 as step from range(256) t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bytes where step < 8),
crc_table as (select list(c order by i) as t from bytes where step = 8),
pages_ as (select page_id, url, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', ''), '') as host,
    date '2022-01-01' + cast(((page_id * 37) % 720 + 720) % 720 as integer) as day from pages),
hosts as (select distinct host from pages_ where host is not null),
crcs as (select host, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(host)) + 1),
    lambda i: cast(('0x' || substr(hex(encode(host)), 2 * i - 1, 2)) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc from hosts, crc_table),
log as (select ['adult', 'malware', 'spam'][(crc // 5) % 3 + 1] as list_name, host as domain, date '2022-01-01' + cast((crc // 15) % 400 as integer) as start, crc from crcs where crc % 5 = 0),
entries as (select list_name, domain, start as day, 'add' as action from log
  union all select list_name, domain, start + 90, 'remove' from log where crc % 4 <> 1
  union all select list_name, domain, start + 200, 'add' from log where crc % 4 = 2),
spans as (select list_name, domain, day as valid_from, action, lead(day) over (partition by list_name, domain order by day) as valid_to from entries),
labels as (select page_id, day, host, string_split(host, '.') as l from pages_ where host is not null),
parents as (select page_id, day, unnest(case when len(l) >= 2 then list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) else [host] end) as domain from labels),
hits as (select page_id, count(distinct list_name) as n_lists, min(list_name) as first_list from parents join spans using (domain)
  where action = 'add' and valid_from <= day and (valid_to is null or day < valid_to) group by page_id)
select page_id, url, host, strftime(day, '%Y-%m-%d') as day, coalesce(n_lists, 0) as n_lists, first_list, coalesce(n_lists, 0) = 0 as kept
from pages_ left join hits using (page_id)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_license_scan, op3_suffix_tree_lm, op4_quality_classifier, op5_substring_dedup, op6_near_dedup, op7_embedding_dedup, op8_url_filter, op9_pieces, op10_quality_rules)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": OP8_SQL}
