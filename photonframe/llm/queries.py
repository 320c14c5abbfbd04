"""The thin queries op1 to op13 over the driver's tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize
from . import license_scan, merkle
from .dual_tree import lloyd
from .media_ogg import store_and_read
from .oracles import license_sql, lloyd_sql
from .packing import pack
from .pattern_packing import pack_patterns
from .quality_rules import quality
from .secret_scan import scan
from .sentencepiece_bpe import encode_decode
from .simhash import near_duplicates
from .sharding import digest_rows, shuffle_into_shards
from .substring_dedup import dedup
from .whitening import whiten


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The audited replica: some records are altered, lost or added.
ALTERED, LOST, ADDED = "page_id % 97 = 13", "page_id % 211 = 5", "page_id % 307 = 11"
ARCHIVE_RECORDS = 64


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits an altered replica of pages, 64 pages to an archive, against the original. Each
    replica's records, offsets and tree are made from its own rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = F.expr(f"page_id div {ARCHIVE_RECORDS}")
    altered = pages.where(f"not coalesce({LOST}, false)").withColumn("html", F.when(F.expr(ALTERED), F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    added = pages.where(ADDED).withColumn("html", F.concat("html", F.lit("?")))
    other = altered.withColumn("key", F.col("page_id") * 2).unionByName(added.withColumn("key", F.col("page_id") * 2 + 1))
    first = merkle.records(pages, archive, F.col("page_id") * 2, F.col("html"))
    return merkle.report(first, merkle.records(other, archive, F.col("key"), F.col("html")))


#: Documents as files source/lang/folder/folder/doc_id.txt; one in 50 is the LICENSE of a folder.
DOCUMENT_PATH = "case when doc_id % 50 = 0 then concat_ws('/', source, lang, 'd' || cast(floor(doc_id % 350 / 50) as int), 'LICENSE') else concat_ws('/', source, lang, 'd' || doc_id % 7, 'e' || doc_id % 3, doc_id || '.txt') end"


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), F.expr(DOCUMENT_PATH))


def op3_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), digest=True)


def op8_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(documents(spark, sf_dir))


def op9_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(digest_rows(documents(spark, sf_dir)), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_ppl", "lower_band", "upper_band")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(embeddings(spark, sf_dir))
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(embeddings(spark, sf_dir))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_patterns(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_fixity": op1_merkle_fixity,
    "op2_license_scan": op2_license_scan,
    "op3_bounded_space_packing": op3_bounded_space_packing,
    "op4_simhash_pivots": op4_simhash_pivots,
    "op5_linked_secrets": op5_linked_secrets,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_media_ogg": op8_media_ogg,
    "op9_hypergeometric_sharding": op9_hypergeometric_sharding,
    "op10_quality_perplexity": op10_quality_perplexity,
    "op11_whitening_jacobi": op11_whitening_jacobi,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_pattern_packing": op13_pattern_packing,
}

#: Two levels, as archives of 17 to 256 records have.
_OP1_SQL = f"""
with src as (
  select 0 as side, page_id // {ARCHIVE_RECORDS} as archive, page_id*2 as key, html as p from pages
  union all select 1, page_id // {ARCHIVE_RECORDS}, page_id*2, case when {ALTERED} then html || '!' else html end from pages where not {LOST}
  union all select 1, page_id // {ARCHIVE_RECORDS}, page_id*2 + 1, html || '?' from pages where {ADDED}),
leaf as (
  select side, archive, row_number() over w - 1 as idx, strlen(p) as len, cast(sum(strlen(p)) over (w rows unbounded preceding) - strlen(p) as bigint) as off,
    sha256(p) as digest, '1:=' || key as name
  from src window w as (partition by side, archive order by key)),
h as (select *, sha256(name || ':' || len || ':' || digest) as hash, cast('0x' || substr(sha256(name), 1, 15) as bigint) as z from leaf),
up as (
  select side, archive, idx, hash, coalesce(last_value(case when z % 16 = 0 then name end ignore nulls) over w, '') as up1, coalesce(last_value(case when z % 256 = 0 then name end ignore nulls) over w, '') as up2
  from h window w as (partition by side, archive order by idx rows unbounded preceding)),
n1 as (select side, archive, up1, up2, min(idx) as idx, sha256(string_agg(hash, '' order by idx)) as hash from up group by 1, 2, 3, 4),
n2 as (select side, archive, up2, min(idx) as idx, sha256(string_agg(hash, '' order by idx)) as hash from n1 group by 1, 2, 3),
root as (select side, archive, sha256(string_agg(hash, '' order by idx)) as root from n2 group by 1, 2),
bad as (
  select archive, count(*) as n, string_agg(idx || ':' || status || ':' || off || ':' || len, ',' order by idx, status, off, len) as t from (
    select archive, coalesce(a.idx, b.idx) as idx, coalesce(a.off, b.off) as off, coalesce(a.len, b.len) as len, case when b.idx is null then 'missing' when a.idx is null then 'extra' else 'corrupt' end as status
    from (select * from h where side = 0) a full join (select * from h where side = 1) b using (archive, name) where a.hash is distinct from b.hash)
  group by 1)
select archive, a.root as root_a, b.root as root_b, a.root is not distinct from b.root as intact, coalesce(n, 0) as n_faults, coalesce(t, '') as faults
from (select * from root where side = 0) a full join (select * from root where side = 1) b using (archive) left join bad using (archive)
"""

ORACLES: dict[str, str] = {"op1_merkle_fixity": _OP1_SQL, "op2_license_scan": license_sql(DOCUMENT_PATH), "op12_dual_tree_lloyd": lloyd_sql()}
