"""The queries opN_<name> of this subpackage, each over the whole of its table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import bpe, sql
from tallyloom.llm.brown import score
from tallyloom.llm.centroids import cluster
from tallyloom.llm.collocations import collocations
from tallyloom.llm.decontam import find_items
from tallyloom.llm.langid import identify
from tallyloom.llm.media import media_features, store_media
from tallyloom.llm.mixing import mix
from tallyloom.llm.neardup import near_duplicates
from tallyloom.llm.pii import find_pii
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.sharding import shard_by_bytes
from tallyloom.llm.urlfilter import filter_urls
from tallyloom.llm.warc import read_records, write_archives

SHARDS = 8
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By text, declared language, source as host, and its suffix where it is an address."""
    return identify(_table(spark, sf_dir, "documents"))


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on raw pages, with the language that the markup declares, the address suffix and the host."""
    pages = _table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[#\w]+;", " ")
    rows = pages.select(F.col("page_id").alias("doc_id"), body.alias("text"), F.nullif(F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([a-z]{2,3})""", 1), F.lit("")).alias("lang"), host.alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"))
    return identify(rows, host="host", suffix="suffix").withColumnRenamed("doc_id", "page_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(_table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return read_records(index, index.archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(Scratch(spark, "media").keep(store_media(_table(spark, sf_dir, "documents")), "png"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op9_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: the path of another byte-level BPE than the public one."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer, bpe.digests, bpe.DIGESTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_brown_score": op9_brown_score,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_bpe": op13_bpe,
    "language_id_of_pages": language_id_of_pages,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": sql.NEAR_DUPLICATES,
    "op4_warc": sql.WARC,
    "op6_decontamination": sql.DECONTAMINATION,
    "op10_url_filter": sql.URL_FILTER,
    "op11_collocations": sql.COLLOCATIONS,
    "op12_centroid_clustering": sql.CENTROIDS,
}
