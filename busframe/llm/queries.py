"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busframe.llm.common import documents, shared_folder
from busframe.llm.exact_dedup import exact_dedup
from busframe.llm.license_scan import license_scan
from busframe.llm.line_dedup import line_dedup
from busframe.llm.near_dedup import near_dedup
from busframe.llm.packing import pack
from busframe.llm.pieces import piece_digests
from busframe.llm.quality import quality_rules
from busframe.llm.secret_scan import secret_scan
from busframe.llm.shards import compacted, free_name
from busframe.llm.token_counts import edited_counts, sample_edits


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir), carry=False)
    return out.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(documents(spark, sf_dir).select("doc_id", "text", sample_edits().alias("edits")))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, the shard it ends up in after compaction, and the digest of its text as read back from there."""
    docs = documents(spark, sf_dir)
    place = free_name(docs.columns, "shard")
    rows = compacted(docs, shared_folder(spark, "shards")).read(shard=place)
    return rows.select("doc_id", F.col(place).cast("long").alias("shard"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_dart_minhash, op2_pieces, op3_secrets, op4_packing, op5_quality, op6_exact, op7_token_counts, op8_shards, op9_lines, op10_licenses)}


ORACLE = {
    "op6_exact": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents),
g as (select t, min(doc_id) keep_id, count(*) group_size from d group by t)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) group_size, d.doc_id = g.keep_id kept, sha256(d.t) text_sha256
from d join g using (t)""",
    "op9_lines": r"""
with l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos, unnest(string_split(coalesce(text, ''), chr(10))) line from documents),
k as (select doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
f as (select key, max(doc_id) top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, coalesce(f.top is not null and k.doc_id <> f.top, false) gone from k left join f using (key))
select doc_id, cast(count(*) as bigint) n_lines, cast(count(*) filter (where gone) as bigint) n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) kept_sha256 from m group by doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
