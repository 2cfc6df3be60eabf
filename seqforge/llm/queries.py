"""The queries of this subpackage, with production parameters over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from seqforge.llm import ann, decontam, filter_audit, lang_id, license_scan, merkle, near_dup, secret_scan, shard, sp_codec, toxicity, url_filter, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    return {
        "op1_permutation_index": lambda s, d: ann.report(_table(s, d, "embeddings")),
        "op2_warc": lambda s, d: warc.report(_table(s, d, "pages")),
        "op3_decontamination": lambda s, d: decontam.report(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op4_license_scan": lambda s, d: license_scan.report(_table(s, d, "documents")),
        "op5_near_duplicates": lambda s, d: near_dup.report(_table(s, d, "documents")),
        "op6_secret_scan": lambda s, d: secret_scan.report(_table(s, d, "documents")),
        "op7_sharding": lambda s, d: shard.shard(_table(s, d, "documents")),
        "op8_sentencepiece": lambda s, d: sp_codec.report(_table(s, d, "documents")),
        "op9_toxicity": lambda s, d: toxicity.report(_table(s, d, "documents"), _table(s, d, "labels")),
        "op10_url_filter": lambda s, d: url_filter.report(_table(s, d, "pages")),
        "op11_filter_audit": lambda s, d: filter_audit.audit(_table(s, d, "documents"), _table(s, d, "labels")),
        "op12_language_id": lambda s, d: lang_id.report(_table(s, d, "documents")),
        "op13_merkle_manifest": lambda s, d: merkle.report(_table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op3_decontamination": decontam.ORACLE_SQL,
        "op5_near_duplicates": near_dup.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
