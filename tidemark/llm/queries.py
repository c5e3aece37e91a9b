"""The registered queries of this subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, chosen_path, decontaminate, html_text, language_id, license_scan, merkle, neighbours, personal_data, pieces, quality, repair, secret_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digests(personal_data.find(_table(spark, sf_dir, "documents")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_conflict(_table(spark, sf_dir, "conversations"))))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(_table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(_table(spark, sf_dir, "documents")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_html_text, op2_personal_data, op3_ngram_join, op4_decontaminate, op5_quality, op6_chat_format, op7_neighbours, op8_pieces, op9_language_id, op10_license_scan,
            op11_merkle_manifest, op12_secret_scan, op13_structure_repair,
        )
    }


#: The main text of pages as the tables have them: what one article element holds; an ampersand's reference may lack its semicolon.
_OP1 = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
        regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
      FROM pages)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_html_text": _OP1, "op4_decontaminate": decontaminate.ORACLE_SQL, "op6_chat_format": chat.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op13_structure_repair": repair.ORACLE_SQL}
