"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import chunks, codes, divergence, extract, licenses, media, packing, pieces, quality, secrets, simhash, sql, suffixes, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nbest_pieces": pieces.op1_nbest_pieces,
        "op2_simhash_dedup": simhash.op2_simhash_dedup,
        "op3_host_rules": quality.op3_host_rules,
        "op4_url_templates": urls.op4_url_templates,
        "op5_secret_ownership": secrets.op5_secret_ownership,
        "op6_license_windows": licenses.op6_license_windows,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_radix_repeats": suffixes.op8_radix_repeats,
        "op9_media_sniff": media.op9_media_sniff,
        "op10_gear_chunks": chunks.op10_gear_chunks,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_filtering_codes": codes.op12_filtering_codes,
        "op13_tag_path_text": extract.op13_tag_path_text,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
