"""The operators' queries against their SQL, and the queries' columns."""

import math

import duckdb
import pytest

from tarn.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)

    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 8) if isinstance(v, float) else v

    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got and got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


CONTRACTS = {
    "op2_simhash_dedup": "doc_id fingerprint component_id",
    "op3_host_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_url_templates": "page_id host path rule verdict",
    "op5_secret_ownership": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_best_fit_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_radix_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_media_sniff": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op11_source_divergence": "lang source part item value rank",
    "op12_filtering_codes": "vec_id code error label_error codebooks_sha256",
    "op13_tag_path_text": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(spark, name):
    types = dict(registry.queries()[name](spark, SF).dtypes)
    want = CONTRACTS[name].split()
    assert not set(want) - set(types)
    text = {"fingerprint", "host", "path", "rule", "verdict", "base_sha256", "spans", "kept_sha256", "payload_sha256", "media_sha256", "feature", "lang", "source", "part", "item", "code", "codebooks_sha256", "url", "text"}
    assert {c: types[c] for c in want} == {c: "string" if c in text else "boolean" if c in ("base_failed", "kept") else "int" if c == "rank" else "bigint" for c in want}
