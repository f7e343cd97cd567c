"""Each stage against plain Python, on what the stage before it kept."""

import re

import corpus_pipeline
from tests.llm import test_chunks, test_quality, test_secrets, test_similar
from tests.llm.test_packing import check_packing
from tarn.llm import chunks, common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 20000").selectExpr("*", "1 as key", "2 as n_words", "'x' as `found.at`")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count(), name
    raw = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 20000").collect()}
    assert set(kept[0]) == test_quality.slow_kept([(i, r.text, r.source) for i, r in raw.items()])
    ids = list(kept[0])
    assert set(kept[1]) == {min(ids[i] for i in g) for g in test_similar.slow_groups([kept[0][i].text for i in ids])}
    want = test_chunks.slow([(i, r.text) for i, r in kept[1].items()], chunks.MIN_RUN)
    assert {i: r.text for i, r in kept[2].items()} == {i: t for i, t, _ in want}
    found = test_secrets.slow([(i, r.text, r.lang, r.source) for i, r in kept[2].items()])
    for i, *_, spans in found:
        marked = list(kept[2][i].text)
        for start, end in sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans.split(",") if s):
            marked[start:end] = ["\0"] * (end - start)
        assert re.sub("\0+", "[SECRET]", "".join(marked)) == kept[3][i].text
    assert all(r.n_chars == len(r.text) and r.key == 1 and r["found.at"] == "x" for r in kept[3].values())
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in kept[3].values()])


def test_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    rows = corpus_pipeline.run(spark, SF)
    assert [p.name.partition("-")[0] for p in tmp_path.iterdir()] == ["packing"]
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 50


def test_empty_and_null_tables(spark):
    """An empty table and one of nulls alone go through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    nulls = docs.selectExpr(*(f"cast(null as {t}) as {c}" for c, t in docs.dtypes))
    for some in (docs.limit(0), nulls):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns
            some = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == 0
