"""From raw documents to packed sequences.

Each stage applies one operator of ``tarn.llm`` to all that the stage before
it kept: documents that fail the quality rules or come from a failing host go;
of near-duplicates one stays; passages that occurred before are cut; secrets
are replaced; what is left is packed into sequences of token ids.

Defined results: a null or empty text fails the quality rules, so none gets
further; a null doc_id is no key, and such documents are kept like others;
repeated rows of one id and text count once from the near-duplicates on; of
ties the least doc_id, then the least digest of the text stays; an empty table
gives no rows; further columns, whatever their names, pass through all stages
but the last, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import chunks, common, packing, quality, secrets, similar

STAGES = [
    ("quality_rules", quality.filter_stage),
    ("near_duplicates", similar.dedup_stage),
    ("substrings", chunks.dedup_stage),
    ("secrets", secrets.redact_stage),
    ("packing", packing.pack_stage),
]

#: SQL has neither the fingerprints, the chunks nor the packing; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next one reads them; what it was made from is then discarded."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.tables() as made:
            out = common.materialize(stage(spark, docs, sf_dir), name)
        for used in (docs, *made):
            if used is not out:
                common.discard(used)
        docs = out
    return docs
