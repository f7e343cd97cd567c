"""Operator 3, quality rules: host-level verdicts.

Each document is measured on its own; rule failures are then counted by host
(the ``source`` column). A beta prior is fitted to the hosts' failure rates by
the method of moments, each host's rate is shrunk to it, and a host whose
shrunken rate is over ``HOST_LIMIT`` loses all its documents.

Defined results: a null text has no words (and so fails the base rules); a
document with a null host has no host verdict; an empty table gives no rows;
repeated rows each count and stay; clashing columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import common

MIN_WORDS = 50
HOST_LIMIT = 0.5
SALTS = 32
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The counts of ``COUNTS``. bytes.split() parts at \\x20 and \\x09-\\x0D, as the rules ask."""
    words = text.split()
    n, size = len(words), sum(map(len, words))
    # Code points in words: their bytes without UTF-8 continuation bytes.
    chars = size if text.isascii() else len(text.decode("utf-8", "replace")) - (len(text) - size)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen, last = Counter(windows), -1
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeat += i + 2 - max(i - 1, last)
                last = i + 2
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of ``COUNTS`` as long columns."""
    schema = common.with_fields(df.schema, *((c, T.LongType()) for c in COUNTS))
    keep = [f.name for f in schema.fields[: -len(COUNTS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(x) for x in common.utf8(b.column(text))]
            new = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, *COUNTS])

    return df.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def any_failed() -> Column:
    """What counts against the host: the base rules, a symbol to word ratio over 0.1, over 30 % repeated lines."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))


def host_counts(scored: DataFrame, host: str = "source") -> DataFrame:
    """Documents and failures of each host."""
    return scored.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(any_failed().cast("long")).alias("host_failed"))


def host_verdicts(hosts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``host_counts`` with the shrunken rate and the verdict.

    The prior is fitted by moments: the rates' squared distances from the mean
    of all documents, weighted by documents, less what sampling alone would
    give. If nothing is left, hosts do not differ and all have the mean rate.
    Only sums over hosts pass through the driver.
    """
    n, x = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.count("*").alias("k"), F.sum(x * x / n).alias("xx"), F.sum(n.cast("double") * n).alias("nn")).first()
    mean = total["x"] / total["n"] if total["n"] else 0.0
    spread = mean * (1 - mean)
    unlike = total["n"] - total["nn"] / total["n"] if total["n"] else 0.0
    between = (total["xx"] - total["x"] * mean - (total["k"] - 1) * spread) / unlike if unlike > 0 else 0.0
    if not spread or between <= 0:
        shrunk = F.lit(mean)
    else:
        strength = max(spread / between - 1, 0.0)
        shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", shrunk > limit)


def judge(scored: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``scored`` with ``base_failed``, ``host_rate`` and ``kept``. ``scored`` is read twice: pass a written table."""
    # A hot host's documents are dealt to SALTS tasks, each with a copy of the verdict.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    verdicts = host_verdicts(common.materialize(host_counts(scored, host), "hosts"), limit).select(F.col(host).alias("_host"), "host_rate", "host_rejected", salts.alias("_to"))
    scored = scored.drop("host_rate", "host_rejected", "base_failed", "kept").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    out = scored.join(verdicts, (F.col(host) == F.col("_host")) & (F.col("_salt") == F.col("_to")), "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected).drop("_host", "_to", "_salt", "host_rejected")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scored = common.materialize(measured(docs).drop("text"), "quality")
    return judge(scored).select("doc_id", *COUNTS[:5], "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that are kept, with the input's columns.

    Texts are measured twice, once to count by host and once to filter, and so
    are neither written nor shuffled; documents meet only the rejected hosts,
    a table that Spark broadcasts if its size allows.
    """
    scored = measured(docs.select("source", "text")).drop("text")
    hosts = common.materialize(host_counts(scored), "hosts")
    rejected = common.materialize(host_verdicts(hosts).where("host_rejected").select(F.col("source").alias("_host")), "rejected")
    passed = measured(common.packed(docs, "doc_id", "text", "source")).where(~base_failed())
    return common.unpacked(passed.join(rejected, F.col("source") == F.col("_host"), "left_anti"), docs.columns)
