"""Operator 11, source divergence audit: joint count histograms.

In each language, how far is each source's use of words from each other
source's, and which words does it use more than the language as a whole? A
word's share in a group is the smoothed p of ``share``. The distance of two
sources sums f = abs(p - q) over all kept words, but f depends on the two counts
alone: so for each pair of sources the distinct (count, count) combinations are
tallied, f is evaluated once for each and multiplied by its tally. Words that
neither source has are not tallied; their number is what is left of the
vocabulary.

Words are counted in Arrow batches, summed by task before the shuffle. For the
tallies the vocabulary is dealt into buckets of about ``TERMS`` words and each
language's sources into blocks of about ``SOURCES``, so that a group has a
bounded table of words by sources whatever the number of either; what leaves it
are tallies, no pairs of words. Arithmetic is in integers and decimals, exact.

Defined results: a null text, language or source is the empty string, which is
a language or source like any other; a group whose texts have no kept words is
listed with counts of 0; in a language without kept words all distances are 0;
repeated rows each count, also as documents; of equal values the item first in
UTF-8 comes first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarn.llm import common

#: Documents of the language that a kept word is in, and the ranks of words that are reported.
LEAST = 30
TOP = 50
#: The scale of shares, and what is added to each count.
SCALE = 1_000_000_000
ADDED = 5
#: Expected words of a bucket, and sources of a block.
TERMS = 4096
SOURCES = 128
#: Entries that a task gathers before it passes them on, and bytes of text looked at at once.
HELD = 200_000
PIECE = 1 << 20

#: Bytes of words as they are, A-Z lower-cased; all other bytes become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = T.StructType([T.StructField(n, t) for n, t in (("lang", T.StringType()), ("source", T.StringType()), ("term", T.BinaryType()), ("n", T.LongType()), ("docs", T.LongType()))])
TALLY = "lang string, one string, two string, a long, b long, n long"


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``PIECE`` bytes."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """Partial sums (lang, source, term, n, docs) of ``docs`` (lang, source, text); for each group also a row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, source, term, count, docs[term]) for (lang, source), (n, docs) in held.items() for term, count in [(None, 0), *n.items()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=COUNTED.names)

        for b in batches:
            size = 0
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), common.utf8(b.column("text"))):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for part in words(text):
                    n.update(part)
                    own.update(part)
                seen.update(own)
                size += len(own)
                if size >= HELD:
                    size = 0
                    if sum(len(n) for n, _ in held.values()) >= HELD:
                        yield out()
            if sum(len(n) for n, _ in held.values()) >= HELD:
                yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, COUNTED)


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)) of three long columns, exact."""
    over = f"(cast({total} as decimal(20,0)) + {ADDED} * cast({terms} as decimal(20,0)))"
    return F.expr(f"1 + ((cast({SCALE} as decimal(10,0)) * (cast({n} as decimal(20,0)) + {ADDED})) div {over})")


def tally(table: pa.Table) -> pa.Table:
    """Tallies of the count pairs of a bucket of words, for the sources of two blocks (of one, if they are the same).

    A row without a term only says that there is this source, whose counts are 0.
    """
    table = table.combine_chunks().sort_by("source")  # so that a pair has one order in all buckets
    source, term = (table.column(c).chunk(0).dictionary_encode() for c in ("source", "term"))
    names, source, terms = source.dictionary, source.indices.to_numpy(), len(term.dictionary)
    known, term = term.is_valid().to_numpy(zero_copy_only=False), term.indices.fill_null(0).to_numpy()
    block = np.zeros(len(names), np.int64)
    block[source] = table.column("block").to_numpy()
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    counts = np.zeros((terms, len(names)), np.int64)
    np.add.at(counts, (term[known], source[known]), table.column("n").to_numpy()[known])
    values, code = np.unique(counts, return_inverse=True)
    code = code.reshape(counts.shape)
    width, found = len(values), []
    for one in np.flatnonzero(block == low) if terms else ():
        two = np.flatnonzero(block == high)
        two = two[two > one] if low == high else two
        if not len(two):
            continue
        both = (np.arange(len(two)) * width + code[:, [one]]) * width + code[:, two]
        both, n = np.unique(both, return_counts=True)
        pair, b = np.divmod(both, width)
        pair, a = np.divmod(pair, width)
        some = (values[a] > 0) | (values[b] > 0)
        found.append((np.full(some.sum(), one), two[pair[some]], values[a[some]], values[b[some]], n[some]))
    one, two, a, b, n = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
    lang = table.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(n), pa.string()), names.take(pa.array(one)), names.take(pa.array(two)), a, b, n.astype(np.int64)], names=["lang", "one", "two", "a", "b", "n"])


def distances(inside: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each pair of sources of a language.

    ``inside``: (lang, source, term, n) of kept words; ``groups``: (lang,
    source, total, terms, block, blocks, buckets).
    """
    cells = inside.join(groups.select("lang", "source", "block", "blocks", "buckets"), ["lang", "source"])
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets"))).select("lang", "source", "term", "n", "block", "blocks", "bucket")
    # Each bucket has to know all sources, also those that have none of its words.
    every = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    cells = cells.unionByName(every).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("lang", "source", "term", "n", "block", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    tallies = cells.groupBy("lang", "bucket", "low", "high").applyInArrow(tally, TALLY)
    tallies = tallies.groupBy("lang", "one", "two", "a", "b").agg(F.sum("n").alias("n"))
    for name in ("one", "two"):
        tallies = tallies.join(groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"), *(["terms"] if name == "one" else [])), ["lang", name])
    f = F.abs(share("a", "total_one", "terms") - share("b", "total_two", "terms"))
    sums = common.materialize(tallies.groupBy("lang", "one", "two").agg(F.sum(f * F.col("n")).alias("value"), F.sum("n").alias("n")), "distances")
    sums = sums.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value", "n").unionByName(sums.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value", "n"))
    left = groups.select("lang", "source", "total", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"), "block")
    pairs = left.join(right, ["lang", "block"]).where(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left")
    unseen = (F.col("terms") - F.coalesce("n", F.lit(0))) * F.abs(share("0", "total", "terms") - share("0", "item_total", "terms"))
    value = F.when(F.col("terms") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("value", F.lit(0)) + unseen)
    return pairs.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources (part ``pair``) and their words over the language's share (part ``term``)."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    cells = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = common.materialize(cells.withColumn("term", F.col("term").cast("string")), "cells")
    kept = cells.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = common.materialize(kept, "kept")
    inside = common.materialize(cells.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "inside")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    named = cells.where("term is null").select("lang", "source")
    langs = named.groupBy("lang").agg(F.count("*").alias("members")).join(langs, "lang", "left")
    ceil = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    langs = langs.select("lang", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "lang_total")), ceil(F.col("members"), sources).alias("blocks"), ceil(F.coalesce("terms", F.lit(0)), terms).alias("buckets"))
    totals = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = common.materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))), "groups")

    own = inside.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    over = share("n", "total", "terms") - share("lang_n", "lang_total", "terms")
    words_over = own.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    parts = (("pair", distances(inside, groups), None), ("term", words_over, top))
    out = None
    for part, rows, ranks in parts:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
        ranked = ranked if ranks is None else ranked.where(F.col("rank") <= ranks)
        ranked = ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.read(spark, sf_dir, "documents"))
