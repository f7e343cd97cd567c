"""Operator 5, secret scans: corpus-wide ownership frequency (DataFrame functions only).

Patterns give candidates with their places. Each candidate's digest is counted
over the corpus by distinct repositories and owners. What at least ``WIDE``
owners hold is a widely copied example, and so is what two hold in at least
``WIDE_REPOSITORIES`` repositories. What fewer hold looks live, and what one
owner holds does in however many of its own repositories. Tokens
that merely look random (``key``) become findings only if they are live and lie
outside the other findings; those of the base kinds always stay.

The places of a pattern's matches follow from the lengths of the matches and
of the gaps between them, in code points, summed up within the row; no step is
quadratic in the matches of a text.

Defined results: a null text is empty; a null owner or repository counts as
one of its own; an empty table gives no rows; repeated rows are each reported,
and add no owner; columns of the input are passed on by ``scan`` only as named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common

WIDE = 3
WIDE_REPOSITORIES = 5


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kind, pattern, the value's group, and what the value must match (fixed values). Base kinds first.
KINDS = (
    ("assign", "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "^.{6,}$"),
    ("access", "AKIA[A-Z0-9]{16,}", 0, "."),
    ("hex", "[0-9a-f]{24,}", 0, "."),
    ("key", "[A-Za-z0-9+/_=-]{20,}", 0, "[A-Z].*[a-z]|[a-z].*[A-Z]"),
)
BASE = len(KINDS) - 1
SPAN = "array<struct<start:bigint,rank:int,end:bigint,digest:binary>>"


#: A string has under 2 ** 31 bytes and a match at least four, so no text has more matches than this many doublings reach.
DOUBLINGS = 29


def running(array: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with all before it, as sums or maxima are, by doubling: n log n steps in all."""

    def step(k: int) -> Callable[[Column], Column]:
        def of(a: Column) -> Column:
            return F.when(F.size(a) > 1 << k, F.transform(a, lambda x, i: F.when(i < 1 << k, x).otherwise(join(x, F.get(a, i - (1 << k)))))).otherwise(a)

        return of

    for k in range(DOUBLINGS):
        array = F.transform(F.array(array), step(k))[0]  # bound to a variable, so that it is made once
    return array


def spans_of(text: Column, rank: int) -> Column:
    """The matches of one kind as an array of (start, rank, end, digest of the value), in order."""
    _, pattern, group, must = KINDS[rank]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    lengths = F.transform(parts, lambda p: (F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("bigint"))
    placed = F.arrays_zip(running(lengths, lambda x, y: x + y).alias("end"), hits.alias("hit"))

    def span(p: Column) -> Column:
        value = F.regexp_extract(p["hit"], pattern, group) if group else p["hit"]
        good = value.rlike(must) & (value.rlike("[0-9].*[0-9]") if rank == BASE else F.lit(True))
        return F.when(good, F.struct((p["end"] - F.length(p["hit"])).cast("bigint").alias("start"), F.lit(rank).alias("rank"), p["end"].cast("bigint").alias("end"), F.unhex(F.md5(value.cast("binary"))).alias("digest")))

    found = F.filter(F.transform(F.filter(placed, lambda p: p["hit"].isNotNull()), span), lambda x: x.isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(SPAN)


def below(places: Column, limits: Column, or_equal: bool) -> Column:
    """For each of ``limits``, which are in order, how many of ``places`` are below it (or equal to it)."""
    first, second = (0, 1) if or_equal else (1, 0)
    event = lambda at, place, counts: F.struct(at.alias("at"), F.lit(place).alias("place"), F.lit(counts).cast("bigint").alias("n"))
    events = F.array_sort(F.concat(F.transform(places, lambda x: event(x, first, 1)), F.transform(limits, lambda x: event(x, second, 0))))

    def of(e: Column) -> Column:
        counts = F.arrays_zip(e.getField("n").alias("n"), running(e.getField("n"), lambda x, y: x + y).alias("sum"))
        return F.filter(counts, lambda x: x["n"] == 0).getField("sum")

    return F.transform(F.array(events), of)[0]


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. As many others begin before such a span's end as end at its start or before."""
    begun = below(others.getField("start"), spans.getField("end"), False)
    ended = below(others.getField("end"), spans.getField("start"), True)
    both = F.arrays_zip(spans.alias("span"), begun.alias("begun"), ended.alias("ended"))
    alone = F.filter(both, lambda x: x["begun"] == x["ended"]).getField("span")
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), alone).otherwise(spans)


def scan(docs: DataFrame, owner: Column, repository: Column, *extra: str) -> DataFrame:
    """Per row an id, owner, repository and all candidate spans, written once."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*extra, owner.alias("owner"), repository.alias("repository"), *(spans_of(text, r).alias(f"s{r}") for r in range(len(KINDS))))
    base = F.concat(*(F.col(f"s{r}") for r in range(BASE)))
    found = found.withColumn("base", F.array_sort(base)).withColumn("more", apart_from(F.col(f"s{BASE}"), F.col("base")))
    return common.materialize(found.select(F.monotonically_increasing_id().alias("rid"), *extra, "owner", "repository", "base", "more"), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """(digest, n_repositories, n_owners, wide) for every candidate; counted in two steps, so that a common one is no hot group."""
    held = scanned.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s")).select("owner", "repository", "s.digest")
    null = F.lit("\0")
    by_owner = held.select("digest", F.coalesce("owner", null).alias("owner"), F.coalesce("repository", null).alias("repository")).distinct().groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners")).withColumn("wide", (F.col("n_owners") >= WIDE) | (F.col("n_owners") >= 2) & (F.col("n_repositories") >= WIDE_REPOSITORIES))


def findings(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``spans`` (base and live ``key`` spans in order), n_live and n_example (values by ownership)."""
    each = scanned.select("rid", F.explode(F.concat("base", "more")).alias("s")).select("rid", "s", "s.digest")
    # Written first: a join of two plain exchanges is one that adaptive execution splits where a value is hot.
    judged = each.join(common.materialize(ownership(scanned).select("digest", "wide"), "owners"), "digest")
    stays = (F.col("s.rank") < BASE) | ~F.col("wide")
    by_row = judged.where(stays).groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("spans"), F.sum((~F.col("wide")).cast("long")).alias("n_live"), F.sum(F.col("wide").cast("long")).alias("n_example"))
    out = scanned.join(by_row, "rid", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"spans": F.coalesce("spans", F.array().cast(SPAN)), "n_live": F.coalesce("n_live", zero), "n_example": F.coalesce("n_example", zero)})


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    scanned = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"), "doc_id")

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank][0]}")

    return findings(scanned).select("doc_id", *map(count, range(BASE)), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), "n_live", "n_example")


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(common.read(spark, sf_dir, "documents"))


def redact(text: Column, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by ``mark``."""
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def replaced(chars: Column) -> Column:
        def of(ends: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                before = F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))
                gap = F.array_join(F.slice(chars, (before + 1).cast("int"), F.greatest(s["start"] - before, F.lit(0)).cast("int")), "")
                return F.when((i == 0) | (s["start"] >= before), F.concat(gap, F.lit(mark))).otherwise("")

            rest = F.array_join(F.slice(chars, (F.element_at(ends, -1) + 1).cast("int"), F.size(chars)), "")
            return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

        return F.transform(F.array(ends), of)[0]

    # An array of characters, as a place in a string is found by counting from its start.
    return F.when(F.size(spans) > 0, F.transform(F.array(F.split(text, "")), replaced)[0]).otherwise(text)


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: all documents, with every finding replaced; ``n_chars`` follows the text."""
    rows = common.packed(docs, "text", "source", "lang")
    out = findings(scan(rows, F.col("source"), F.concat_ws("/", "source", "lang"), *rows.columns)).withColumn("text", redact(F.col("text"), "spans"))
    return common.with_length(out, docs)
