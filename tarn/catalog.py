"""The library's queries over the test tables, each with DuckDB SQL for its rows.

The tables stand in for catalog relations: orders and customers for nodes and
requests, events for attempts and leases, documents for files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import evolve, graph, grouping, keys, lineage, lookup, snapshots
from tarn.operators import trees as record_trees
from tarn.plans import prune, steps
from tarn.sources import arrays, datasource, results, rows
from tarn.sources.shared import file_system, shared_dir, written
from tarn.streaming import leases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sources, sinks, memoised steps


@dataclass(frozen=True)
class Source:
    """A table of a data set, as its files are now; a change of any gives another key."""

    dataset: str
    name: str
    files: str
    folder: str = steps.unkeyed(default="")


#: How Hadoop's file statuses show themselves.
STATUS = re.compile(r"\bpath=(.*?); isDirectory=(true|false);(?: length=(\d+);)?.*? modification_time=(\d+);")


def files_digest(spark: SparkSession, path: str) -> str:
    """A digest of path, size and time of each file at ``path``; their contents are not read.

    Folders are listed through the file system, without a job. Files whose
    contents change while all three stay are taken for the same.
    """
    fs, top = file_system(spark, path)
    facts, folders = [], [top]
    while folders:
        for shown in fs.listStatus(folders.pop()):
            name, folder, size, at = STATUS.search(shown.toString()).groups()
            if folder == "true":
                folders.append(file_system(spark, name)[1])
            else:
                facts.append((name, int(size), int(at)))
    return steps.digest(sorted(facts))


def source(spark: SparkSession, sf_dir: str, name: str) -> Source:
    dataset = sf_dir.rstrip("/").rpartition("/")[2]
    return Source(dataset=dataset, name=name, files=files_digest(spark, f"{sf_dir}/{name}.parquet"), folder=sf_dir)


class OrderRevenue(steps.Step):
    lines: Source

    def build(self, spark, inputs):
        paid = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
        return table(spark, self.lines.folder, self.lines.name).groupBy("l_orderkey").agg(F.sum(paid.cast("decimal(18,4)")).alias("paid"))


class CustomersByNation(steps.Step):
    customers: Source
    nations: Source

    def build(self, spark, inputs):
        c, n = (table(spark, s.folder, s.name) for s in (self.customers, self.nations))
        return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


class RevenueByNation(steps.Step):
    orders: Source
    revenue: OrderRevenue
    customers: CustomersByNation

    def build(self, spark, inputs):
        o = table(spark, self.orders.folder, self.orders.name)
        return (
            inputs["revenue"].join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(inputs["customers"], F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("n_name").agg(F.sum("paid").cast("double").alias("revenue"))
        )


def revenue_step(spark: SparkSession, sf_dir: str) -> RevenueByNation:
    of = lambda name: source(spark, sf_dir, name)
    return RevenueByNation(orders=of("orders"), revenue=OrderRevenue(lines=of("lineitem")), customers=CustomersByNation(customers=of("customer"), nations=of("nation")))


class EventCounts(steps.Step):
    source: Source

    def build(self, spark, inputs):
        counts = table(spark, self.source.folder, self.source.name).groupBy("event_type").agg(F.count("*").alias("n"))
        return counts.select("event_type", F.when(F.col("n") >= 400, "done").otherwise("missing").alias("state"), "n")


class EventCountsSeeded(steps.Step):
    source: Source
    least: int

    migrations = (evolve.Moved("EventCountsSeeded", was="EventCounts"), evolve.Added("least", 400))

    def build(self, spark, inputs):
        raise NotImplementedError("only the older form can be built")


@dataclass(frozen=True)
class Span:
    days: int


@dataclass(frozen=True)
class SpanFrom:
    """``Span`` with a field that it did not have."""

    days: int
    first: int

    migrations = (evolve.Moved("SpanFrom", was="Span"), evolve.Added("first", 0))


class UsersBySpan(steps.Step):
    source: Source
    span: Span

    def build(self, spark, inputs):
        start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (86400 * self.span.days)) * 86400 * self.span.days)
        return table(spark, self.source.folder, self.source.name).groupBy(start.cast("timestamp_ntz").alias("start")).agg(F.count_distinct("user_id").alias("users"))


class UsersBySpanFrom(steps.Step):
    source: Source
    span: SpanFrom

    migrations = (evolve.Moved("UsersBySpanFrom", was="UsersBySpan"),)

    def build(self, spark, inputs):
        raise NotImplementedError("only the older form can be built")


@steps.step
def nations_by_region(spark: SparkSession, nations: Source, least: int = 1) -> DataFrame:
    """Regions with at least so many nations, as a step written as a function."""
    return table(spark, nations.folder, nations.name).groupBy("n_regionkey").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Published(steps.Step):
    """Some columns of a table, as a result of its own."""

    source: Source
    columns: tuple

    def build(self, spark, inputs):
        return table(spark, self.source.folder, self.source.name).select(*self.columns)


def published(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table written as a result and scanned from there."""
    step = Published(source=source(spark, sf_dir, name), columns=tuple(table(spark, sf_dir, name).columns))
    return steps.materialize(spark, step, f"{shared_dir(spark)}/results")


@query("""
SELECT n_name, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    return steps.materialize(spark, revenue_step(spark, sf_dir), f"{shared_dir(spark)}/results")


@query("SELECT * FROM lineitem")
def parquet_roundtrip(spark, sf_dir):
    return published(spark, sf_dir, "lineitem")


@query("SELECT vec_id, len(embedding)::INTEGER AS dims, label FROM embeddings")
def array_leaf_roundtrip(spark, sf_dir):
    return published(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), "label")


@query("SELECT vec_id, len(embedding)::INTEGER AS dims, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings")
def array_shards_roundtrip(spark, sf_dir):
    """Vectors as one array of many shards, written and read by executors."""
    numbered = grouping.numbered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), [], "vec_id", "at")
    numbered = written(numbered, "numbered")
    folder = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}"
    arrays.save(numbered, folder, "at", "embedding", most=1 << 16)
    back = arrays.load(spark, folder, split=1 << 14)
    value = lambda i: F.element_at("value", i).cast("double")
    return back.join(numbered.select("at", "vec_id"), F.col("index") == F.col("at")).select("vec_id", F.size("value").alias("dims"), value(1).alias("first"), value(-1).alias("last"))


@query("""SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def store_pushdown(spark, sf_dir):
    """A result for each nation and each market segment, written by executors; those of nations are read back by filters that reach the reader."""
    datasource.register(spark)
    root = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    for name, by in (("nation", "n_name"), ("segment", "c_mktsegment")):
        value = F.to_json(F.struct(F.col(by).alias("of"), F.struct(F.count("*").alias("customers"), F.max("c_custkey").alias("last")).alias("counts")))
        made = c.groupBy(by).agg(value.alias("value")).select(F.lit(name).alias("name"), F.lit("v1").alias("schema"), keys.content_key(by).alias("key"), "value")
        made.write.format("tarn").mode("append").save(root)
    found = spark.read.format("tarn").load(root).where("name = 'nation' and leaf in ('of', 'counts/customers')")
    of = lambda leaf: F.max(F.when(F.col("leaf") == leaf, F.col("value")))
    return found.groupBy("key").agg(F.trim(of("of"), F.lit('"')).alias("n_name"), of("counts/customers").cast("long").alias("customers")).drop("key")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def result_tree_roundtrip(spark, sf_dir):
    """A result with a scalar, a list and a table, published and loaded."""
    path = f"{shared_dir(spark)}/results/tree/{sf_dir.rstrip('/').rpartition('/')[2]}-{files_digest(spark, f'{sf_dir}/nation.parquet')[:20]}"
    if results.read_manifest(spark, path) is None:
        results.publish(spark, {"scale": 1, "tables": [table(spark, sf_dir, "nation")]}, path)
    return results.load(spark, path)["tables"][0].groupBy("n_regionkey").agg(F.count("*").alias("n"))


# Keys

ORDER_JSON = """'{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}'"""


@query(f"SELECT o_orderkey, substr(sha256({ORDER_JSON}), 1, 20) AS content_key FROM orders")
def content_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.content_key("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("content_key"))


@query("SELECT count(DISTINCT (o_custkey, o_orderstatus)) AS n_keys FROM orders")
def key_skip_columns(spark, sf_dir):
    key = keys.content_key("o_orderkey", "o_custkey", "o_orderstatus", skip=("o_orderkey",))
    return table(spark, sf_dir, "orders").select(key.alias("k")).agg(F.count_distinct("k").alias("n_keys"))


@query(f"SELECT o_orderkey, 'order:' || substr(sha256('v1'), 1, 20) || ':' || substr(sha256({ORDER_JSON}), 1, 20) AS object_id, 'order:' || substr(substr(sha256('v1'), 1, 20), 1, 5) || ':' || substr(substr(sha256({ORDER_JSON}), 1, 20), 1, 5) AS label FROM orders")
def object_ids(spark, sf_dir):
    value = keys.content_key("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    schema = keys.digest(F.lit("v1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.object_id(F.lit("order"), schema, value).alias("object_id"), text.short_label(F.lit("order"), schema, value).alias("label"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0")
def key_verification(spark, sf_dir):
    """Stored keys, of which every seventh is wrong; the check finds those."""
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    stored = table(spark, sf_dir, "customer").select(*columns, F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(keys.content_key(*columns)).alias("key"))
    return keys.mismatched(stored, columns, "key").select("c_custkey")


@query("SELECT conv_id, list_sort(list_distinct(list(role))) AS roles FROM conversations GROUP BY conv_id")
def set_canonical_order(spark, sf_dir):
    gathered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return gathered.select("conv_id", keys.ordered_set("r").alias("roles"))


@query("SELECT o_custkey, substr(sha256(string_agg(DISTINCT o_orderstatus, chr(10) ORDER BY o_orderstatus)), 1, 20) AS group_key FROM orders GROUP BY o_custkey")
def executor_key(spark, sf_dir):
    return keys.group_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "group_key")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events")
def variant_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"), "value")


# Look-ups


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'hit' ELSE 'miss' END AS found FROM documents""")
def hit_miss_split(spark, sf_dir):
    return lookup.hit_or_miss(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_requests(spark, sf_dir):
    return lookup.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels)")
def late_hits(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    misses = lookup.missing(table(spark, sf_dir, "documents").select("doc_id"), labels.where("quality = 1"), "doc_id")
    return lookup.late_hits(misses, labels, "doc_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority LIKE '1%' THEN 'done' WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'running'
WHEN o_totalprice > 100000 THEN 'failed' ELSE 'missing' END AS status FROM orders""")
def status_precedence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = lookup.status(F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000), F.col("o_totalprice") > 100000)
    return o.select("o_orderkey", found.alias("status"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 10 SECONDS <= TIMESTAMP '2024-01-05 00:00:00'")
def stale_leases(spark, sf_dir):
    now = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(lookup.stale("ts", now)).select("event_id")


WORKERS = [("small", 10, 2), ("middle", 25, 4), ("large", 50, 5)]


@query("""SELECT worker, count(*) AS n_jobs FROM part JOIN (VALUES ('small', 10, 2), ('middle', 25, 4), ('large', 50, 5)) AS w(worker, size, cpus)
ON (p_size <= size) AND (cpus >= CAST(substr(p_brand, 7, 1) AS INTEGER)) GROUP BY worker""")
def lease_eligibility(spark, sf_dir):
    jobs = table(spark, sf_dir, "part").select(F.col("p_size").alias("low"), F.lit(None).cast("int").alias("high"), F.substring("p_brand", 7, 1).cast("int").alias("cpu_low"))
    workers = spark.createDataFrame(WORKERS, "worker string, size int, cpus int")
    fits = lookup.eligible(jobs, workers, {"size": ("low", "high"), "cpus": ("cpu_low", "high")}, ["low", "high", "cpu_low"])
    return fits.groupBy("worker").agg(F.sum("jobs").alias("n_jobs"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey")
def ready_nodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    open_ = o.where("o_totalprice > 450000").select("o_orderkey")
    return lookup.ready(table(spark, sf_dir, "customer").select("c_custkey"), o, open_, "c_custkey", "o_custkey", "o_orderkey")


@query("""SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
GROUP BY ALL HAVING bool_and(b.role = 'user')""")
def release_dependents(spark, sf_dir):
    """A turn waits for the one before it; user turns are completed."""
    turns = table(spark, sf_dir, "conversations")
    edges = turns.select("conv_id", "turn", F.col("conv_id").alias("c_conv"), (F.col("turn") - 1).alias("c_turn"))
    there = turns.select(F.col("conv_id").alias("c_conv"), F.col("turn").alias("c_turn"), "role")
    edges = edges.join(there.select("c_conv", "c_turn"), ["c_conv", "c_turn"], "left_semi")
    open_ = there.where("role <> 'user'").select("c_conv", "c_turn").distinct()
    completed = there.select("c_conv", "c_turn").distinct().join(open_, ["c_conv", "c_turn"], "left_anti")
    return lookup.released(edges, completed, ["conv_id", "turn"], ["c_conv", "c_turn"])


@query("""SELECT user_id, min(ts) AS taken, max(ts) AS last_beat, count(*) AS beats FROM
(SELECT *, count(*) FILTER (first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lease FROM
(SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 21610 SECONDS, true) AS first FROM events)) GROUP BY user_id, lease""")
def lease_sessions(spark, sf_dir):
    """Events as heartbeats of their users' leases of six hours."""
    return leases.leases(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", lifetime=21600)


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(DISTINCT event_id) AS attempts FROM events GROUP BY ALL")
def attempts_by_day(spark, sf_dir):
    return leases.attempts(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", "1 day")


@query("""SELECT event_type, CASE WHEN n >= 400 THEN 'done' ELSE 'missing' END AS state, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def reuse_across_forms(spark, sf_dir):
    """A step whose class gained a field: results of its older form are linked, not built anew."""
    root = f"{shared_dir(spark)}/results"
    events = source(spark, sf_dir, "events")
    steps.materialize(spark, EventCounts(source=events), root)
    return steps.materialize(spark, EventCountsSeeded(source=events, least=400), root)


@query("SELECT event_type, CASE WHEN n >= 400 THEN 'done' ELSE 'missing' END AS state, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)")
def step_restored(spark, sf_dir):
    """A step rebuilt from the record beside its result, with name, schema and values checked; it finds that result."""
    root, step = f"{shared_dir(spark)}/results", EventCounts(source=source(spark, sf_dir, "events"))
    steps.materialize(spark, step, root)
    again = steps.restored_from(spark, steps.path_of(root, step))
    if again != step:
        raise AssertionError(f"{again} is not {step}")
    return steps.load_existing(spark, [again], root)[0]


@query("SELECT time_bucket(INTERVAL 2 DAYS, ts, TIMESTAMP '1970-01-01') AS start, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def reuse_within(spark, sf_dir):
    """A record within a step's parameters gained a field: the step's older result is found by its record in the present form."""
    root, events = f"{shared_dir(spark)}/results", source(spark, sf_dir, "events")
    steps.materialize(spark, UsersBySpan(source=events, span=Span(days=2)), root)
    return steps.materialize(spark, UsersBySpanFrom(source=events, span=SpanFrom(days=2, first=0)), root)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= 2")
def function_step(spark, sf_dir):
    return steps.materialize(spark, nations_by_region(nations=source(spark, sf_dir, "nation"), least=2), f"{shared_dir(spark)}/results")


@dataclass(frozen=True)
class RegionReport:
    """A result with typed parts."""

    title: str
    regions: tuple
    tags: frozenset
    nations: results.Ref


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def typed_result_roundtrip(spark, sf_dir):
    """A record with a tuple that holds a table, a set and a part that is read when asked for, published and loaded."""
    path = f"{shared_dir(spark)}/results/report/{files_digest(spark, f'{sf_dir}/nation.parquet')[:20]}-{files_digest(spark, f'{sf_dir}/region.parquet')[:20]}"
    if results.read_manifest(spark, path) is None:
        report = RegionReport("regions", (1, table(spark, sf_dir, "region")), frozenset({"b", "a"}), results.ref(table(spark, sf_dir, "nation")))
        results.publish(spark, report, path)
    back = results.load(spark, path)
    if (type(back), back.title, back.regions[0], back.tags) != (RegionReport, "regions", 1, frozenset({"a", "b"})):
        raise AssertionError(back)
    return back.nations.load().join(back.regions[1], F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


# Groups, order, limits


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_first_seen(spark, sf_dir):
    return grouping.first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT sha256(text) AS content, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY ALL")
def exact_duplicate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("""SELECT user_id, chunk, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM
(SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8)::BIGINT AS chunk FROM events) GROUP BY ALL""")
def batch_chunks(spark, sf_dir):
    cut = grouping.chunks(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 8)
    return cut.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS slot FROM part QUALIFY slot <= 3")
def throttle_leases(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return grouping.at_most(p, "p_brand", [F.desc("p_retailprice"), "p_partkey"], 3).drop("p_retailprice")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def state_counts(spark, sf_dir):
    return grouping.state_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT user_id, count(*) AS attempts, count(*) <= 3 AS retry FROM events WHERE event_type = 'error' GROUP BY user_id")
def retry_budget(spark, sf_dir):
    return grouping.retries(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 3)


@query("""SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS observed
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def observed_dependencies(spark, sf_dir):
    seen = grouping.distinct_list(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority"), "observed")
    return table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("observed", F.lit("")).alias("observed"))


@query("SELECT source, sum(n_chars)::BIGINT AS total, max(n_chars) AS largest, sum(n_chars) > 100000 AS over FROM documents GROUP BY source")
def snapshot_budget(spark, sf_dir):
    return grouping.totals(table(spark, sf_dir, "documents"), "source", "n_chars", 100_000)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def snapshot_offenders(spark, sf_dir):
    return grouping.largest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("""SELECT s_nationkey, string_agg(label, ', ' ORDER BY label) AS devices FROM
(SELECT s_nationkey, 'dev' || (s_suppkey % 3) || CASE WHEN count(*) > 1 THEN ' ×' || count(*) ELSE '' END AS label FROM supplier GROUP BY s_nationkey, s_suppkey % 3) GROUP BY s_nationkey""")
def resource_rollup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("dev"), (F.col("s_suppkey") % 3).cast("string")).alias("name"))
    return grouping.counted_names(s, ["s_nationkey"], "name", "devices")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS wanted, count(*) FILTER (o_orderstatus = 'P') AS tracked, least(count(*) FILTER (o_orderstatus = 'O'), 4) - count(*) FILTER (o_orderstatus = 'P') AS change FROM orders GROUP BY o_custkey")
def worker_demand(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("wanted"), F.count_if(F.col("o_orderstatus") == "P").alias("tracked"))
    return grouping.demand(counts, "wanted", "tracked", 4)


# Rows computed once


def joined_key(t: pa.Table) -> pa.Table:
    parts = [pc.cast(t["o_custkey"], pa.string()), t["o_orderpriority"]]
    return t.select(["o_custkey", "o_orderpriority"]).append_column("label", pc.binary_join_element_wise(*parts, ":"))


@query("""SELECT o_orderkey, o_custkey || ':' || o_orderpriority AS label,
CASE WHEN (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 2 END AS created FROM orders""")
def rows_created_once(spark, sf_dir):
    """Finished orders are asked for first, then all: the second request computes only what the first left, by customer in groups of at most 64."""
    schema = "o_custkey long, o_orderpriority string, label string"
    store = rows.create(spark, f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}", schema, ["o_custkey", "o_orderpriority"], 16)
    orders = table(spark, sf_dir, "orders")
    store.load_or_create(orders.where("o_orderstatus = 'F'").select(*store.key), rows.batched(joined_key, schema))
    all_of = store.load_or_create(orders.select("o_orderkey", *store.key), lambda misses: rows.batched(joined_key, schema, ["o_custkey"], 64)(misses.select(*store.key, rows.HASH)))
    early = store.scan(1).select(*store.key).withColumn("created", F.lit(1))
    return all_of.join(early, store.key, "left").select("o_orderkey", "label", F.coalesce("created", F.lit(2)).alias("created"))


# Graphs

EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
roots AS (SELECT 'r' || r_regionkey AS root FROM region)"""


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    edges = n.selectExpr("'r' || n_regionkey as parent", "'n' || n_nationkey as child").unionByName(c.selectExpr("'n' || c_nationkey as parent", "'c' || c_custkey as child"))
    return r.selectExpr("'r' || r_regionkey as root"), edges


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT root, root AS node, 0 AS depth FROM roots UNION ALL SELECT root, child, depth + 1 FROM walk JOIN edges ON node = parent)
SELECT root, depth, count(*) AS n FROM walk GROUP BY root, depth""")
def dag_closure(spark, sf_dir):
    return graph.closure(*graph_tables(spark, sf_dir)).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT root, root AS node, 0 AS depth FROM roots UNION ALL SELECT root, child, depth + 1 FROM walk JOIN edges ON node = parent
WHERE child NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0)) SELECT root, depth, count(*) AS n FROM walk GROUP BY root, depth""")
def dag_closure_pruned(spark, sf_dir):
    done = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").selectExpr("'n' || n_nationkey as node")
    return graph.closure(*graph_tables(spark, sf_dir), done).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query("SELECT 'r' || r_regionkey AS node FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 3) UNION SELECT 'n3' UNION SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 3")
def dag_cycles(spark, sf_dir):
    """The graph with edges from the customers of nation 3 back to it: they, it and what leads to it."""
    _, edges = graph_tables(spark, sf_dir)
    back = table(spark, sf_dir, "customer").where("c_nationkey = 3").selectExpr("'c' || c_custkey as parent", "'n3' as child")
    return graph.leading_to_cycles(edges.unionByName(back))


@query(f"""WITH RECURSIVE {EDGES}, kept AS (SELECT 'r' || r_regionkey AS node FROM region WHERE r_name IN ('ASIA', 'EUROPE') UNION SELECT child FROM kept JOIN edges ON node = parent),
nodes AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges) SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM kept)""")
def unreachable_results(spark, sf_dir):
    """What a sweep that keeps two regions and all that they lead to would delete."""
    _, edges = graph_tables(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    keep = table(spark, sf_dir, "region").where("r_name in ('ASIA', 'EUROPE')").selectExpr("'r' || r_regionkey as node")
    return prune.unreachable(nodes, edges, keep)


PARTS = """edges AS (SELECT p_partkey AS parent, p_size::BIGINT * 31 AS child, p_brand FROM part UNION SELECT p_partkey, p_partkey // 2, p_brand FROM part WHERE p_retailprice > 1500)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles: each part leads to one by its size, and dear ones to the one of half their number."""
    p = table(spark, sf_dir, "part")
    by_size = p.selectExpr("p_partkey as parent", "cast(p_size as bigint) * 31 as child", "p_brand")
    return by_size.unionByName(p.where("p_retailprice > 1500").selectExpr("p_partkey as parent", "p_partkey div 2 as child", "p_brand"))


@query(f"""WITH RECURSIVE {PARTS}, nodes AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges),
walk AS (SELECT parent AS a, child AS b FROM edges UNION SELECT a, child FROM walk JOIN edges ON b = parent)
SELECT node, least(node, coalesce(min(x.b), node)) AS component, count(x.b) > 0 AS cyclic
FROM nodes LEFT JOIN (SELECT v.a, v.b FROM walk v JOIN walk w ON v.a = w.b AND v.b = w.a) x ON x.a = node GROUP BY node""")
def dag_components(spark, sf_dir):
    return graph.components(part_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {PARTS}, now AS (SELECT parent, child FROM edges WHERE p_brand <> 'Brand#11' UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_brand = 'Brand#22'),
walk AS (SELECT parent AS a, child AS b FROM now UNION SELECT a, child FROM walk JOIN now ON b = parent)
SELECT a AS parent, count(*) AS n, sum(b)::BIGINT AS total FROM walk GROUP BY a""")
def closure_updated(spark, sf_dir):
    """All pairs of the graph of parts, brought up to date as one brand's edges go and another's come."""
    edges = part_edges(spark, sf_dir)
    before = edges.select("parent", "child")
    stays = edges.where("p_brand <> 'Brand#11'").select("parent", "child")
    gone = written(before.join(stays, ["parent", "child"], "left_anti"), "gone")
    come = table(spark, sf_dir, "part").where("p_brand = 'Brand#22'").selectExpr("p_partkey as parent", "p_partkey + 1 as child")
    pairs = graph.updated(graph.reachable(before), before, come, gone)
    return pairs.groupBy("parent").agg(F.count("*").alias("n"), F.sum("child").alias("total"))


# Schema evolution


@query("SELECT o_orderkey, o_custkey AS customer, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice, 0 AS seed FROM orders")
def migrate_rename_add(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return evolve.migrate(old, [evolve.Renamed("o_custkey", "customer"), evolve.Retyped("o_totalprice", "decimal(18,2)"), evolve.Added("seed", 0)]).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("SELECT p_partkey, upper(p_brand) AS p_brand, p_size * 2 AS p_size, 'Item' AS class_name FROM part")
def migrate_rewrite_move(spark, sf_dir):
    old = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.lit("Part").alias("class_name"))
    return evolve.migrate(old, [evolve.Rewritten(lambda: {"p_brand": F.upper("p_brand"), "p_size": F.col("p_size") * 2}), evolve.Moved("Item")])


@query("SELECT conv_id, turn, length(text) AS length, role AS who FROM conversations")
def migrate_nested(spark, sf_dir):
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.struct(F.col("role").alias("speaker"), F.length("text").cast("long").alias("length"))).alias("parts"))
    return evolve.migrate(old, [evolve.Nested("parts", "speaker", "who")]).selectExpr("conv_id", "turn", "parts[0].length as length", "parts[0].who as who")


TURN, BODY, TALLY = ([evolve.Renamed("role", "who"), evolve.Added("seed", 7)], [evolve.Retyped("size", "long"), evolve.Rewritten(lambda f: {"size": f["size"] * 2})], [evolve.Renamed("n", "total")])


@query("""SELECT conv_id, turn, role AS who, 7 AS seed, length(text)::BIGINT * 2 AS size, count(*) OVER (PARTITION BY conv_id, role) AS total FROM conversations""")
def migrate_cascade(spark, sf_dir):
    """Records in arrays of records and in maps, each class with changes of its own."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    tally = c.groupBy("conv_id", "role").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("n")))).alias("tally"))
    body = F.struct("size").alias("body", metadata=evolve.of_class("Body"))
    turns = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", body)).alias("turns")).join(tally, "conv_id")
    tagged = turns.select("conv_id", F.col("turns").alias("turns", metadata=evolve.of_class("Turn")), F.col("tally").alias("tally", metadata=evolve.of_class("Tally")))
    new = evolve.Cascade({"Turn": TURN, "Body": BODY, "Tally": TALLY}).apply(tagged)
    flat = new.select("conv_id", "tally", F.explode("turns").alias("t"))
    return flat.select("conv_id", "t.turn", "t.who", "t.seed", "t.body.size", F.element_at("tally", F.col("t.who"))["total"].alias("total"))


@query("""WITH t AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations)
SELECT conv_id, 'turns/' || i || '/n' AS path, '~' AS change, n::VARCHAR AS old, (n + 1)::VARCHAR AS new FROM t WHERE role = 'user'
UNION ALL SELECT DISTINCT conv_id, 'meta', '+', NULL, '{"count":' || k || '}' FROM t""")
def deep_differences(spark, sf_dir):
    """Conversations as trees, before and after users' numbers change and a part is added."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))

    def trees(n: Column, *more: Column) -> DataFrame:
        turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", n.alias("n")))), lambda t: F.struct(t["role"].alias("role"), t["n"].alias("n")))
        return c.groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"), *more)).alias("tree"))

    after = trees(F.when(F.col("role") == "user", F.col("n") + 1).otherwise(F.col("n")), F.struct(F.count("*").alias("count")).alias("meta"))
    return record_trees.differences(trees(F.col("n")), after, ["conv_id"], "tree")


@query("""SELECT c_custkey, -g AS generation, name AS source FROM (SELECT o_custkey, min((-CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_orderkey)) AS m, m[1] AS g, m[2] AS name FROM orders GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey""")
def migrate_match(spark, sf_dir):
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.substring("o_orderpriority", 1, 1).cast("int").alias("generation"), "o_orderkey")
    return evolve.newest_match(table(spark, sf_dir, "customer").select("c_custkey"), sources, ["c_custkey"], "generation", "o_orderkey").select("c_custkey", "generation", "source")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def orphaned_schemas(spark, sf_dir):
    stored = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("schema"))
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("schema")).distinct().withColumn("generation", F.lit(0))
    return evolve.classify(stored, known, 0, 0).where("state = 'orphaned'").select(F.col("schema").alias("n_nationkey"))


@query("""SELECT p_partkey, CASE WHEN p_size = 50 THEN 'current' WHEN p_size >= 25 AND p_size <= 48 THEN 'covered' WHEN p_size <= 48 THEN 'superseded' ELSE 'orphaned' END AS state FROM part""")
def supersede_breaking(spark, sf_dir):
    steps_ = [evolve.Added(f"f{i}", breaking=i in (10, 24)) for i in range(50)]
    stored = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("schema"))
    generations = spark.range(51).where("id <> 49").select(F.col("id").cast("int").alias("schema"), F.col("id").cast("int").alias("generation"))
    return evolve.classify(stored, generations, 50, evolve.reusable_from(steps_)).select("p_partkey", "state")


@query("SELECT c_custkey AS current, c_custkey % 16 AS source FROM customer WHERE c_custkey >= 16")
def result_links(spark, sf_dir):
    """Each key links to the one 16 below it; chains end below 16."""
    links = table(spark, sf_dir, "customer").where("c_custkey >= 16").select(F.col("c_custkey").alias("current"), (F.col("c_custkey") - 16).alias("source"))
    return evolve.final_links(links)


@query("""WITH b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer),
f AS (SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS field, unnest([c_name, c_mktsegment]) AS old FROM customer WHERE c_custkey % 11 <> 0),
g AS (SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS field, unnest([c_name, c_mktsegment]) AS new FROM b WHERE c_custkey % 13 <> 0)
SELECT c_custkey, field, old, new, CASE WHEN f.c_custkey IS NULL THEN '+' WHEN g.c_custkey IS NULL THEN '-' ELSE '~' END AS change
FROM f FULL JOIN g USING (c_custkey, field) WHERE f.c_custkey IS NULL OR g.c_custkey IS NULL OR old IS DISTINCT FROM new""")
def field_diff(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    new = old.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment"))).where("c_custkey % 13 <> 0")
    long = [evolve.fields(df, "c_custkey", ["c_name", "c_mktsegment"]) for df in (old.where("c_custkey % 11 <> 0"), new)]
    return evolve.field_diff(*long, ["c_custkey", "field"])


# Lineage


@query("SELECT o_orderkey, o_custkey, n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def provenance_merge(spark, sf_dir):
    submitted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), "o_custkey")
    executed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("n_lines"))
    return lineage.merged(submitted, executed, "job").select(F.col("job").alias("o_orderkey"), "submitted.o_custkey", "executed.n_lines")


@query("""WITH d AS (SELECT DISTINCT source, sha256(doc_id || chr(10) || sha256(text)) AS d FROM documents)
SELECT source, substr(sha256(concat_ws('-', sum(('0x' || substr(d, 1, 12))::BIGINT), sum(('0x' || substr(d, 13, 12))::BIGINT), sum(('0x' || substr(d, 25, 12))::BIGINT), sum(('0x' || substr(d, 37, 12))::BIGINT))), 1, 20) AS snapshot_id FROM d GROUP BY source""")
def snapshot_ids(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    return lineage.snapshot_ids(files, "source", "path", "hash")


@query("""WITH d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text, lang, source FROM documents)
SELECT path, CASE WHEN source = 'src3' THEN '-' ELSE '~' END AS change FROM d WHERE source = 'src3' OR lang = 'de' AND text || '.' <> text
UNION ALL SELECT 'labels/' || doc_id, '+' FROM labels""")
def snapshot_changes(spark, sf_dir):
    """Documents as files of a folder: one source is removed, one language's texts change, labels come."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "lang", "source", "text")
    changed = d.where("source <> 'src3'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")))
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("labels/"), "doc_id").alias("path"), F.to_json(F.struct("quality", "toxic")).alias("text"))
    trees = [snapshots.tree(f.select("path", F.octet_length("text").alias("size"), snapshots.blob_hash("text").alias("hash"))) for f in (d, changed.select("path", "text").unionByName(labels))]
    return snapshots.changed(*trees).select("path", "change")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'dirty' WHEN a.n_chars = b.n THEN 'clean' ELSE 'dirty' END AS state
FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN -1 ELSE n_chars END AS n FROM documents WHERE doc_id % 10 <> 3) b ON a.doc_id = b.doc_id""")
def worktree_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    tree = docs.where("doc_id % 10 <> 3").withColumn("n_chars", F.when(F.col("doc_id") % 10 == 2, -1).otherwise(F.col("n_chars")))
    return lineage.worktree_split(docs.where("doc_id % 10 <> 1"), tree, "doc_id", "n_chars")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'queued' WHEN bad = 1 THEN 'failed' WHEN bad = 0 THEN 'finished' ELSE 'lost' END AS job_state
FROM orders LEFT JOIN (SELECT l_orderkey, max((l_linestatus <> 'F')::INT) AS bad FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def job_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    done = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("FAILED").alias("state"))
    return lineage.reconcile(o.select("o_orderkey"), o.where("o_orderstatus = 'P'"), done, "o_orderkey")


# Scalar functions


@query("""WITH v AS (SELECT event_id, value, CAST(value AS DECIMAL(18,6)) AS v, floor(CAST(value AS DECIMAL(18,6)))::BIGINT AS w FROM events)
SELECT event_id, CASE WHEN value < 1 THEN round(v * 1000)::BIGINT || 'ms' WHEN value < 60 THEN CAST(round(v, 1) AS DECIMAL(18,1)) || 's'
ELSE (w // 60) || 'm' || lpad((w % 60)::VARCHAR, 2, '0') || 's' END AS shown FROM v""")
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.format_duration(F.col("value")).alias("shown"))


@query(r"""SELECT doc_id, md5(CASE WHEN text = '' OR regexp_matches(text, '[\x00-\x20"=\\\x{7f}-\x{9f}]') THEN '"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' ELSE text END) AS shown FROM documents""")
def logfmt_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.logfmt_value(F.col("text")).cast("binary")).alias("shown"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 11 THEN p_name ELSE substr(p_name, 1, 5) || '…' || right(p_name, 5) END AS shown FROM part")
def elide_middle(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.elide(F.col("p_name"), 11).alias("shown"))


@query("SELECT conv_id, turn, lpad(turn::VARCHAR, greatest(length(n::VARCHAR), length(turn::VARCHAR))::INTEGER, '0') AS segment, CASE WHEN turn = 0 THEN '<root>' ELSE role || '/' || turn END AS path FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def value_paths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c = c.join(c.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    parts = F.when(F.col("turn") == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("role"), F.col("turn").cast("string")))
    size = F.greatest(F.col("n"), F.col("turn"))
    return c.select("conv_id", "turn", text.padded_index(F.col("turn"), size).alias("segment"), text.shown_path(parts).alias("path"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'CANCELLED' ELSE 'PENDING' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 64 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 8 * 2 ELSE -1 END AS memory FROM orders")
def batch_states(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    raw = F.when(F.col("o_orderstatus") == "F", "COMPLETED+").when(F.col("o_orderstatus") == "O", "CANCELLED by 7").otherwise(" PENDING")
    node, cpu = F.when(k % 3 == 0, F.lit(64).cast("long")), F.when(k % 3 == 1, F.lit(2).cast("long"))
    none = F.lit(None).cast("long")
    return o.select("o_orderkey", text.job_state(raw).alias("state"), F.coalesce(text.memory_gib(node, cpu, k % 8, none, none), F.lit(-1)).alias("memory"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
