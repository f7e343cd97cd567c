"""Lineage: provenance halves, snapshots of files, and reconciling tracked jobs.

``file_hashes`` reads whole files, of up to 2 GB each, as Spark's binary source does.
"""

from __future__ import annotations

import getpass
import hashlib
import os
import platform
import subprocess
import sys
from datetime import UTC, datetime
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def git_facts() -> dict[str, object]:
    """Commit, branch and whether there are changes, of the working folder; empty without a repository."""

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    commit = git("rev-parse", "HEAD")
    return {"commit": commit, "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(git("status", "--porcelain"))} if commit else {}


#: Files that pin what a project runs with.
MANIFESTS = ("pyproject.toml", "requirements.txt", "uv.lock", "poetry.lock", "environment.yml")


@cache
def project_facts() -> dict[str, object]:
    """The nearest folder from the working folder up that has one of ``MANIFESTS``, with their digests; empty if there is none."""
    here = Path.cwd()
    for folder in (here, *here.parents):
        if found := {name: hashlib.sha256((folder / name).read_bytes()).hexdigest() for name in MANIFESTS if (folder / name).is_file()}:
            return {"folder": str(folder), "files": found}
    return {}


def submitted_facts(spark: SparkSession) -> dict[str, object]:
    """Who asked for a result, from where, and with what code: the driver's half of its provenance."""
    return {"user": getpass.getuser(), "host": platform.node(), "folder": os.getcwd(), "command": sys.argv, "python": platform.python_version(), "at": datetime.now(UTC).isoformat(), "git": git_facts(), "project": project_facts()}


def executed_facts(spark: SparkSession) -> dict[str, object]:
    """What computed it: Spark's half."""
    context = spark.sparkContext
    return {"spark": spark.version, "application": context.applicationId, "master": context.master, "parallelism": context.defaultParallelism, "at": datetime.now(UTC).isoformat()}


def environment_facts(spark: SparkSession) -> dict[str, object]:
    """Both halves in one record."""
    return executed_facts(spark) | submitted_facts(spark)


def merged(submitted: DataFrame, executed: DataFrame, key: str) -> DataFrame:
    """The two halves of each job's provenance, as structs."""
    a = submitted.select(key, F.struct(*(c for c in submitted.columns if c != key)).alias("submitted"))
    b = executed.select(key, F.struct(*(c for c in executed.columns if c != key)).alias("executed"))
    return a.join(b, key)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, hash) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def snapshot_ids(files: DataFrame, by: str, path: str, content_hash: str) -> DataFrame:
    """One id per group of files, from their paths and hashes in any order.

    Each file's digest is summed over four parts, so that nothing is gathered;
    repeated rows of a file count once.
    """
    each = files.select(by, F.sha2(F.concat_ws("\n", path, content_hash), 256).alias("_d")).distinct()
    parts = [F.sum(F.conv(F.substring("_d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"_p{i}") for i in range(4)]
    return each.groupBy(by).agg(*parts).select(by, F.substring(F.sha2(F.concat_ws("-", *(F.col(f"_p{i}").cast("string") for i in range(4))), 256), 1, 20).alias("snapshot_id"))


def worktree_split(index: DataFrame, tree: DataFrame, key: str, content: str) -> DataFrame:
    """Files as ``clean`` (equal to the index), ``dirty`` (changed or untracked) or ``deleted``."""
    a = index.select(key, F.col(content).alias("indexed"), F.lit(True).alias("_i"))
    b = tree.select(key, F.col(content).alias("present"), F.lit(True).alias("_t"))
    state = F.when(F.col("_t").isNull(), "deleted").when(F.col("_i").isNull(), "dirty").when(F.col("indexed").eqNullSafe(F.col("present")), "clean").otherwise("dirty")
    return a.join(b, key, "full").select(key, state.alias("state"))


def reconcile(tracked: DataFrame, queued: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Tracked jobs as ``queued``, ``failed`` or ``finished`` by what the records say, or ``lost`` if they say nothing."""
    q = queued.select(key).distinct().withColumn("_q", F.lit(True))
    f = finished.groupBy(key).agg(F.max((F.col("state") != "COMPLETED").cast("int")).alias("_failed"))
    state = F.when(F.col("_q"), "queued").when(F.col("_failed") == 1, "failed").when(F.col("_failed") == 0, "finished").otherwise("lost")
    return tracked.join(q, key, "left").join(f, key, "left").withColumn("job_state", state).drop("_q", "_failed")

