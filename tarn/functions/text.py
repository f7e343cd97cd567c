"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(seconds: Column) -> Column:
    """``850ms``, ``3.2s``, ``2m05s``, ``1h05m``.

    Milliseconds and tenths are rounded half up, by the decimal value; minutes and hours are cut off.
    """
    exact = seconds.cast("decimal(18,6)")
    ms = F.round(exact * 1000).cast("long")
    tenths = F.round(exact, 1).cast("decimal(18,1)")
    whole = F.floor(exact).cast("long")
    minutes = F.floor(whole / 60)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return (
        F.when(seconds < 1, F.concat(ms.cast("string"), F.lit("ms")))
        .when(seconds < 60, F.concat(tenths.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), two(whole % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), two(minutes % 60), F.lit("m")))
    )


#: Control characters without a short escape: C0, DEL and C1.
CONTROLS = [c for c in (*range(0x20), *range(0x7F, 0xA0)) if chr(c) not in "\n\r\t"]


def logfmt_value(text: Column) -> Column:
    """A value of a log line: quoted if it is empty or holds a space, ``=``, or something escaped."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    rare = escaped
    for c in CONTROLS:
        rare = F.replace(rare, F.lit(chr(c)), F.lit(f"\\x{c:02x}"))
    shown = F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"), rare).otherwise(escaped)
    quoted = (text == "") | text.rlike(r'[\x00-\x20"=\\\x7f-\x9f]')
    return F.when(quoted, F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(text)


def elide(text: Column, most: int) -> Column:
    """Text of at most ``most`` characters: the middle becomes one ``…``."""
    if most <= 1:
        return F.substring(text, 1, most)
    head = most // 2
    tail = most - 1 - head
    ends = [F.substring(text, 1, head), F.lit("…"), *([F.right(text, F.lit(tail))] if tail else [])]
    return F.when(F.length(text) <= most, text).otherwise(F.concat(*ends))


def short_label(name: Column, schema_key: Column, value_key: Column, width: int = 5) -> Column:
    return F.concat_ws(":", name, F.substring(schema_key, 1, width), F.substring(value_key, 1, width))


def padded_index(index: Column, size: Column) -> Column:
    """The index with as many digits as the size has."""
    return F.lpad(index.cast("string"), F.length(size.cast("string")), "0")


def shown_path(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, F.lit("<root>")).otherwise(F.array_join(parts, "/"))


def job_state(text: Column) -> Column:
    """A batch system's state without what follows it: ``CANCELLED by 7`` and ``COMPLETED+`` too."""
    return F.rtrim(F.split(F.trim(text), " ")[0], F.lit("+"))


def memory_gib(per_node: Column, per_cpu: Column, cpus: Column, per_gpu: Column, gpus: Column) -> Column:
    return F.when(per_node.isNotNull(), per_node).when(per_cpu.isNotNull(), per_cpu * cpus).when(per_gpu.isNotNull(), per_gpu * gpus)
