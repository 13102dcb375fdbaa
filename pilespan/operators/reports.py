"""Reports over runs: samples, timelines, spectra, restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bit, hms


def runtime_by_sample(parts: DataFrame) -> DataFrame:
    """(sample, seconds, hms) from the parts (sample, seconds) of a run."""
    return parts.groupBy("sample").agg(F.sum("seconds").cast("long").alias("seconds")).withColumn("hms", hms("seconds"))


def timeline(parts: DataFrame) -> DataFrame:
    """One row, events: JSON array of a run's parts (id, content, start, end, group), by id."""
    item = F.struct("id", "content", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "group", F.lit("range").alias("type"))
    return parts.agg(F.to_json(F.array_sort(F.collect_list(item))).alias("events"))


def timeline_html(events: str, title: str = "Run") -> str:
    """A page that draws a timeline's events as bars."""
    return (
        f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><div id='lines'></div><script>\n"
        f"const events = {events};\nconst at = e => new Date(e.replace(' ', 'T')).getTime();\n"
        "const first = Math.min(...events.map(e => at(e.start))), last = Math.max(...events.map(e => at(e.end))) + 1;\n"
        "for (const e of events) { const d = document.createElement('div'); d.textContent = e.group + ': ' + e.content;\n"
        "d.style = `margin-left:${80 * (at(e.start) - first) / (last - first)}%;width:${Math.max(0.2, 80 * (at(e.end) - at(e.start)) / (last - first))}%;background:#bcd;white-space:nowrap`;\n"
        "document.getElementById('lines').append(d); }\n</script>\n"
    )


def remaining(intervals: DataFrame, done: DataFrame) -> DataFrame:
    """The intervals (region, start, end) that no finished part has."""
    return intervals.join(done.select("region", "start", "end").distinct(), ["region", "start", "end"], "left_anti")


def substitution_spectrum(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, substitution, n_sites, n_reads): how often each substitution is seen."""
    place = F.instr(F.lit("ACGT"), F.substring("substitution", 2, 1))
    rows = table.select(*keys, F.explode("all_subs").alias("substitution"), "base_count")
    return rows.groupBy(*keys, "substitution").agg(F.count("*").alias("n_sites"), F.sum(F.element_at("base_count", place)).alias("n_reads"))


def sample_summary(table: DataFrame) -> DataFrame:
    """(sample, n_sites, n_edited, n_bases) of a table."""
    return table.groupBy("sample").agg(F.count("*").alias("n_sites"), F.count_if(F.size("all_subs") > 0).alias("n_edited"), F.sum("coverage").alias("n_bases"))


def read_distribution(bases: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Bases by the read of a pair that they come from and its direction: r1, r1_reverse, r2, r2_reverse."""
    first, reverse = bit("flag", 64), bit("flag", 16)
    kinds = {"r1": first & ~reverse, "r1_reverse": first & reverse, "r2": ~first & ~reverse, "r2_reverse": ~first & reverse}
    return bases.groupBy(*keys).agg(*[F.count_if(rule).alias(name) for name, rule in kinds.items()])
