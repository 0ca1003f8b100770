"""Report envelopes: rows as JSON, fields without a value left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import approximate_label, short_sha


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "true"}).alias("json"))


def search_line(commit: str = "commit_sha", file: str = "file", start: str = "line_start", end: str = "line_end", prompt: str = "prompt") -> Column:
    """One hit as a line of text."""
    span = F.concat(F.col(file).cast("string"), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))
    return F.concat(short_sha(commit), F.lit("  "), span, F.lit("  "), F.get(F.split(F.coalesce(F.col(prompt), F.lit("")), "\n"), 0))


def point_line(resolved: DataFrame) -> DataFrame:
    """resolved with `text`: what a reader is told about a line."""
    reason = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    label = approximate_label("derived_from")
    told = F.concat(F.col("status"), F.lit(" · "), F.coalesce("model", F.lit("")), F.lit(" · turn "), F.coalesce(F.col("turn_index").cast("string"), F.lit("")), F.when(label.isNotNull(), F.concat(F.lit(" · "), label)).otherwise(""))
    return resolved.withColumn("text", F.when(F.col("status") == "no_provenance", F.get(F.map_values(F.map_filter(reason, lambda k, _: k == F.col("reason"))), 0)).otherwise(told))


REASONS = {
    "no_blame": "nobody is to blame for this line",
    "no_note_for_commit": "the commit has no note",
    "no_matching_note": "no recorded edit covers this line",
}


def outcome_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
