"""Unified diffs, hunk ranges and blame output as tables; input tables have (diff_id, pos, line) or a text each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import col, hunk_plus, is_diff_header, line_hash, text_lines


def diff_lines(diffs: DataFrame, diff_id: str = "diff_id", text: str = "text") -> DataFrame:
    return diffs.select(F.col(diff_id).alias("diff_id"), F.posexplode(text_lines(text)).alias("pos", "line"))


def added_lines(lines: DataFrame) -> DataFrame:
    """(diff_id, file, pos, line_no, content, hash) of a diff's added lines, as a walk over its lines finds them.

    The file and the hunk's start are carried forward; the number within the hunk is a running count of added and
    context lines."""
    line = F.col("line")
    file = F.when(F.startswith(line, F.lit("+++ b/")), F.substring(line, F.lit(7), F.length(line)))
    header = F.startswith(line, F.lit("@@ "))
    tagged = lines.select("diff_id", "pos", "line", file.alias("named"), F.when(file.isNotNull(), "file").when(is_diff_header("line"), "skip").when(header, "hunk").when(F.startswith(line, F.lit("+")), "add").when(F.startswith(line, F.lit("-")), "skip").when(F.startswith(line, F.lit("@@")), "skip").otherwise("context").alias("what"))
    upto = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.withColumns({"file": F.last("named", ignorenulls=True).over(upto), "hunk": F.sum((F.col("what") == "hunk").cast("int")).over(upto), "start": F.last(F.when(F.col("what") == "hunk", F.coalesce(hunk_plus("line")["start"], F.lit(0))), ignorenulls=True).over(upto)})
    moves = F.col("what").isin("add", "context") & F.col("file").isNotNull()
    within = Window.partitionBy("diff_id", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = carried.withColumn("line_no", F.coalesce("start", F.lit(0)) + F.coalesce(F.sum(moves.cast("int")).over(within), F.lit(0)))
    content = F.substring(line, F.lit(2), F.length(line))
    return numbered.where("what = 'add' and file is not null").select("diff_id", "file", "pos", F.col("line_no").cast("int").alias("line_no"), content.alias("content"), line_hash(content).alias("hash"))


def hunk_ranges(lines: DataFrame) -> DataFrame:
    """(diff_id, file, line_no): every new line that a diff's hunk headers name; deleted files and empty hunks have none."""
    line = F.col("line")
    named = F.when(F.startswith(line, F.lit("+++ ")), F.regexp_replace(F.substring(line, F.lit(5), F.length(line)), r"\Ab/", ""))
    upto = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lines.withColumn("file", F.last(named, ignorenulls=True).over(upto)).where(F.startswith(line, F.lit("@@ ")))
    h = hunk_plus("line")
    ranges = at.select("diff_id", "file", h["start"].alias("start"), h["count"].alias("count")).where("file != '/dev/null' and count > 0 and start is not null")
    return ranges.select("diff_id", "file", F.explode(F.expr("sequence(start, start + count - 1)")).alias("line_no")).distinct()


def blame_rows(reports: DataFrame, text: str = "text") -> DataFrame:
    """reports with (commit_sha, original_line, author, original_file) of one line's porcelain blame."""
    t = col(text)
    head = r"\A([0-9a-f]{40}) ([0-9]+)"
    return reports.withColumns(
        {
            "commit_sha": F.nullif(F.regexp_extract(t, head, 1), F.lit("")),
            "original_line": F.regexp_extract(t, head, 2).try_cast("int"),
            "author": F.nullif(F.regexp_extract(t, r"(?m)^author (.*)$", 1), F.lit("")),
            "original_file": F.nullif(F.regexp_extract(t, r"(?m)^filename (.*)$", 1), F.lit("")),
        }
    )
