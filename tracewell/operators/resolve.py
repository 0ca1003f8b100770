"""Which edit explains a line, and has the line changed since; for all requested lines at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.intervals import SLOTS, TOGETHER, interval_join
from tracewell.plans.materialize import counted



def candidates(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """lines (line_id, commit_sha, file, line) with each edit of their commit whose range holds the line, ends included.

    The join is on the commit, by which edits may lie dealt out already; where a commit has very many edits, on commit, file
    and the segments of their ranges, so that not every line meets every edit."""
    e = edits.select("commit_sha", "file", "edit_idx", "line_start", "line_end", "content_hashes", "ts", "conversation_id", "turn_index", "prompt", "model", "derived_from")
    return interval_join(lines, e, ["commit_sha", "file"], "line", "line_start", "line_end", by=["commit_sha"])


#: Fields of an edit that a resolved line has.
FIELDS = ("edit_idx", "conversation_id", "turn_index", "prompt", "model", "ts", "derived_from")


def _candidate() -> tuple[Column, Column]:
    """What is kept of a candidate, and what it is chosen by: those with the line's present hash come first, then the latest,
    then the last in the note."""
    captured = F.get("content_hashes", F.col("line") - F.col("line_start"))
    same = F.coalesce(captured == F.col("current_hash"), F.lit(False))
    return F.struct(same.alias("same"), captured.alias("captured_hash"), *FIELDS), F.struct("b.same", "b.ts", "b.edit_idx")


def _where_edits_lie(asked: DataFrame, edits: DataFrame) -> DataFrame:
    """asked (no line_id twice) with has_note and b, its best candidate: a line meets its commit's edits and is judged there, so
    lines are dealt out once, and only fields of candidates are sorted, not hashes."""
    e = edits.select("commit_sha", F.col("file").alias("__file"), "line_start", "line_end", "content_hashes", *FIELDS, F.lit(True).alias("__edit"))
    held = (F.col("__file") == F.col("file")) & (F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end"))
    kept, order = _candidate()
    tried = asked.join(e, "commit_sha", "left").select(*(asked[c] for c in asked.columns), "__edit", F.when(held, kept).alias("b"))
    rest = [c for c in asked.columns if c not in ("commit_sha", "line_id")]
    best = F.max_by("b", F.when(F.col("b").isNotNull(), order)).alias("b")
    return tried.groupBy("commit_sha", "line_id").agg(*(F.any_value(c).alias(c) for c in rest), F.bool_or("__edit").alias("has_note"), best)


def _apart(blame: DataFrame, edits: DataFrame, notes: DataFrame) -> DataFrame:
    """The same for any lines and edits: candidates are found first, then the best of each line_id."""
    known = notes.select("commit_sha").distinct().withColumn("has_note", F.lit(True))
    kept, order = _candidate()
    found = candidates(blame.select("line_id", "commit_sha", "file", "line", "current_hash"), edits).select("line_id", kept.alias("b"))
    best = found.groupBy("line_id").agg(F.max_by("b", order).alias("b"))
    return blame.join(known, "commit_sha", "left").join(best, "line_id", "left")


def resolve(blame: DataFrame, edits: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """blame (line_id, commit_sha, file, line, current_hash) with status, reason and the edit's fields.

    commit_sha is null where nobody is to blame; rows of one line_id have their best candidate in common.  Lines of commits
    with very many edits are resolved apart, and all lines if a line_id is there twice or notes are given."""
    if notes is None:
        _, (again,) = counted(blame.groupBy("line_id").count().where("count > 1").select("line_id"))
    if notes is not None or again:
        out = _apart(blame, edits, edits if notes is None else notes)
    else:
        slot = F.pmod(F.xxhash64("commit_sha"), F.lit(SLOTS))
        many, (n,) = counted(edits.groupBy("commit_sha").count().where(F.col("count") > TOGETHER).select(slot.alias("__slot")).distinct())
        asked, few = blame.where("commit_sha is not null"), edits
        part = lambda df, how: df.withColumn("__slot", slot).join(F.broadcast(many), "__slot", how).drop("__slot")
        if n:
            asked, few = part(asked, "left_anti"), part(edits, "left_anti")
        out = _where_edits_lie(asked, few)
        none = {"has_note": F.lit(None).cast("boolean"), "b": F.lit(None).cast(out.schema["b"].dataType)}
        out = out.unionByName(blame.where("commit_sha is null").withColumns(none))
        if n:
            crowded = part(edits, "left_semi")
            out = out.unionByName(_apart(part(blame.where("commit_sha is not null"), "left_semi"), crowded, crowded))
    status = F.when(F.col("b").isNull(), "no_provenance").when(F.col("b.same"), "unchanged").otherwise("drifted")
    reason = F.when(F.col("b").isNotNull(), F.lit(None)).when(F.col("commit_sha").isNull(), "no_blame").when(F.col("has_note").isNull(), "no_note_for_commit").otherwise("no_matching_note")
    return out.select(*blame.columns, status.alias("status"), reason.alias("reason"), F.col("b.captured_hash").alias("captured_hash"), *(F.col(f"b.{f}").alias(f) for f in FIELDS))


def file_lines(files: DataFrame, name: str = "file", text: str = "text") -> DataFrame:
    """(file, line, content) of work-tree files, lines from 1."""
    from tracewell.functions.text import text_lines

    return files.select(F.col(name).alias("file"), F.posexplode(text_lines(text)).alias("p", "content")).select("file", (F.col("p") + 1).alias("line"), "content")


def is_substantial(files: DataFrame, edits: DataFrame, least: int) -> DataFrame:
    """files (file, text) with `substantial`: long enough, or unreadable (null text), and with a recorded edit."""
    long = F.col("text").isNull() | (F.size(F.split("text", "\n")) >= least)
    tracked = edits.select("file").distinct().withColumn("__t", F.lit(True))
    return files.join(tracked, "file", "left").withColumn("substantial", long & F.coalesce("__t", F.lit(False))).drop("__t")
