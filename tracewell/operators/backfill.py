"""Reconstruction: which commit a recorded session belongs to, by time and by the lines that both have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions.redact import redact
from tracewell.functions.text import is_private, line_hash, split_lines
from tracewell.operators import matching
from tracewell.plans.materialize import counted, keep, small


def edit_matches(edits: DataFrame, pairs: DataFrame, added: DataFrame, most_lines: int = schema.MAX_WINDOW_LINES) -> DataFrame:
    """(session_id, edit_no, sha, file, line_start, line_end, content_hashes): the longest common run of an edit's lines and a
    commit's added lines, if it is half the edit or more.

    edits (session_id, edit_no, file, after), pairs (session_id, sha), added (sha, file, pos, line_no, hash).  An edit's file
    is the commit's file that its path ends with, the longest of several.  Edits and files of more than most_lines lines match
    nothing.  A file's added lines are one row, which each edit that is looked for in it meets; no line is moved for a pair."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    added = added.where("sha is not null and file is not null")
    each = added.select("sha", F.col("file").alias("in_diff"), "pos", "line_no", "hash")
    files = each.select("sha", "in_diff").distinct().withColumn("base", base(F.col("in_diff")))
    met = edits.join(pairs.select("session_id", "sha"), "session_id").withColumn("base", base(F.col("file"))).join(files, ["sha", "base"]).where(F.endswith(F.col("file"), F.col("in_diff")))
    best_file = F.max_by("in_diff", F.struct(F.col("in_diff") == F.col("file"), F.length("in_diff"), "in_diff"))
    key = ("session_id", "edit_no", "sha")
    at = met.groupBy(*key).agg(best_file.alias("in_diff"), F.first("after").alias("after"))
    long, (n,) = counted(each.groupBy("sha", "in_diff").count().where(F.col("count") > most_lines).select("sha", "in_diff"))
    fits = each.join(small(long, n), ["sha", "in_diff"], "left_anti") if n else each
    lines = fits.groupBy("sha", "in_diff").agg(F.sort_array(F.collect_list(F.struct("pos", "line_no", "hash"))).alias("lines"))
    needles = at.select(*key, "in_diff", split_lines("after").alias("needle")).where(F.size("needle").between(1, most_lines))
    rows = needles.join(lines, ["sha", "in_diff"]).select(
        F.struct(*key, F.col("in_diff").alias("file"), F.size("needle").alias("needle_lines"), "lines").alias("key"),
        F.transform("needle", lambda x: F.xxhash64(line_hash(x))).alias("needle"), F.transform("lines", lambda x: F.xxhash64(x["hash"])).alias("added"),
    )
    found = matching.longest_runs(rows).withColumn("run", F.slice("lines", F.col("added_start") + 1, F.col("length").cast("int")))
    last = F.element_at("run", -1)["line_no"]
    return found.select(*key, "file", F.element_at("run", 1)["line_no"].alias("line_start"), last.alias("line_end"), F.transform("run", lambda x: x["hash"]).alias("content_hashes"))


def best_sessions(sessions: DataFrame, edits: DataFrame, commits: DataFrame, added: DataFrame, on: tuple[str, ...] = ("repo",)) -> tuple[DataFrame, DataFrame]:
    """Each session's commit with its confidence (matched edits of all edits), and the edits' matches in it.

    sessions (session_id, start, end, repo), commits (sha, committed_at, author_email, pos, repo): `on` names the columns
    that say where both were made, and a session only meets commits made there."""
    pairs = matching.session_commits(sessions.select("session_id", "start", "end", *on), commits, on=on)
    found = keep(edit_matches(edits, pairs, added))  # read for the scores and for the edits
    total = edits.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    scored = found.groupBy("session_id", "sha").agg(F.count(F.lit(1)).alias("matched")).join(total, "session_id").join(commits, "sha")
    scored = scored.withColumn("confidence", matching.confidence("matched", "total").cast("float"))
    best = matching.best_commits(scored)
    return best, found.join(best.select("session_id", "sha"), ["session_id", "sha"], "left_semi")


def backfill(sessions: DataFrame, edits: DataFrame, commits: DataFrame, added: DataFrame, author: str | None = None, any_author: bool = False, include_low: bool = False, rules: tuple[str, ...] = (), on: tuple[str, ...] = ("repo",)) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new edits).  outcomes: (session_id, status, sha, confidence), a row for each session.  New edits are flat
    ones with `visibility`, marked as reconstructed, prompts redacted; sessions below the floor or by others have none.

    edits also (turn_index, prompt, tool_use_id, model, tool, ts, transcript_path)."""
    best, matches = best_sessions(sessions, edits, commits, added, on)
    judged = matching.accepted(best, author, any_author, include_low)
    outcomes = sessions.select("session_id").join(judged.select("session_id", "sha", "confidence", "status"), "session_id", "left")
    outcomes = outcomes.withColumn("status", F.coalesce("status", F.lit("skipped-no-match")))
    outcomes = outcomes.withColumn("sha", F.when(F.col("status") == "written", F.col("sha")))
    written = judged.where("status = 'written'").select("session_id", "sha", "confidence")
    rows = matches.join(written, ["session_id", "sha"]).join(edits.drop("file", "after"), ["session_id", "edit_no"])
    rows = redact(rows.withColumn("visibility", F.when(is_private("prompt"), "private").otherwise("public")), "prompt", rules)
    origin = F.struct(F.lit("backfill").alias("kind"), F.lit(None).cast("string").alias("source_commit"), F.lit(None).cast("int").alias("source_edit"), "confidence", "transcript_path")
    number = F.expr("cast(row_number() over (partition by sha, visibility order by session_id, edit_no) - 1 as int)")
    flat = rows.select(
        F.col("sha").alias("commit_sha"), number.alias("edit_idx"), "file", "line_start", "line_end", "content_hashes", F.lit(None).cast("string").alias("original_blob_sha"), F.col("redacted.text").alias("prompt"),
        F.col("session_id").alias("conversation_id"), "turn_index", "tool_use_id", F.lit(None).cast("string").alias("preceding_turns_summary"), F.coalesce("model", F.lit(schema.UNKNOWN_MODEL)).alias("model"),
        F.coalesce("tool", F.lit(schema.DEFAULT_TOOL)).alias("tool"), "ts", origin.cast(schema.DERIVED_FROM).alias("derived_from"), "visibility",
    )
    return outcomes, flat
