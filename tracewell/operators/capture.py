"""Capture of prompts and edits, and their flush into notes when a commit comes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import redact
from tracewell.functions.text import is_private, is_session_id, line_hash, relativize, split_lines, trimmed
from tracewell.operators.matching import finished_sessions, match_edits
from tracewell.sources import transcripts
from tracewell.sources.transcripts import _text


def prompts(payloads: DataFrame, rules: Sequence[str] = ()) -> DataFrame:
    """Turn records of payloads (session_id, prompt, cwd, transcript_path, at, seq): invalid sessions are left out, prompts
    are redacted, private ones told by their marker, and turns numbered per session and visibility."""
    ok = payloads.where(is_session_id("session_id") & (F.octet_length("prompt") <= schema.MAX_PAYLOAD_BYTES)).withColumn("private", is_private("prompt"))
    clean = redact.redact(ok, "prompt", rules)
    number = F.row_number().over(Window.partitionBy("session_id", "private").orderBy("seq")) - 1
    return clean.select("session_id", "private", number.cast("int").alias("turn_index"), F.col("redacted.text").alias("prompt"), "transcript_path", "cwd", F.col("at").alias("started_at"), F.lit(None).cast("string").alias("completed_at"), "seq")


def current_turns(events: DataFrame, turns: DataFrame) -> DataFrame:
    """events (session_id, seq) with the turn at hand: the later of the last public and the last private one, public if tied.

    turns (session_id, private, turn_index, seq)."""
    marks = turns.select("session_id", "seq", F.struct("private", "turn_index").alias("m"), F.lit(0).alias("kind"))
    both = events.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("session_id").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    public = F.last(F.when(~F.col("m.private"), F.struct("seq", "m")), ignorenulls=True).over(upto)
    private = F.last(F.when(F.col("m.private"), F.struct("seq", "m")), ignorenulls=True).over(upto)
    at = both.withColumns({"__p": public, "__q": private}).where("kind = 1")
    use_private = F.col("__q").isNotNull() & (F.col("__p").isNull() | (F.col("__q.seq") > F.col("__p.seq")))
    return at.select(*[c for c in events.columns], use_private.alias("private"), F.coalesce(F.when(use_private, F.col("__q.m.turn_index")).otherwise(F.col("__p.m.turn_index")), F.lit(0)).alias("turn_index"))


def edit_records(tool_edits: DataFrame, root: str | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """Edit records of (session_id, turn_index, tool_name, tool, tool_use_id, file, before, after, model, ts).

    Until a commit says more, an edit's range is 1 to its number of lines."""
    lines = split_lines("after")
    file = relativize("file", F.lit(root)) if root else F.col("file")
    return tool_edits.select(
        "session_id", "turn_index", "tool_name", F.coalesce("tool", F.lit(schema.DEFAULT_TOOL)).alias("tool"), "tool_use_id", file.alias("file"), F.array(F.lit(1), F.greatest(F.lit(1), F.size(lines))).alias("line_range"),
        "before", "after", F.transform(lines, line_hash).alias("content_hashes"), "model", F.col("ts").alias("timestamp"), *beside,
    )


def finish_turns(turns: DataFrame, now: str) -> DataFrame:
    """The last turn of each session is completed now, unless it was before."""
    last = F.row_number().over(Window.partitionBy("session_id", "private").orderBy(F.desc("turn_index"))) == 1
    return turns.withColumn("__l", last).withColumn("completed_at", F.when(F.col("__l"), F.coalesce("completed_at", F.lit(now))).otherwise(F.col("completed_at"))).drop("__l")


def payloads(events: DataFrame, value: str = "value") -> DataFrame:
    """Hook payloads (JSON objects) that a harness sends, as columns beside events' own.

    Empty text counts as an empty object; broken JSON, and payloads beyond the limit, are left out.  The session is the
    payload's session_id, else its turn_id; rows without a valid one are left out too."""
    text = F.when(trimmed(F.coalesce(value, F.lit(""))) == "", F.lit("{}")).otherwise(F.col(value))
    fit = events.withColumn("__v", F.try_parse_json(text)).where((F.octet_length(text) <= schema.MAX_PAYLOAD_BYTES) & F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")))
    get = lambda name: _text(F.col("__v"), f"$.{name}")
    out = fit.withColumns(
        {
            "session_id": F.coalesce(get("session_id"), get("turn_id")), "prompt": get("prompt"), "cwd": get("cwd"), "transcript_path": get("transcript_path"), "model": get("model"), "tool_name": get("tool_name"),
            "tool_use_id": get("tool_use_id"), "tool_input": F.try_variant_get("__v", "$.tool_input", "variant"),
        }
    )
    return out.where(is_session_id("session_id")).drop("__v", value)


def session_starts(sent: DataFrame) -> DataFrame:
    """Session records of payloads (session_id, model, at): a model that isn't told is unknown."""
    return sent.select("session_id", F.coalesce("model", F.lit(schema.UNKNOWN_MODEL)).alias("model"), F.col("at").alias("started_at"))


def upsert_sessions(have: DataFrame, new: DataFrame) -> DataFrame:
    """have (session_id, model, started_at) after new starts; of several the last."""
    last = new.groupBy("session_id").agg(F.max_by(F.struct("model", "started_at"), F.struct("started_at", "model")).alias("s")).select("session_id", "s.model", "s.started_at")
    return have.join(last, "session_id", "left_anti").unionByName(last)


def tool_edits(sent: DataFrame, harness: str = schema.DEFAULT_TOOL) -> DataFrame:
    """sent (session_id, tool_name, tool_use_id, tool_input, ...) with (part, tool, file, before, after), a row for each edit.

    An Edit or a Write is one edit, a MultiEdit one for each of its parts, a patch one for each file that gets lines.
    Each harness only sends its own tools."""
    has = F.try_variant_get("tool_input", "$.file_path", "variant").isNotNull()
    own = F.col("tool_name") == schema.PATCH_TOOL if harness == schema.PATCH_HARNESS else F.col("tool_name").isin(*schema.EDIT_TOOLS) & has
    rows = transcripts.tool_edits(sent.where(own), "tool_name", "tool_input").withColumnRenamed("e", "__e").withColumns({"tool": F.lit(harness), "file": F.col("__e.file"), "before": F.col("__e.before"), "after": F.col("__e.after")})
    return rows.drop("__e", "tool_input")


def captured_edits(sent: DataFrame, turns: DataFrame, root: str | None = None, harness: str = schema.DEFAULT_TOOL) -> DataFrame:
    """Edit records, with `private`, `seq` and `part`, of payloads (session_id, seq, at, ...): each belongs to the turn at
    hand of its session.

    turns (session_id, private, turn_index, seq)."""
    at = current_turns(tool_edits(sent, harness).withColumnRenamed("at", "ts"), turns.select("session_id", "private", "turn_index", "seq"))
    return edit_records(at, root, ("private", "seq", "part"))


def flush(commit_sha: str, staged: DataFrame, added: DataFrame, turns: DataFrame, sessions: DataFrame, picked_from: str | None = None) -> DataFrame:
    """The flat edits of a commit's notes, with `private`, for both visibilities at once: staged edits (edit_id, private, ...)
    that its added lines hold, with the prompt of their turn of the same visibility and the model of edit or session.

    Edits are numbered within their visibility's note.  Private edits never see a public prompt, nor public ones a private."""
    of = lambda df: df.withColumn("commit_sha", F.lit(commit_sha))
    commits = staged.sparkSession.createDataFrame([(commit_sha, picked_from)], "commit_sha string, picked_from string")
    none = F.lit(None).cast("string")
    return flush_commits(commits, of(staged), of(added), of(turns), of(sessions)).select(
        "commit_sha", "edit_idx", "file", "line_start", "line_end", "content_hashes", none.alias("original_blob_sha"), "prompt", "conversation_id", "turn_index", "tool_use_id",
        none.alias("preceding_turns_summary"), "model", "tool", "ts", "derived_from", "session_id", "edit_id", "private",
    )


def left_staged(staged: DataFrame, flushed: DataFrame) -> DataFrame:
    """staged after a flush: sessions all of whose edits, public and private, matched are gone; of any other session every
    edit stays, matched ones too, and may match again on a later commit."""
    done = finished_sessions(flushed.select("session_id"), staged.select("session_id"))
    return staged.join(done, "session_id", "left_anti")


def flush_commits(commits: DataFrame, staged: DataFrame, added: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """flush() for many commits, each of which has staging of its own: staged, turns, sessions and added also have
    commit_sha, and commits (commit_sha, picked_from) says which is a cherry-pick."""
    e = staged.select("commit_sha", "edit_id", "file", split_lines("after").alias("after"), F.get("line_range", F.lit(0)).alias("line_start"), F.get("line_range", F.lit(1)).alias("line_end"))
    place = lambda c: F.concat("commit_sha", F.lit("\n"), c)
    met = match_edits(e.select(F.struct("commit_sha", "edit_id").alias("edit_id"), place("file").alias("file"), "after", "line_start", "line_end"), added.select(place("file").alias("file"), "pos", "line_no", "content"))
    places = met.select("edit_id.commit_sha", "edit_id.edit_id", "match_start", "match_end")
    keys = ["commit_sha", "session_id", "private", "turn_index"]
    prompts_ = turns.groupBy(*keys).agg(F.min_by("prompt", F.struct("started_at", "prompt")).alias("prompt"))
    models = sessions.groupBy("commit_sha", "session_id").agg(F.min("model").alias("session_model"))
    rows = staged.join(places, ["commit_sha", "edit_id"]).join(prompts_, keys, "left").join(models, ["commit_sha", "session_id"], "left").join(commits, "commit_sha", "left")
    origin = F.struct(F.lit("rewrite").alias("kind"), F.col("picked_from").alias("source_commit"), F.lit(0).alias("source_edit"), F.lit(None).cast("float").alias("confidence"), F.lit(None).cast("string").alias("transcript_path"))
    number = F.row_number().over(Window.partitionBy("commit_sha", "private").orderBy("edit_id")) - 1
    return rows.select(
        "commit_sha", "private", number.alias("edit_idx"), "file", F.col("match_start").alias("line_start"), F.col("match_end").alias("line_end"), "content_hashes", F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.col("session_id").alias("conversation_id"), "turn_index", "tool_use_id", F.coalesce("model", "session_model", F.lit(schema.UNKNOWN_MODEL)).alias("model"), "tool", F.col("timestamp").alias("ts"),
        F.when(F.col("picked_from").isNotNull(), origin).cast(schema.DERIVED_FROM).alias("derived_from"), "session_id", "edit_id",
    )
