"""Data model: notes of edits per commit, the flat tables derived from them, and staged session records."""

from __future__ import annotations

from pyspark.sql import types as T

#: Versions that readers accept.
SCHEMA_VERSION = 1
CACHE_SCHEMA_VERSION = 1

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DERIVED_FROM = _struct(kind=_S, source_commit=_S, source_edit=_I, confidence=T.FloatType(), transcript_path=_S)
EDIT = _struct(
    file=_S, line_range=T.ArrayType(_I), content_hashes=T.ArrayType(_S), original_blob_sha=_S, prompt=_S, conversation_id=_S, turn_index=_I,
    tool_use_id=_S, preceding_turns_summary=_S, model=_S, tool=_S, timestamp=_S, derived_from=DERIVED_FROM,
)
NOTE = _struct(version=_I, edits=T.ArrayType(EDIT))
NOTES_TABLE = _struct(commit_sha=_S, visibility=_S, version=_I, edits=T.ArrayType(EDIT))
TURN_RECORD = _struct(session_id=_S, turn_index=_I, prompt=_S, private=_B, transcript_path=_S, cwd=_S, started_at=_S, completed_at=_S)
EDIT_RECORD = _struct(
    session_id=_S, turn_index=_I, tool_name=_S, tool=_S, tool_use_id=_S, file=_S, line_range=T.ArrayType(_I), before=_S, after=_S,
    content_hashes=T.ArrayType(_S), model=_S, timestamp=_S,
)
SESSION_META = _struct(session_id=_S, model=_S, started_at=_S)
#: Columns of the flat edit table; (commit_sha, edit_idx) is its key.
EDIT_COLUMNS = (
    "commit_sha", "edit_idx", "file", "line_start", "line_end", "content_hashes", "original_blob_sha", "prompt", "conversation_id", "turn_index",
    "tool_use_id", "preceding_turns_summary", "model", "tool", "ts", "derived_from",
)
#: Defaults and limits.
DEFAULT_TOOL = "claude-code"
UNKNOWN_MODEL = "unknown"
MAX_PAYLOAD_BYTES = 4 * 1024 * 1024
MAX_WINDOW_LINES = 8192
MAX_COMMITS = 5000
MAX_RESOLVE_LINES = 5000
SEARCH_LIMIT = 50
MIN_CONFIDENCE = 0.6
WINDOW_PAD_SECONDS = 4 * 3600
STAGING_TTL_DAYS = 14
COMPACT_AGE_DAYS = 90
SUBSTANTIAL_LINES = 10
PUBLIC_REF = "refs/notes/prompts"
PRIVATE_REF = "refs/notes/prompts-private"
EDIT_TOOLS = ("Edit", "Write", "MultiEdit")
PATCH_TOOL, PATCH_HARNESS = "apply_patch", "codex"
