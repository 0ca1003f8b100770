import json

import pytest

from tracewell.operators import index
from tracewell.sources import diffs, gittext, notes, transcripts

EDIT = {"file": "a.rs", "line_range": [1, 2], "content_hashes": ["x", "y"], "prompt": "p", "conversation_id": "c", "turn_index": 0, "model": "m", "tool": "t", "timestamp": "2026-01-01T00:00:00Z"}


def test_notes_versions_and_unknown_fields(spark):
    bodies = {
        "good": {"version": 1, "edits": [EDIT | {"extra": 1}], "more": 2}, "newer": {"version": 99, "edits": []}, "none": {"edits": []}, "origin": {"version": 1, "edits": [EDIT | {"derived_from": {"kind": "novel", "confidence": 0.5}}]},
        "back": {"version": 1, "edits": [EDIT | {"derived_from": {"kind": "backfill", "confidence": 0.5, "transcript_path": "t"}}]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("bad", "{x")], "commit_sha string, body string")
    got = {r.commit_sha: r for r in notes.parse_notes(df).collect()}
    assert {k: r.error for k, r in got.items()} == {"good": None, "newer": "version 99", "none": "no version", "origin": None, "back": None, "bad": "not JSON"}
    assert got["origin"].edits[0].derived_from.kind == "unknown" and got["origin"].edits[0].derived_from.confidence is None
    assert got["back"].edits[0].derived_from.confidence == 0.5 and got["good"].edits[0].derived_from is None
    with pytest.raises(Exception, match="version 99"):
        notes.strict(notes.parse_notes(df.where("commit_sha = 'newer'"))).collect()


def test_note_files_round_trip(spark, tmp_path):
    sha = "ab" * 20
    (tmp_path / "ab" / "ab").mkdir(parents=True)
    (tmp_path / "ab" / "ab" / sha[4:]).write_text(json.dumps({"version": 1, "edits": [EDIT]}))
    read = notes.read_note_files(spark, str(tmp_path))
    assert read.first().commit_sha == sha
    back = notes.parse_notes(notes.to_json(index.rebuild_notes(index.flatten_edits(read))))
    assert back.first().edits[0].asDict() == read.first().edits[0].asDict()
    assert "tool_use_id" not in notes.to_json(read).first().body


def test_diff_walk(spark):
    diff = "--- a/x\n+++ b/x\n@@ -0,0 +3,2 @@\n+one\n+++ not a header? it is\n+two\n-gone\n ctx\n+four\n@@ -1 +20 @@\n++++\n--- a/y\n+++ /dev/null\n+++ b/y z\n@@ -1,0 +1 @@\n+last"
    rows = diffs.added_lines(diffs.diff_lines(spark.createDataFrame([(1, diff)], "diff_id int, text string"))).orderBy("pos").collect()
    assert [(r.file, r.line_no, r.content) for r in rows] == [("x", 3, "one"), ("x", 4, "two"), ("x", 6, "four"), ("x", 20, "+++"), ("y z", 1, "last")]


def test_hunk_ranges(spark):
    diff = "+++ b/x\n@@ -0,0 +3,2 @@\n@@ -0,0 +9 @@\n@@ -4,2 +11,0 @@\n+++ /dev/null\n@@ -1 +1,4 @@"
    rows = diffs.hunk_ranges(diffs.diff_lines(spark.createDataFrame([(1, diff)], "diff_id int, text string"))).collect()
    assert sorted((r.file, r.line_no) for r in rows) == [("x", 3), ("x", 4), ("x", 9)]


def test_blame(spark):
    text = f"{'a1' * 20} 7 9 1\nauthor Ann B\nsummary s\nfilename old/x.rs\n\tcode"
    r = diffs.blame_rows(spark.createDataFrame([(1, text), (2, None), (3, "fatal: no")], "id int, text string")).orderBy("id").collect()
    assert (r[0].commit_sha, r[0].original_line, r[0].author, r[0].original_file) == ("a1" * 20, 7, "Ann B", "old/x.rs")
    assert r[1].commit_sha is None and r[2].commit_sha is None


def test_line_protocols(spark):
    a, b = "a" * 40, "b" * 40
    lines = lambda *x: spark.createDataFrame([("HEAD", i, v) for i, v in enumerate(x)], "ref string, pos int, line string")
    assert [tuple(r) for r in gittext.rewrite_pairs(lines(f"{a} {b}", f"{a}", f"{a} {b} extra", "x y")).collect()] == [(a, b), (a, b)]
    assert gittext.push_lines(lines("r s t u", "r s t")).count() == 1
    log = gittext.reflog(lines(f"{b} commit (amend): x", f"{a} commit: y", "short z"))
    assert [tuple(r) for r in gittext.reflog_rewrites(log).collect()] == [("HEAD", a, b)]
    assert [r.sha for r in gittext.commits(lines("s1\te\t5", "s2\te\tx", "s3\te\t6"), most=5).collect()] == ["s1", "s3"]
    got = gittext.tree(lines(f"100644 blob {b}\t{a[:2]}/{a[2:]}", f"100644 blob {b}\tREADME", f"040000 tree {b}\tx")).collect()
    assert [tuple(r) for r in got] == [(a, b)]


def test_rules():
    assert gittext.rules("# c\n\n a+ \nb") == ["a+", "b"]
    with pytest.raises(ValueError, match="line 2"):
        gittext.rules("a\n(")


def test_conflicts(spark):
    body = "{\n<<<<<<< o\na\n=======\nb\n>>>>>>> t\n=======\n}\n"
    rows = gittext.split_conflicts(spark.createDataFrame([(1, body), (2, "plain")], "k int, body string"), "k", "body").collect()
    assert [tuple(r) for r in rows] == [(1, "{\na\n=======\n}\n", "{\nb\n=======\n}\n")]


def test_transcripts(spark):
    use = lambda name, **i: {"type": "tool_use", "id": "u", "name": name, "input": i}
    said = lambda *content, model="m1": {"type": "assistant", "timestamp": "t9", "message": {"model": model, "content": list(content)}}
    events = [
        said(use("Edit", file_path="f", old_string="o", new_string="n")),
        {"type": "user", "sessionId": "S", "promptId": "p0", "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "sessionId": "S", "promptId": "p1", "cwd": "", "timestamp": "t1", "message": {"content": " first "}},
        {"type": "user", "promptId": "p1", "message": {"content": "again"}},
        {"type": "user", "promptId": "p2", "message": {"content": [{"type": "tool_result", "content": "x"}, {"type": "text", "text": "no"}]}},
        {"type": "user", "promptId": "p2", "cwd": "/w", "message": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}},
        said(use("MultiEdit", file_path="g", edits=[{"old_string": "1", "new_string": "2"}, {"new_string": "3"}]), {"type": "text", "text": "t"}, use("Read", file_path="h"), model=""),
        said(use("apply_patch", command="*** Begin\n*** Update File: q\n-x\n+y\n+z\n*** Add File: r\n*** End"), model="m2"),
    ]
    lines = [("s", i, json.dumps(e)) for i, e in enumerate(events)] + [("s", 20, "{broken"), ("s", 21, "[]")]
    ev = transcripts.events(spark.createDataFrame(lines, "session_file string, line_no int, value string"))
    turns = transcripts.turns(ev)
    assert [(r.turn_index, r.prompt_id, r.prompt) for r in turns.orderBy("turn_index").collect()] == [(0, "p1", "first"), (1, "p2", "a\nb")]
    edits = transcripts.edits(ev, turns).orderBy("line_no", "use", "part").collect()
    assert [(e.turn_index, e.tool_name, e.file, e.before, e.after) for e in edits] == [(0, "Edit", "f", "o", "n"), (1, "MultiEdit", "g", "1", "2"), (1, "MultiEdit", "g", "", "3"), (1, "apply_patch", "q", "", "y\nz")]
    s = transcripts.session_table(ev).first()
    assert (s.session_id, s.cwd, s.started_at, s.ended_at, s.model) == ("S", "/w", "t9", "t9", "m2")
    assert transcripts.latest_model(ev).first().model == "m2"


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.JSONL").write_text('{"type":"user"}\n\n{"type":"assistant"}\n')
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "big.jsonl").write_text("x" * 100)
    rows = transcripts.read_lines(spark, str(tmp_path), most_bytes=90).collect()
    assert [r.line_no for r in rows] == [0, 2]
