"""Functions that no query reaches, and white space at the ends of what files hold."""

import json

import pytest

from tracewell import schema
from tracewell.functions import text
from tracewell.operators import capture, index
from tracewell.sources import gittext, notes, transcripts


def blank(fields):
    return {f: None for f in fields}


@pytest.mark.parametrize(
    ("given", "want"),
    [("ref: refs/notes/x\n", "refs/notes/x"), ("\tref: refs/notes/x \r\n", "refs/notes/x"), ("refs/notes/x", "refs/notes/x"), ("ref: ref: y", "ref: y"), (" abc　", "abc"), (" \n", "")],
)
def test_what_a_ref_file_points_at(spark, given, want):
    assert spark.createDataFrame([(given,)], "s string").select(text.strip_ref("s")).first()[0] == want


@pytest.mark.parametrize("line", ["{a} {b}", "\t{a}\t{b}\n", " {a}  {b} rest\r"])
def test_pairs_and_pushes_between_any_white_space(spark, line):
    a, b = "a" * 40, "b" * 40
    df = spark.createDataFrame([(line.format(a=a, b=b),), ("",), (None,), (f"{a}",)], "line string")
    assert [tuple(r) for r in gittext.rewrite_pairs(df).collect()] == [(a, b)]
    pushed = spark.createDataFrame([(f"\trefs/h/m {a} refs/h/m\t{b}\n",), ("\n",), (None,)], "line string")
    assert [tuple(r) for r in gittext.push_lines(pushed).collect()] == [("refs/h/m", a, "refs/h/m", b)]


def test_first_line_of_a_prompt_is_trimmed_of_tabs(spark):
    assert spark.createDataFrame([('\tsay "hi"\t\nmore',)], "p string").select(text.quote_prompt("p")).first()[0] == "\"say 'hi'\""


def test_prompts_of_transcripts_end_without_line_feeds(spark):
    lines = [{"type": "user", "promptId": "1", "message": {"content": "\n go on\t\n"}}, {"type": "user", "promptId": "2", "message": {"content": " \n\t"}}, {"type": "user", "promptId": "3", "message": {"content": [{"type": "text", "text": "a\n"}, {"type": "text", "text": "b\n"}]}}]
    df = spark.createDataFrame([("f", i, json.dumps(x)) for i, x in enumerate(lines)], "session_file string, line_no int, value string")
    assert [r.prompt for r in transcripts.events(df).orderBy("line_no").collect()] == ["go on", None, "a\n\nb"]


def test_a_payload_of_line_feeds_is_empty(spark):
    df = spark.createDataFrame([("\n\t\n",), ('{"session_id":"s"}\n',)], "value string")
    assert [r.session_id for r in capture.payloads(df).collect()] == ["s"]


def test_staged_turns_are_numbered_by_their_names(spark, tmp_path):
    turn = blank(schema.TURN_RECORD.fieldNames()) | {"session_id": "s"}
    for private, numbers in ((False, (2, 10)), (True, (0,))):
        folder = tmp_path / "s" / ("private" if private else "public")
        folder.mkdir(parents=True)
        for n in numbers:
            (folder / f"turn-{n}.json").write_text(json.dumps(turn | {"prompt": f"p{n}"}, indent=1))
        (folder / "turn-x.json").write_text(json.dumps(turn))
        (folder / "turn-7.json").write_text("{broken")
        (folder / "turn-8.json").write_text(" \n")
    rows = notes.read_staged_turns(spark, str(tmp_path)).orderBy("private", "number").collect()
    assert [(r.private, r.number, r.prompt) for r in rows] == [(False, 2, "p2"), (False, 10, "p10"), (True, 0, "p0")]


def test_session_records(spark, tmp_path):
    for name, body in (("a", json.dumps(blank(schema.SESSION_META.fieldNames()) | {"session_id": "a", "model": "m"}, indent=1)), ("b", "{"), ("c", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(body)
    assert [(r.session_id, r.model) for r in notes.read_session_meta(spark, str(tmp_path)).collect()] == [("a", "m")]


def test_both_subtrees_with_their_visibility(spark):
    some = spark.createDataFrame([("s", 1)], "session_id string, n int")
    assert sorted(tuple(r) for r in index.visible_edits(some, some.select("n", "session_id")).collect()) == [("s", 1, "private"), ("s", 1, "public")]
