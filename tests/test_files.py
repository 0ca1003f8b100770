from tracewell import schema
from tracewell.sources import files, notes


def test_turns_and_sessions_are_replaced_by_name(spark, tmp_path):
    fields = schema.TURN_RECORD

    def turns(rows):
        return spark.createDataFrame([(s, n, p, private, None, None, at, done) for s, n, p, private, at, done in rows], fields)

    home = str(tmp_path / "staged")
    assert files.write_turns(turns([("a", 0, "x", False, "1", None), ("a", 10, "y\nz", False, "2", None), ("a", 0, "secret", True, "1", None), ("../b", 0, "no", False, "1", None), ("a", None, "no", False, "1", None)]), home) == 3
    assert files.write_turns(turns([("a", 0, "early", False, "1", "2"), ("a", 0, "late", False, "1", "3"), ("a", 0, "open", False, "9", None)]), home) == 1
    got = sorted((r.session_id, r.number, r.private, r.prompt, r.completed_at) for r in notes.read_staged_turns(spark, home).collect())
    assert got == [("a", 0, False, "late", "3"), ("a", 0, True, "secret", None), ("a", 10, False, "y\nz", None)]
    meta = spark.createDataFrame([("a", "m1", "1"), ("a", "m2", "2"), ("", "no", "1")], schema.SESSION_META)
    assert files.write_session_meta(meta, home) == 1
    assert [(r.session_id, r.model) for r in notes.read_session_meta(spark, home).collect()] == [("a", "m2")]
    assert not list(tmp_path.rglob("*.part")) and files.write_turns(turns([]), home) == 0


def test_a_conflicted_tree_is_read_by_its_paths(spark, tmp_path):
    home, sha = tmp_path / "ab" / "tree", "ab" * 20
    for name, body in ((f"{sha[:2]}/{sha[2:]}", "one"), (f"cd/ef/{'0' * 36}", "two"), ("README", "no"), (f"{sha[:2]}/short", "no"), ("f" * 40, "flat")):
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_text(body)
    for root in (str(home), f"file://{home}", f"{home}/"):
        assert {r.commit_sha: r.body for r in files.read_conflicted_tree(spark, root).collect()} == {sha: "one", f"cdef{'0' * 36}": "two", "f" * 40: "flat"}
