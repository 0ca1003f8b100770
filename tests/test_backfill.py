from pyspark.sql import functions as F

from tracewell.functions.text import line_hash
from tracewell.operators import maintenance
from tracewell.operators.backfill import backfill


def tables(spark):
    sessions = [("s", 1000, 2000, "r"), ("late", 10**7, 10**7, "r"), ("other", 1000, 1000, "r"), ("low", 1000, 1000, "r"), ("elsewhere", 1000, 2000, "q")]
    sessions = spark.createDataFrame(sessions, "session_id string, start long, end long, repo string")
    rows = [
        ("s", 0, "/w/src/a.rs", "one\ntwo\nthree", "mail a@b.co"), ("s", 1, "/w/src/a.rs", "x\ny", "# prov:private\nhide"), ("late", 0, "/w/src/a.rs", "one\ntwo", "p"), ("other", 0, "/w/b.rs", "zz", "p"),
        ("low", 0, "/w/b.rs", "zz", "p"), ("low", 1, "/w/b.rs", "no\nno", "p"), ("elsewhere", 0, "/w/src/a.rs", "one\ntwo", "p"),
    ]
    edits = spark.createDataFrame(rows, "session_id string, edit_no int, file string, after string, prompt string")
    edits = edits.withColumns({"turn_index": F.lit(0), "tool_use_id": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "tool": F.lit(None).cast("string"), "ts": F.lit("t"), "transcript_path": F.lit("f.jsonl")})
    commits = spark.createDataFrame([("c1", "A@x", 1500, 1, "r"), ("c2", "b@x", 1500, 2, "r"), ("c0", "A@x", 1400, 3, "r")], "sha string, author_email string, committed_at long, pos int, repo string")
    lines = [("c1", "src/a.rs", i, n, t) for i, (n, t) in enumerate([(4, "zero"), (5, "one"), (6, "two"), (9, "x"), (10, "y")])] + [("c2", "b.rs", 0, 1, "zz"), ("c0", "src/a.rs", 0, 1, "x"), ("c0", "src/a.rs", 1, 2, "y")]
    added = spark.createDataFrame(lines, "sha string, file string, pos int, line_no int, content string").withColumn("hash", line_hash("content"))
    return sessions, edits, commits, added


def test_sessions_find_their_commits(spark):
    outcomes, flat = backfill(*tables(spark), author="a@x")
    got = {r.session_id: (r.status, r.sha) for r in outcomes.collect()}
    assert got == {"s": ("written", "c1"), "late": ("skipped-no-match", None), "other": ("skipped-cross-author", None), "low": ("skipped-low-confidence", None), "elsewhere": ("skipped-no-match", None)}
    rows = {r.visibility: r for r in flat.collect()}
    assert (rows["public"].line_start, rows["public"].line_end, len(rows["public"].content_hashes), rows["public"].prompt) == (5, 6, 2, "mail [REDACTED:email]")
    assert (rows["private"].line_start, rows["private"].line_end) == (9, 10)
    assert rows["public"].derived_from.kind == "backfill" and rows["public"].derived_from.confidence == 1.0 and rows["public"].file == "src/a.rs"
    assert maintenance.backfill_only(flat).first().commit_sha == "c1"


def test_a_second_run_adds_nothing(spark):
    _, flat = backfill(*tables(spark), any_author=True, include_low=True)
    once = flat.drop("visibility")
    assert maintenance.backfill_merge(once, once).count() == once.count() == 4
