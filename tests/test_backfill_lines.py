from pyspark.sql import functions as F

from tracewell.functions.text import line_hash
from tracewell.operators.backfill import edit_matches


def tables(spark):
    edits = spark.createDataFrame([("s", 0, "/w/a.rs", "one\ntwo\nthree"), ("s", 1, "/w/b.rs", "x\ny"), ("s", 2, "/w/a.rs", None)], "session_id string, edit_no int, file string, after string")
    lines = [("c", "a.rs", p, p + 7, t) for p, t in enumerate(["two", "one", "two", "three", "one"])] + [("c", "b.rs", 0, 1, "y"), ("d", "a.rs", 0, 1, "no")]
    added = spark.createDataFrame(lines, "sha string, file string, pos int, line_no int, content string").withColumn("hash", line_hash("content"))
    return edits, spark.createDataFrame([("s", "c"), ("s", "d")], "session_id string, sha string"), added


def test_no_line_is_moved_for_a_pair(spark):
    plan = edit_matches(*tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_runs_and_files_that_are_too_long(spark):
    def got(most):
        return {(r.edit_no, r.sha, r.file, r.line_start, r.line_end, len(r.content_hashes)) for r in edit_matches(*tables(spark), most_lines=most).collect()}

    assert got(5) == {(0, "c", "a.rs", 8, 10, 3), (1, "c", "b.rs", 1, 1, 1)}
    assert got(4) == {(1, "c", "b.rs", 1, 1, 1)}
    row = edit_matches(*tables(spark)).where("edit_no = 0").select(F.col("content_hashes")[2] == line_hash(F.lit("three"))).first()
    assert row[0]
