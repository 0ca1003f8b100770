import random
import re

import pytest

from tracewell.operators import matching


def like(line):
    return re.sub(r"\s+", " ", re.sub(r"\s+\Z", "", line).translate(str.maketrans("‘’“”", "''\"\"")))


def brute(edits, added):
    out = {}
    for i, file, after, start, end in edits:
        have = sorted((p, n, c) for f, p, n, c in added if f == file)
        if not have:
            continue
        for how, make in (("exact", str), ("normalized", like)):
            wanted, lines = [y for x in after if (y := make(x))], [make(c) for _, _, c in have]
            at = next((k for k in range(len(lines) - len(wanted) + 1) if wanted and lines[k : k + len(wanted)] == wanted), None)
            if at is not None:
                out[i] = (have[at][1], have[at + len(wanted) - 1][1], how)
                break
        else:
            n = max(0, end - start + 1)
            if n and max(0, min(end, have[-1][1]) - max(start, have[0][1]) + 1) * 2 >= n:
                out[i] = (have[0][1], have[-1][1], "proximity")
    return out


@pytest.mark.parametrize("together", [4096, 20])
def test_places_are_those_of_brute_force(spark, together):
    rng = random.Random(together)
    line = lambda: rng.choice(["a", "b", "a", " a", "a  b", "a b ", "“q”", '"q"', "", "}", "}"])
    added = [(f"f{k}", p, 10 + 2 * p, line()) for k in range(4) for p in range(rng.randrange(1, 40))]
    edits = [(i, "f0" if i % 2 else f"f{rng.randrange(5)}", [line() for _ in range(rng.randrange(1, 6))], s := rng.randrange(1, 60), s + rng.randrange(-2, 20)) for i in range(300)]
    frames = spark.createDataFrame(edits, "edit_id int, file string, after array<string>, line_start int, line_end int"), spark.createDataFrame(added, "file string, pos int, line_no int, content string")
    got = {r.edit_id: (r.match_start, r.match_end, r.strategy) for r in matching.match_edits(*frames, together=together).collect()}
    assert got == brute(edits, added) and {x[2] for x in got.values()} == {"exact", "normalized", "proximity"}


def test_a_file_of_ten_thousand_edits_and_equal_lines():
    import time

    lines = matching.Lines(["}"] * 5000 + [f"l{i}" for i in range(5000)] + ["}"] * 5000)
    began = time.perf_counter()
    for i in range(10_000):
        assert lines.find([f"l{i % 4999}", f"l{i % 4999 + 1}"]) == 5000 + i % 4999
    assert lines.find(["}"] * 5000) == 0 and lines.find(["}"] * 5001) is None and lines.find([]) is None and lines.find(["l4999", "}"]) == 9999
    assert time.perf_counter() - began < 30


def test_files_that_very_many_paths_are_called_like(spark):
    """All of 20 000 paths and 20 000 files have the same last part."""
    n = 20000
    paths = spark.range(n).selectExpr("id", "concat('/w/', id, '/a.rs') AS path")
    files = spark.range(n).selectExpr("concat(id % 10000, '/a.rs') AS file")
    got = {r.id: r.file for r in matching.locate_files(paths, files).collect()}
    want = {}
    for i in range(n):  # of five digits only the last four can be a file, or fewer where those begin with 0
        ends = [str(i)[k:] for k in range(len(str(i)))]
        want[i] = next(e for e in ends if int(e) < 10000 and str(int(e)) == e) + "/a.rs" if any(str(int(e)) == e and int(e) < 10000 for e in ends) else "a.rs"
    assert got == want


def test_files_by_ends_and_whole_paths(spark):
    paths = [(1, "src/a.rs"), (2, "/x/src/a.rs"), (3, "/x/osrc/a.rs"), (4, "a.rs"), (5, None), (6, "/x/"), (7, "é/b"), (7, "é/b"), (8, "/x/c.rs")]
    files = [("src/a.rs",), ("a.rs",), ("rs",), ("/",), ("/b",), (".rs",), (None,)]
    got = matching.locate_files(spark.createDataFrame(paths, "id long, path string"), spark.createDataFrame(files, "file string")).collect()
    assert sorted((r.id, r.file) for r in got) == [(1, "src/a.rs"), (2, "src/a.rs"), (3, "src/a.rs"), (4, "a.rs"), (6, "/"), (7, "/b")]
