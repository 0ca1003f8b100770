import random

import numpy as np

from tracewell.operators import matching
from tracewell.plans import catalog


def made(spark, sessions, commits):
    rng = random.Random(5)
    s = [(f"s{i}", a := rng.randrange(0, 9000), a + rng.choice([0, 30, 2500])) for i in range(sessions)]
    c = [(i, rng.randrange(-500, 12000), rng.randrange(4)) for i in range(commits)]
    return s, c, spark.createDataFrame(s, "session_id string, start long, end long"), spark.createDataFrame(c, "sha long, committed_at long, score int")


def test_least_of_ranges():
    rank = np.random.default_rng(3).permutation(37)
    pairs = [(i, j) for i in range(37) for j in range(i + 1, 38)]
    got = matching._least(rank, *(np.array(x) for x in zip(*pairs, strict=True)))
    assert got.tolist() == [i + int(np.argmin(rank[i:j])) for i, j in pairs]


def test_totals_of_windows_over_several_blocks_and_parts(spark):
    s, c, sessions, commits = made(spark, 60, 300)
    want = {}
    for k, a, b in s:
        shas = [sha for sha, t, _ in c if a - 100 <= t <= b + 100]
        if shas:
            want[k] = (len(shas), min(shas), max(shas))
    for together in (7, 1000):
        got = matching.session_totals(sessions, commits, pad=100, block=700, together=together).collect()
        assert {r.session_id: (r.commits, r.first_sha, r.last_sha) for r in got} == want and len(got) == len(want)


def test_totals_of_very_many_commits_in_one_window(spark):
    """All sessions see all commits: 900 million pairs."""
    n = 30000
    sessions = spark.range(n).selectExpr("id AS session_id", "id % 60 AS start", "id % 60 AS end")
    commits = spark.range(n).selectExpr("id AS sha", "id % 600 AS committed_at")
    got = matching.session_totals(sessions, commits, together=8000)
    assert got.where(f"commits = {n} and first_sha = 0 and last_sha = {n - 1}").count() == n


def test_bests_of_windows_over_several_blocks_and_parts(spark):
    s, c, sessions, commits = made(spark, 60, 300)
    want = {}
    for k, a, b in s:
        of = [(-score, sha) for sha, t, score in c if a - 100 <= t <= b + 100]
        if of:
            want[k] = min(of)
    for together in (7, 1000):
        got = matching.best_commits(matching.session_bests(sessions, commits, "score", "sha", pad=100, block=700, together=together), score="score", pos="sha").collect()
        assert {r.session_id: (-r.score, r.sha) for r in got} == want and len(got) == len(want)


def test_outcomes_of_very_many_sessions_and_commits_in_one_window(spark, tmp_path):
    """All sessions see all commits: 400 million pairs."""
    n = 20000
    events = spark.range(n).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id % 3600) AS ts", "id AS user_id", "'purchase' AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.status: r.n for r in catalog.QUERIES["outcome_counts"](spark, str(tmp_path)).collect()}
    assert got == {"skipped-cross-author": n}  # everybody's best is a commit with sha % 5 = 4, one's own or the first


def test_a_window_is_one_row_and_is_met_once(spark):
    """Sessions of a day meet commits in one row each, in the pairs too; pieces of longer windows don't make pairs twice."""
    day = spark.range(40).selectExpr("id AS session_id", "id * 86400 AS start", "id * 86400 + 86399 AS end")
    assert matching._pieces(day, 14400, 2 * matching.BLOCK).count() == 40
    s, c, sessions, commits = made(spark, 60, 300)
    want = sorted((k, sha) for k, a, b in s for sha, t, _ in c if a - 100 <= t <= b + 100)
    for width in (None, 37, 5000):
        assert sorted((r.session_id, r.sha) for r in matching.session_commits(sessions, commits, pad=100, width=width).collect()) == want
    back = spark.createDataFrame([("x", 500, 200), ("y", None, 3)], "session_id string, start long, end long")
    assert matching.session_commits(back, commits, pad=100).count() == 0 and matching.session_totals(back, commits, pad=100).count() == 0
