import random

import pytest

from tracewell.operators import history, maintenance
from tracewell.plans import materialize


def graph(seed, n=120):
    """(commit, parent, nth) of a history with branches, merges and several roots; parents are older."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        some = [] if c == 0 or rng.random() < 0.03 else [rng.randrange(max(0, c - rng.choice([1, 1, 1, 6, 30])), c)]
        if some and rng.random() < 0.2:
            some += [p for p in rng.sample(range(c), min(c, rng.randrange(1, 3))) if p not in some]
        rows += [(c, p, i) for i, p in enumerate(some)] or [(c, None, 0)]
    return rows


def closure(rows, seeds):
    up, todo, out = {}, list(seeds), set()
    for c, p, _ in rows:
        up.setdefault(c, []).append(p)
    while todo:
        c = todo.pop()
        if c is not None and c not in out:
            out.add(c)
            todo += up.get(c, [])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "commit_sha long, parent long, nth int")


def ids(spark, some):
    return spark.createDataFrame([(x,) for x in some], "commit_sha long")


def check(spark, rows, known):
    places = {(r.chain, r.place): r.commit_sha for r in known.collect()}
    assert len(places) == len({r[0] for r in rows})
    first = {c: p for c, p, i in reversed(rows) if i == 0}
    for (chain, place), c in places.items():  # a place's predecessor is its commit's first parent, a chain begins at place 0
        assert places[chain, place - 1] == first[c] if place else chain == c
    between = history.links(known, frame(spark, rows))
    for seeds in ([], [5], [119, 60], [50, 51, 52]):
        got = [r.commit_sha for r in history.reached(known, history.reach(known, between, ids(spark, seeds))).collect()]
        assert sorted(got) == sorted(closure(rows, seeds))


@pytest.mark.parametrize("seed", [1, 2])
def test_what_is_reached_is_what_a_walk_reaches(spark, seed):
    rows = graph(seed)
    check(spark, rows, history.labels(frame(spark, rows)))


def test_new_commits_leave_old_labels_as_they_are(spark):
    rows = graph(3)
    parts = [[r for r in rows if a <= r[0] < b] for a, b in ((0, 50), (50, 51), (51, 120))]
    known, before = None, {}
    for part in parts:
        known = history.extended(known, frame(spark, part))
        now = {r.commit_sha: (r.chain, r.place) for r in known.collect()}
        assert before.items() <= now.items()
        before = now
    check(spark, rows, known)


def test_a_range_is_numbered_by_age(spark):
    rows = graph(4)
    dated = spark.createDataFrame([(c, p, c // 3) for c, p, _ in rows], "commit_sha long, parent long, committed_at long")
    got = {r.pos: r.commit_sha for r in maintenance.commit_range(dated, ids(spark, [60]), ids(spark, [119, 100])).collect()}
    want = sorted(closure(rows, [119, 100]) - closure(rows, [60]), key=lambda c: (c // 3, c))
    assert got == dict(enumerate(want, 1))
    assert maintenance.commit_range(dated, ids(spark, [119]), ids(spark, [119])).count() == 0


def test_parents_without_a_row_and_a_circle(spark):
    rows = spark.createDataFrame([(1, 7), (2, 1)], "commit_sha long, parent long")
    assert {r.commit_sha for r in maintenance.closure(ids(spark, [2, 9]), rows).collect()} == {1, 2, 7, 9}
    with pytest.raises(ValueError):
        history.labels(spark.createDataFrame([(1, 2), (2, 1)], "commit_sha long, parent long"))


def test_rows_are_numbered_in_order(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "a long, b long").repartition(7)
    got = {r.n: (r.b, r.a) for r in materialize.numbered(rows, ["b", "a"], "n").collect()}
    assert got == dict(enumerate(sorted((i % 3, i * 7919 % 1000) for i in range(1000)), 1))
    assert materialize.numbered(rows.limit(0), ["a"], "n").count() == 0
