import pytest
from helpers import docs

from tracewell.llm import mixing


def water(sizes):
    """Targets by raising the level step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        step = {s: min(share * weight[s], 2 * sizes[s] - target[s]) for s in open_}
        for s, x in step.items():
            target[s] += x
        left -= sum(step.values())
        open_ = {s for s in open_ if target[s] < 2 * sizes[s] - 1e-9}
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10, None: 300}, {"a": 5}, {"a": 0, "b": 7}, {"": 100, "A": 1, "a": 1, "é": 50, None: 0}])
def test_targets_are_filled_by_weight(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water(sizes)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def test_taken_words_come_near_the_targets_and_no_document_is_taken_too_often(spark):
    texts = [None, "", *(" ".join(["w"] * (1 + i * 7 % 40)) for i in range(600)), "z " * 20000]
    table = docs(spark, texts, extra=True)
    rows = mixing.mix(table).collect()
    assert len(rows) == len(texts) and all(r.taken == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in rows)
    assert [r.size for r in sorted(rows, key=lambda r: r.doc_id)][:3] == [0, 0, 1]
    again = {(r.doc_id, r.taken) for r in mixing.mix(table.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    by = {}
    for r in rows:
        by.setdefault((r.doc_id % 3, r.target), []).append(r)
    for (source, target), some in by.items():
        assert sum(r["size"] for r in some) == some[0].source_size
        assert abs(sum(r.taken for r in some) - target) <= max(r["size"] for r in some) / 2 + 1, (source, target)
    copies = mixing.mixed(table).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r["copies"] for r in rows if r["copies"]}


def test_repeated_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, None, "s")], "doc_id long, text string, source string")
    assert mixing.mix(rows).count() == 4
    assert mixing.mix(rows.limit(0)).count() == 0 and mixing.mixed(rows.limit(0)).count() == 0


def test_names_that_clash_and_many_sources(spark, monkeypatch):
    table = docs(spark, ["a b", "c", None, "d e f"] * 20, extra=True).withColumnsRenamed({"score": "copy", "row": "s", "items": "whole"})
    got = mixing.mixed(table)
    assert got.columns == [*table.columns, "copy_"] and {r["copy"] for r in got.collect()} == {0.5}
    few = sorted(map(str, mixing.mix(table).collect()))
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(map(str, mixing.mix(table).collect())) == few
    assert sorted(map(str, mixing.mixed(table).collect())) == sorted(map(str, got.collect()))
