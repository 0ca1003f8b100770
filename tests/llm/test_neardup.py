import random

import numpy as np
import pytest
from helpers import docs, near_components, shingles

from tracewell.llm import neardup


def made_texts(seed, groups=6, size=9, n=60):
    rng = random.Random(seed)
    texts = [None, "", "  \t\n", "one", "One", "two words", "Two  words", "x" * 50000]
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(n)] = f"z{rng.randrange(99)}"
            texts.append(" ".join(copy))
    return [*texts, texts[10], texts[11], " ".join(f"w{i}" for i in range(30000))]


@pytest.mark.parametrize(("width", "numerator", "block"), [(3, 85, 1024), (5, 80, 4), (3, 85, 3)])
def test_components_are_those_of_all_pairs(spark, width, numerator, block):
    texts = made_texts(width)
    found = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts, extra=True), width, numerator, block=block).collect()}
    want = near_components(texts, width, numerator)
    assert [found[i].component_id for i in range(len(texts))] == want
    assert [found[i].n_shingles for i in range(len(texts))] == [len(shingles(t, width)) for t in texts]
    assert all(found[i].kept == (want[i] == i) for i in range(len(texts)))


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for _ in range(4):  # copies lie on either side of the threshold to one another
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = neardup.near_duplicates(docs(spark, texts), 3, 85, block=64).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(near_components(texts, 3, 85)))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (None, None, True)], key=str)
    empty = neardup.near_duplicates(docs(spark, []).limit(0))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_odd_sketches_estimate_high_similarities():
    words = neardup._WordHashes()
    a = " ".join(f"w{i}" for i in range(2000))
    b = " ".join(f"w{i}" if i % 20 else f"v{i}" for i in range(2000))
    sets = [neardup.shingle_set(t, 1, words) for t in (a, b)]
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    _, sketch = neardup._bands_and_sketches(neardup._min_hashes(sets))
    flips = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    assert abs(neardup.estimate(flips) - true) < 0.12
    assert neardup.estimate(neardup.flips_at(0.9)) == pytest.approx(0.9)


def test_chains_of_links_are_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40) if i != 20], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_a_pair_whose_sketches_differ_by_chance_is_found(spark):
    common = [f"c6848x{j}" for j in range(17)]
    texts = [" ".join(common), " ".join([*common, *(f"e6848x{j}" for j in range(3))])]  # 17 of 20 words, 62 flips
    got = neardup.near_duplicates(docs(spark, texts), width=1, numerator=85).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("threshold", [0.85, 0.8, 0.5, 1.0])
def test_the_flip_bound_misses_no_more_than_the_bands(threshold):
    rates, bound, bands = neardup.miss_rates(threshold), neardup._flip_bound(threshold), (1 - threshold**neardup.ROWS) ** neardup.BANDS
    assert len(rates) == neardup.SKETCH_BITS + 1 and rates[bound] <= bands and (bound == 0 or rates[bound - 1] > bands)
    rng = np.random.default_rng(7)
    flips = []
    for k in rng.binomial(neardup.SAMPLES, 1 - threshold, 4000):
        flips.append(int((np.bincount(rng.integers(0, neardup.SKETCH_BITS, 2 * k), minlength=neardup.SKETCH_BITS) & 1).sum()))
    for at in (20, 40, 60, 80):
        assert abs(np.mean(np.array(flips) > at) - rates[at]) < 0.04


def test_an_id_of_several_texts_is_the_one_of_the_smallest_hash(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "one two")
    rows = spark.createDataFrame([(5, a), (5, b), (2, a), (3, b), (4, c), (5, None), (9, "x"), (9, "x")], "doc_id long, text string")
    first = min((r for r in rows.where("doc_id = 5").selectExpr("text", "xxhash64(text) h").collect()), key=lambda r: r.h).text
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows).collect()), key=str)
    own = {a: 2, b: 3, None: 5}[first]
    want = [(2, 3, 2), (3, 3, 3), (4, 1, 4), (5, 3, own), (5, 3, own), (5, 0, own), (9, 1, 9), (9, 1, 9)]
    assert got == sorted(want, key=str)


def test_ids_that_are_no_numbers_are_null(spark):
    rows = spark.createDataFrame([("x1", "a b c d"), ("7", "a b c d")], "doc_id string, text string")
    assert sorted(map(str, neardup.near_duplicates(rows).select("doc_id", "component_id", "kept").collect())) == ["Row(doc_id=7, component_id=7, kept=True)", "Row(doc_id=None, component_id=None, kept=True)"]


def test_pointers_reach_their_ends(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40) if i != 20] + [(100, 0), (101, 100)], "a long, b long")
    at, n = neardup.roots(links)
    got = {r.id: r.component for r in at.collect()}
    assert got == {**{i: 0 if i <= 20 else 21 for i in range(41)}, 100: 0, 101: 0} and n == len(got)
    more, n = neardup.joined(at, n, spark.createDataFrame([(30, 5), (5, 30), (7, 200), (300, 301), (1, 2)], "a long, b long"))
    got = {r.id: r.component for r in more.collect()}
    assert got == {**dict.fromkeys([*range(41), 100, 101, 200], 0), 300: 300, 301: 300} and n == len(got)


def test_hot_keys_are_dealt_into_parts(spark, monkeypatch):
    texts = made_texts(8, groups=3, size=12)
    want = near_components(texts, 3, 85)
    monkeypatch.setattr(neardup, "TOGETHER", 2)
    monkeypatch.setattr(neardup, "SMALL", 0)
    monkeypatch.setattr(neardup, "small", lambda df, n: df)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts), 3, 85, block=4).collect()}
    assert [got[i] for i in range(len(texts))] == want
