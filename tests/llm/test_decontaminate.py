import random

import numpy as np
import pytest
from helpers import LOWER, WORDS, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import decontaminate as dc


def brute(text, items, width):
    words = WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = WORDS.findall((body or "").translate(LOWER))
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(words), hit, found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 4))
def test_index_finds_every_occurrence(symbols, n):
    text = np.array(symbols)
    index = dc.FMIndex(text)
    patterns = np.array([[1 + (k // 4**i) % 4 for i in range(n)] for k in range(4**n)])
    which, where = index.search(patterns)
    got = sorted(zip(which.tolist(), where.tolist(), strict=True))
    want = sorted((k, i) for k, p in enumerate(patterns.tolist()) for i in range(len(symbols) - n + 1) if symbols[i : i + n] == p)
    assert got == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_spans_and_items_are_those_of_brute_force(spark, block_bytes):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["Été", "naïve", "A1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 6])))) for i in range(12)] + [(3, None), (None, "w1 w2 w3")]
    texts = [None, "", "!!", "w1", "W1, w2; w3"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += [" . ".join(texts[9:20]), " ".join(["w1"] * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.row.doc_id: r for r in dc.contamination(docs(spark, texts, extra=True), bench, width=4, block_bytes=block_bytes, keep_text=True).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute(t, items, 4)
        r = got[i]
        assert r.text == t and r.n_words == n
        assert {k for s in r.spans for k in range(s["first"], s["last"])} == hit
        assert set(r["items"]) == {str(x) for x in found - {None}}
        assert all(a["last"] < b["first"] for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs(spark, ["a b"]), bench).first().spans == []
    assert dc.contamination(docs(spark, ["x"]).limit(0), bench).count() == 0


def test_spans_are_cut_out_of_the_text():
    assert dc.remove_spans("A b, c; d é!", [(1, 3)]) == "A ; d é!"
    assert dc.remove_spans("a b c", [(0, 3)]) == ""
    assert dc.remove_spans(None, [(0, 1)]) is None
    assert dc.remove_spans("Émile reste ici", [(0, 1)]) == " reste ici"


def test_item_ids_need_not_be_numbers(spark):
    bench = spark.createDataFrame([("b-2", "one two three"), ("a,1", "two three four"), ("b-2", "one two three")], "item_id string, text string")
    assert dc.contamination(docs(spark, ["zero one two three four"]), bench).first()["items"] == ["a,1", "b-2"]


def test_windows_of_a_whole_block_are_small():
    import pickle
    import tracemalloc

    rng = np.random.default_rng(5)
    words = np.array([f"word{i}" for i in range(200_000)])
    items = [(str(i), " ".join(words[np.minimum(rng.zipf(1.3, 2000), 200_000) - 1])) for i in range(400)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    windows = dc.Windows(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scale = dc.BLOCK_BYTES / size
    assert peak * scale < 300 << 20 and len(pickle.dumps(windows)) * scale < 100 << 20
    n, (starts, ends, owner) = next(iter(windows.by_length.items()))
    assert n == 10 and ends[-1] == len(owner) >= len(starts) and windows.items_of(10, 0)
