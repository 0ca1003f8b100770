import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import WHITE, docs

from tracewell.llm import substrings

SF = "/root/testdata/sf0.001"


def plain_version(texts, window):
    """(n_words, n_removed, kept) of each text, a window at a time."""
    words = [WHITE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def made_texts(seed, n=60):
    rng = random.Random(seed)
    shared = [[f"s{j}x{rng.randrange(50)}" for _ in range(rng.randrange(3, 90))] for j in range(8)]
    texts = [None, "", "  \t\n", "one", "a " * 500, "a b " * 40, "x" * 5000 + " y"]
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            w += [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
            some = rng.choice(shared)
            a = rng.randrange(len(some))
            w += some[a:] if rng.random() < 0.5 else some
        texts.append((" " if i % 2 else "\n\t").join(w))
    return [*texts, texts[9], texts[9], texts[11], texts[20] + " tail", "head " + texts[21]]


SMALL = substrings.Bounds(group=40, slots=64, words=300, suffixes=90, segment=50)  # so that every boundary is met


@pytest.mark.parametrize(("window", "bounds"), [(35, substrings.Bounds()), (35, SMALL), (5, SMALL), (2, SMALL)])
def test_texts_are_those_of_brute_force(spark, window, bounds):
    texts = made_texts(window)
    got = substrings.without_repeats(docs(spark, texts, extra=True), window, bounds=bounds).collect()
    want = plain_version(texts, window)
    assert len(got) == len(texts) and got[0].row["a.b"] == 1 and got[0].row.items == "x"
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.row.doc_id], r.row.doc_id
    assert any(0 < b < a for a, b, _ in want) and any(b == a > 0 for a, b, _ in want)


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_version([r.text for r in rows], 35)
    got = {r.doc_id: r for r in substrings.op11(spark, SF).collect()}
    for r, (n, removed, kept) in zip(rows, want, strict=True):
        assert tuple(got[r.doc_id]) == (r.doc_id, n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_null_and_equal_ids_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(None, long), (None, long), (1, long + " end"), (1, "short"), (1, "short")], "doc_id long, text string")
    got = sorted((r.row.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(rows).collect())
    assert got == [(0, 50, 50, ""), (0, 50, 50, ""), (1, 1, 0, "short"), (1, 1, 0, "short"), (1, 51, 50, "end")]
    assert substrings.without_repeats(rows.limit(0)).count() == 0
    assert [r.kept for r in substrings.without_repeats(spark.createDataFrame([(None,), ("a  b",)], "text string")).collect()] in (["", "a b"], ["a b", ""])


def test_a_passage_of_very_many_texts_is_one_suffix_a_task_and_long_prefixes_split(spark):
    head = [f"h{i}" for i in range(24)]
    texts = [" ".join([*head, *(f"t{(i // 2) * 100 + j}" for j in range(30))]) for i in range(800)]
    got = substrings.without_repeats(docs(spark, texts), bounds=substrings.Bounds(group=500, slots=64)).collect()
    want = plain_version(texts, 35)
    assert all((r.n_words, r.n_removed, r.kept) == want[r.row.doc_id] for r in got)
    h = [substrings.word_hashes(t.encode()) for t in texts[::2]]
    p = substrings.Parts([(i, 0, x) for i, x in enumerate(h)], 35)
    at = np.flatnonzero(p.valid & (p.place[: len(p.valid)] == 0))
    levels = [p.run(k)[at] for k in substrings.prefixes(35)]
    counts = np.array([np.bincount(substrings._slot(x, 64), minlength=64) for x in levels])
    full = substrings.overfull(counts, 100)
    assert full[0].any() and full[1].any() and full[2].any() and not full[-1].any()
    groups = substrings._of_group(levels, full, 16)
    assert np.bincount(groups, minlength=16).max() < 60


def test_words_are_hashed_alike_everywhere():
    words = ["a", "b", "ab", "ba", "x" * 64, "x" * 65, "é", "日本", "\x00", "\x1c"]
    one = [int(substrings.word_hashes(w.encode())[0]) for w in words]
    assert len(set(one)) == len(words)
    assert [int(x) for x in substrings.word_hashes((" \t\n".join(words) + "\r").encode())] == one
    x = np.array([5, 3, 9, 1, 7, 2, 8], np.uint64)
    for n in range(1, 8):
        assert substrings._sliding(x, n, np.minimum).tolist() == [min(x[i : i + n].tolist()) for i in range(8 - n)]
    assert substrings.deep_leaves(np.array([1, 2, 1, 1], np.uint64), np.array([5, 5, 6, 5], np.uint64)).tolist() == [True, False, False, True]
