import hashlib
import re
import unicodedata

import pytest
from helpers import docs
from pyspark.sql import functions as F

from tracewell.llm import fingerprints as fp


def canon(t):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", n(n(t or "").casefold())).strip(" ")


@pytest.mark.parametrize("bits", [64, 3])
def test_equal_canonical_texts_and_only_they_have_equal_fingerprints(spark, bits):
    texts = [None, "", "a", "A", "b", " a\t", "Straße", "STRASSE", "ﬁ x", "fi  X", "é", "é", "日本 語", "日本　語", "x" * 100001, "aa", "aa", "zz yy", "ab", "ba"]
    got = {r.doc_id: r for r in fp.fingerprints(docs(spark, texts, extra=True), bits=bits).collect()}
    seen = {}
    order = list(range(len(texts)))[::-1]
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + following[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == (canon(text) == canon(edited)) and r.near_next == (canon(text) == canon(following))
        for f, c in ((r.fingerprint, canon(text)), (r.edited_fingerprint, canon(edited))):
            assert seen.setdefault(c, f) == f
    assert len(set(seen.values())) == len(seen)


def test_the_next_document_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)
    ids = [i * i * 13 for i in range(1, 200)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "key long, text string")
    got = {r.key: r.next.key for r in fp.with_next(rows).collect()}
    assert got == {**dict(zip(ids[1:], ids, strict=False)), ids[0]: ids[-1]}


def test_ids_repeated_null_or_missing(spark):
    rows = spark.createDataFrame([(5, "same"), (5, "same"), (None, "nul"), (7, "one")], "doc_id long, text string")
    got = fp.fingerprints(rows).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "7", "None"]
    assert fp.fingerprints(docs(spark, ["a"]).limit(0)).count() == 0
    assert fp.fingerprints(docs(spark, ["abcd"])).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_bisection_counts_bounds(spark):
    bounds = [-5, 0, 3, 3 << 40]
    keys = [-9, -5, -1, 0, 2, 3, 4, 3 << 40, (3 << 40) + 1]
    df = spark.createDataFrame([(k,) for k in keys], "key long").withColumn("b", fp._bucket(F.col("key"), bounds))
    assert {r.key: r.b for r in df.collect()} == {k: fp.bucket_of(k, bounds) for k in keys}


@pytest.mark.parametrize("hot", [None, "x7", 42])
def test_half_of_the_ids_null_or_equal_are_cut_into_buckets(spark, hot):
    texts = [f"text {i % 400}" for i in range(900)] + ["the same"] * 900
    rows = [(hot if i % 2 else str(i), t) for i, t in enumerate(texts)]
    got = fp.fingerprints(spark.createDataFrame([(None if k is None else str(k), t) for k, t in rows], "doc_id string, text string"), bucket_rows=50).collect()
    number = lambda k: int(k) if k is not None and str(k).isdigit() else None
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((number(k) or 0, len(t)) for k, t in rows)
    # each row is followed by one other, and each follows one: of the hot id, all but one by a row of that id
    base = spark.createDataFrame([(number(k) if number(k) is not None else fp.LEAST, t) for k, t in rows], "key long, text string")
    pairs = fp.with_next(base, 50).select("key", "text", "copies", F.col("next.key").alias("k"), F.col("next.text").alias("t")).collect()
    before, after = {}, {}
    for r in pairs:
        before[r.key, r.text] = before.get((r.key, r.text), 0) + r.copies
        after[r.k, r.t] = after.get((r.k, r.t), 0) + r.copies
    assert before == after and sum(before.values()) == len(rows)
    key = number(hot) if number(hot) is not None else fp.LEAST
    assert sum(r.copies for r in pairs if r.key == key != r.k) == 1
    assert len([r for r in pairs if r.key == key]) < 500  # equal rows are one
    _, tied = fp.bounds_of(base.agg(F.percentile_approx("key", F.array(*(F.lit(i / 36) for i in range(1, 36))), 144)).first()[0])
    assert tied == [key]


def test_white_space_of_any_kind_is_one_space(spark):
    texts = ["a b", *(f"a{c}b" for c in "\x85\x1c\x1d\x1e\x1f\u2028\u3000\xa0\t\v"), " a \x85 b\x1f"]
    got = {r.fingerprint for r in fp.fingerprints(docs(spark, texts)).collect()}
    assert len(got) == 1
