import hashlib
import random
import re

import pytest
from helpers import docs
from pyspark.sql import functions as F

from tracewell.llm import fim

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "ab", "é", "日本語テキスト", "a<S>b", "x<P>", "<M>", "a<", "S>b<S", "\\x <|m|> \n\n", "𝄞 clef 𝄞", "one two\nthree\n\n four ", " \t lead", "\n\n\n", "z" * 40000 + "é" * 4001]


def plain_version(text, key, plain=10, spm=20):
    """The contract, over a str, a place at a time."""
    t = text or ""
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(t)
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_every_form_by_brute_force_and_exact_round_trip(spark):
    table = docs(spark, TEXTS * 12, extra=True)
    made = fim.fill_in_middle(table).withColumn("back", fim.restored(F.col("output"), F.col("form"))).select("row.*", "n", "form", "prefix_units", "middle_units", "output", "back").collect()
    assert len(made) == len(TEXTS) * 12 and made[0]["a.b"] == 1 and made[0]["items"] == "x"
    for r in made:
        text = (TEXTS * 12)[r.doc_id]
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_version(text, r.doc_id), r.doc_id
        assert r.back == (text or "")
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_query_over_the_whole_table(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = fim.op12(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, a, b, out = plain_version(texts[r.doc_id], r.doc_id)
        assert tuple(r) == (r.doc_id, n, form, a, b, sha(out), sha(texts[r.doc_id] or ""))


def test_null_and_repeated_ids_other_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "some text here", 1), (None, "some text here", 1), (4, "other", 2), (4, "another", 3)], "doc_id long, text string, output int")
    got = fim.fill_in_middle(rows).collect()
    for r in got:
        text = {1: "some text here", 2: "other", 3: "another"}[r.row.output]
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_version(text, "" if r.row.doc_id is None else r.row.doc_id)
    assert fim.fill_in_middle(rows.limit(0)).count() == 0
    assert fim.fill_in_middle(rows.select("text"), id_col="text").count() == 4


@pytest.mark.parametrize("units", fim.UNITS)
def test_units_begin_where_loops_say(units):
    for text in TEXTS:
        data, starts = (text or "").encode(), []
        if units == "code points":
            starts = [len((text or "")[:i].encode()) for i in range(len(text or ""))]
        elif units == "lines":
            at = 0
            for line in data.split(b"\n"):
                starts.append(at)
                at += len(line) + 1
            starts = [s for s in starts if s < len(data)]
        elif data:
            starts = sorted({0, *[m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)][1:]})
        bits = fim.unit_starts(data, units)
        assert [i for i in range(len(data)) if bits >> i & 1] == starts if len(data) < 2000 else bits.bit_count() == len(starts)
        for k in (0, 1, len(starts) // 2, len(starts) - 1, len(starts), len(starts) + 5):
            if k >= 0:
                assert fim.select(bits, k, len(data)) == (starts[k] if k < len(starts) else len(data))


def test_words_and_lines_round_trip_and_shares(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(40))) + "\n" * (i % 3) for i in range(600)]
    for units in ("words", "lines"):
        made = fim.fill_in_middle(docs(spark, texts), units=units, plain_percent=50, spm_percent=50).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert all(r.back == texts[r.row.doc_id] for r in made)
        forms = [r.form for r in made if texts[r.row.doc_id]]
        assert 0.4 < forms.count("plain") / len(forms) < 0.6 and 0.3 < forms.count("spm") / (len(forms) - forms.count("plain")) < 0.7
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs(spark, texts), units="sentences")
