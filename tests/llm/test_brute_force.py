"""Whole queries and trained models against versions written as loops."""

import math
import re

import numpy as np
import zstandard
from helpers import docs
from pyspark.sql import functions as F

from tracewell.llm import fingerprints, langid, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_languages_by_compressing_whole_texts(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(table)
    coders = []
    for d in model.dicts:
        raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(**langid.SEARCH)
        raw.precompute_compress(compression_params=how)
        coders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))
    got = {r.doc_id: r.lang_pred for r in langid.op4(spark, SF).collect()}
    for r in table.collect():
        text = " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split())
        if not text:
            assert got[r.doc_id] == "und"
            continue
        data, sizes = text.encode(), []
        for c in coders:
            n = 0
            for at in range(0, len(data), langid.BLOCK):
                n += len(c.compress(data[at : at + langid.BLOCK]))
            sizes.append(n)
        assert got[r.doc_id] == model.langs[sizes.index(min(sizes))], r.doc_id


def test_numbers_are_no_letters_and_many_languages_are_learned(spark):
    rows = [(i, f"wort{chr(97 + i % 26)} ding{i} haus", f"l{i}", "s", 1) for i in range(1100)] + [(5000 + i, t, None, "s", 1) for i, t in enumerate(("½", "²³", "Ⅷ ١٢", "x½"))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(table)
    assert len(model.langs) > 512 and sum(map(len, model.dicts)) <= langid.ALL_BYTES
    got = {r.doc_id: r.lang_pred for r in langid.predictions(table.where("doc_id >= 5000"), model).collect()}
    assert [got[5000 + i] for i in range(3)] == ["und"] * 3 and got[5003] != "und"


def test_training_texts_are_whole(spark):
    long = [" ".join(f"wort{chr(97 + (i + j) % 26)}{chr(97 + j % 26)}" for j in range(n)) for i, n in enumerate((30, 400, 3000, 9, 60))]
    rows = [(i, t, "de") for i, t in enumerate(long)] + [(99, " ".join(f"mot{chr(97 + j % 26)}" for j in range(2000)), "fr"), (99, "un mot", "fr"), (98, "", "it"), (97, None, "it")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, folds=7, held_out=6, dict_bytes=4000)
    in_dict = {lang: d.decode() for lang, d in zip(model.langs, model.dicts, strict=True)}
    whole = [t for i, t in enumerate(long) if i in {r.doc_id for r in table.where("lang = 'de'").where(langid.fold(F.col("doc_id"), 7) != 6).collect()}]
    taken = [t for t in whole if t in in_dict["de"]]
    assert taken and in_dict["de"] == " ".join(sorted(taken)) and len(in_dict["de"]) <= 4000
    assert in_dict["fr"] in ("un mot", "") or "un mot" in in_dict["fr"]
    only = langid.train(table.where("lang = 'fr' and length(text) > 100"), folds=7, held_out=6, dict_bytes=4000)
    assert [d.decode() for d in only.dicts] == [rows[5][1]]  # longer than a dictionary, and whole
    assert langid.fitting([(1, 10), (2, 5000), (3, 90), (4, 30)], 100) == [1, 4]


def loops(net, text):
    """A document's probability, a byte and a filter at a time."""
    p, half = net.p, quality.HALF
    n = max(2, -(-(quality.BEFORE + len(text) + quality.AFTER) // half))
    x = [0] * quality.BEFORE + list(text)
    x += [0] * (n * half + quality.WIDTH - len(x))
    rows = []
    for h in range(n):
        best = np.full(quality.FILTERS, -np.inf, np.float64)
        for at in range(h * half, (h + 1) * half, quality.STRIDE):
            seen = np.concatenate([p["embed"][x[at + j]] for j in range(quality.WIDTH)]).astype(np.float64)
            best = np.maximum(best, seen @ p["filters"])
        share = max(sum(x[i] != 0 and i >= lag and x[i] == x[i - lag] for i in range(h * half, (h + 1) * half)) / half for lag in quality.LAGS)
        rows.append(np.append(np.maximum(best + p["shift"], 0), share))
    chunks = [np.maximum(a, b) for a, b in zip(rows, rows[1:], strict=False)]
    z = float(np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ p["mix"] + p["bias"][0])
    return 1 / (1 + math.exp(-z))


def test_network_by_loops(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.op7(spark, SF).collect()}
    rows = sorted(table.collect(), key=lambda r: len(r.text or ""))
    for r in [*rows[:4], *rows[50:55], *rows[-3:]]:
        assert abs(loops(model, (r.text or "").encode()[:]) - got[r.doc_id]) < 2e-4 or len(r.text) > 30_000, r.doc_id


def test_classifier_by_loops(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.op8(spark, SF).collect()}
    names = model.wanted.names
    for r in table.collect():
        text = r.text or ""
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        z = model.w[-1]
        for i, name in enumerate(names):
            begin, star, n = name.partition("*")
            z += model.w[i] * (sum(w.startswith(begin) for w in words) >= int(n) if star else name in words)
        caps = re.search(r"(?:\b[A-Z]{3,}\b[^A-Za-z]+){4}", text)
        votes = [caps, re.search("!!+", text), re.search(r"\b\w+[*#@$]{2,}\w+\b", text), words & {"you", "your", "du", "dein", "tu", "ton", "vous", "usted"}, re.search(r"\?\?+", text)]
        z += sum(model.w[len(names) + j] for j, v in enumerate(votes) if v)
        assert abs(1 / (1 + math.exp(-max(-30, min(30, z)))) - got[r.doc_id]) < 1e-9, r.doc_id


def test_label_model_by_loops():
    rng = np.random.default_rng(3)
    v, weight, labels = rng.integers(-1, 2, (40, 5)).astype(np.int8), rng.random(40) + 0.5, rng.integers(-1, 2, 40)
    model = toxicity.LabelModel().fit(v, weight, labels, rounds=3)
    known = labels >= 0
    prior, p = None, None

    def maximise(post):
        total, toxic, table = 0.0, 0.0, [[[0.2, 0.2, 0.2] for _ in range(5)] for _ in (0, 1)]
        for row, w, q in zip(v, weight, post, strict=True):
            total, toxic = total + w, toxic + w * q
            for m, vote in enumerate(row):
                table[0][m][vote + 1] += w * (1 - q)
                table[1][m][vote + 1] += w * q
        return min(0.6, max(0.005, toxic / total)), [[[x / sum(t) for x in t] for t in side] for side in table]

    def posterior(row):
        odds = math.log(prior / (1 - prior)) + sum(model.discount[m] * math.log(p[1][m][vote + 1] / p[0][m][vote + 1]) for m, vote in enumerate(row) if vote)
        return 1 / (1 + math.exp(-odds))

    use = weight * known
    keep, weight = weight, use
    prior, p = maximise([max(0, x) for x in labels])
    weight = keep
    for _ in range(3):
        prior, p = maximise([label if label >= 0 else posterior(row) for row, label in zip(v, labels, strict=True)])
    assert np.allclose(model.posterior(v), [posterior(row) for row in v], atol=1e-9)


def test_fingerprints_run_without_python_workers(spark):
    plan = fingerprints.op1(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stages_of_odd_tables(spark, tmp_path):
    import pytest

    pipeline = pytest.importorskip("corpus_pipeline")
    table = docs(spark, [None, "", "fine words here and there", "you stupid idiot", "z " * 30000, "fine words here and there", *(f"text number {i} says {i * i} things" for i in range(30))], extra=True)
    spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(20)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "fine words here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        assert out.columns[: len(table.columns)] == table.columns, name
        rows = {str(r) for r in table.collect()}
        assert {str(r) for r in out.select(*(f"`{c}`" for c in table.columns)).collect()} <= rows, name
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0, name
