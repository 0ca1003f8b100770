import pytest
from helpers import near_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows that each stage got and gave, each stage written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        out.append((name, given, docs.collect()))
    return out


def test_stages_keep_rows_as_they_are(steps):
    for name, given, kept in steps[:-1]:
        assert set(kept) <= set(given), name
        assert 0 < len(kept) < len(given) or name == "benchmark decontamination"


def test_near_duplicates_by_brute_force(steps):
    _, given, kept = steps[2]
    given = sorted(given, key=lambda r: r.doc_id)
    roots = near_components([r.text for r in given], 5, 80)
    assert sorted(r.doc_id for r in kept) == [r.doc_id for i, r in enumerate(given) if roots[i] == i]


def test_documents_that_are_rejected_are_those_of_the_scores(steps, spark):
    from tracewell.llm import quality, toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for (name, given, kept), module, keeps in zip(steps, (quality, toxicity), (lambda x: x >= 0.7, lambda x: x < 0.5), strict=False):
        table = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        model = module.train(table, labels)
        made = [t or "" for t in (r.text for r in given)]
        scores = model.score([t.encode() for t in made] if module is quality else made)
        assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r, x in zip(given, scores, strict=True) if keeps(x)), name


def test_benchmark_passages_are_gone(steps, spark):
    from helpers import LOWER, WORDS

    _, given, kept = steps[3]
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORDS.findall((r.text or "").translate(LOWER))
        n = min(len(w), 10)
        windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0))
    ids = {r.doc_id for r in kept}
    for r in given:
        w = WORDS.findall((r.text or "").translate(LOWER))
        hit = any(tuple(w[i : i + n]) in some for n, some in windows.items() if n for i in range(len(w) - n + 1))
        assert hit != (r.doc_id in ids), r.doc_id


def test_mix_repeats_rows(steps):
    _, given, kept = steps[4]
    assert {r[:5] for r in map(tuple, kept)} <= {tuple(r) for r in given}
    assert sum(len(r.text.split()) for r in kept) == pytest.approx(1.5 * sum(len(r.text.split()) for r in given), rel=0.1)


def test_run_gives_what_the_stages_give(steps, spark):
    assert sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.copy) for r in steps[-1][2])
