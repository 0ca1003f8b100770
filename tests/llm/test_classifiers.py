import numpy as np
import pytest
from helpers import docs

from tracewell.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_labels(spark):
    got = quality.op7(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean()) > 0.93 and got.score.between(0, 1).all()


def test_toxicity_on_held_out_labels(spark):
    got = toxicity.op8(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.toxic).mean()) > 0.93 and got.score.between(0, 1).all()
    assert got[got.toxic == 0].predicted.mean() < 0.03


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(1)
    net = quality.Network(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["embed"] = net.p["embed"].astype(np.float32)
    texts, y, w = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (40, 700, 1200)], np.array([1, 0, 1]), np.ones(3)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    g = net._gradients(texts, y, w)

    def loss():
        p = np.clip(net.score(texts), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5e-4 * float((net.p["mix"] ** 2).sum())

    for name in ("mix", "bias", "shift", "filters", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, step = net.p[name][at], 2e-3
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.15, abs=2e-4)


def test_whole_text_counts_and_long_texts_are_taken_in_parts():
    net = quality.Network()
    a, b = b"x" * 5000 + b"END$$$" + b"y" * 100, b"x" * 5000 + b"end..." + b"y" * 100
    assert net.score([a])[0] != net.score([b])[0]
    long = bytes(np.random.default_rng(2).integers(97, 123, 600_000).astype(np.uint8))
    assert net._score_long(long) == pytest.approx(net.score([long])[0], abs=1e-3)
    assert np.allclose(net.score([b"", b"a", long[:3000]]), [net.score([x])[0] for x in (b"", b"a", long[:3000])], atol=2e-5)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_tables(spark, module):
    table = docs(spark, [None, "", "fine words here", "you stupid idiot", "z" * 70000, "fine words here"], extra=True)
    some = labels(spark, [(i, i % 2, i % 2) for i in range(6)] + [(2, 0, 0), (None, 1, 1), (3, None, None), (99, 1, 1)])
    model = module.train(table, some)
    got = {r.doc_id: r.score for r in module.scores(table, model).collect()}
    assert len(got) == 6 and all(0 <= x <= 1 for x in got.values()) and got[2] == got[5]
    with_row = module.with_scores(table, model)
    assert with_row.select("row.score", "row.`a.b`", "score").count() == 6
    for none in (some.limit(0), labels(spark, [(1, 1, 1)])):
        assert module.scores(table, module.train(table, none)).count() == 6
    assert module.scores(table.limit(0), module.train(table.limit(0), some)).count() == 0


def test_label_model_discounts_voters_that_say_the_same():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    good = [np.where(rng.random(3000) < 0.85, y, ~y) for _ in range(3)]
    twin = np.where(rng.random(3000) < 0.6, y, ~y)
    v = np.stack([*good, twin, twin, twin, twin], 1).astype(np.int8) * 2 - 1
    model = toxicity.LabelModel().fit(v, np.ones(3000), np.where(np.arange(3000) < 400, y, -1))
    assert model.discount[3:].max() < model.discount[:3].min()
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.88


def test_mined_terms_need_distinct_documents():
    found = [{"bad*1", "x"}] * 6 + [{"ok"}] * 30 + [{"copy"}] * 9
    y = np.array([1] * 6 + [0] * 30 + [1] * 9)
    weight = np.array([1.0] * 36 + [1 / 9] * 9)
    chosen, _ = toxicity.mine(found, y, weight)
    assert "bad*1" in chosen and "copy" not in chosen
