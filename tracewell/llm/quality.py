"""Quality classifier: a convolutional network over bytes, in numpy.

A byte is embedded in DIM learned numbers; FILTERS learned filters over WIDTH bytes move on by STRIDE.  Filter
outputs are max-pooled over overlapping chunks of 2 * HALF bytes (every HALF bytes) that cover the whole text, and each
chunk also has the largest share of its bytes that repeat the byte some lag earlier, which filters of a few bytes
can't see.  A document's chunks are combined by their mean and their maximum into one probability.

Training takes the whole texts of about `per_class` labelled documents of each class at most (chosen by a hash of the
id, rows of the held-out fold left out), fewer where they don't fit `most_bytes` together; scoring takes whole texts.
Both run on the same code.

Cases: null and empty texts are one chunk of padding and have a score like any other text.  Labels that are null are
left out.  Without labelled rows of both classes every score is the share of 1 among those there are, or 1 if none.
Extra columns are passed over; equal texts have equal scores.  A doc_id labelled 0 and 1 counts as both; its rows are
one document, that with the text of the smallest hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import beside_text, bounded_sample, fold, labelled_texts
from tracewell.plans.materialize import release

DIM, WIDTH, STRIDE, FILTERS, HALF = 6, 8, 4, 24, 256
LAGS = range(2, 41)
EPOCHS, BATCH = 14, 64
#: Bounds of what is learned from: labelled rows of a class, and bytes of all their texts.
PER_CLASS, MOST_BYTES = 1200, 32 << 20
FOLDS, HELD_OUT = 4, 2


#: Zeros before and after each text, so that no window and no lag reaches into another text.
BEFORE, AFTER = WIDTH - STRIDE, max(LAGS)


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole halves, one whole chunk at least, and the number of halves of each."""
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    halves = np.array([max(2, -(-(BEFORE + len(r) + AFTER) // HALF)) for r in raw])
    x = np.zeros(int(halves.sum()) * HALF, np.uint8)
    at = 0
    for r, n in zip(raw, halves.tolist(), strict=True):
        x[at + BEFORE : at + BEFORE + len(r)] = r
        at += n * HALF
    return x, halves


def _repeats(x: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """For each half: the largest share, over the lags, of its bytes that equal the byte so far before."""
    best = np.zeros(len(x) // HALF, np.float32)
    for lag in LAGS:
        same = np.zeros(len(x), np.uint8)
        np.equal(x[lag:], x[:-lag], out=same[lag:].view(bool))
        same &= x != 0
        np.maximum(best, same.reshape(-1, HALF).sum(axis=1, dtype=np.float32) / HALF, out=best)
    return best


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)),
            "filters": rng.normal(0, (DIM * WIDTH) ** -0.5, (DIM * WIDTH, FILTERS)),
            "shift": np.zeros(FILTERS),
            "mix": rng.normal(0, 0.1, 2 * (FILTERS + 1)),
            "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _windows(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][np.concatenate([x, np.zeros(WIDTH - STRIDE, np.uint8)])]
        return np.lib.stride_tricks.as_strided(e, (len(x) // STRIDE, WIDTH * DIM), (STRIDE * DIM * 4, 4))

    def _features(self, x: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, ...]:
        """A row for each half, and the position within the half of each filter's maximum."""
        out = np.ascontiguousarray(self._windows(x)) @ self.p["filters"]
        out = out.reshape(-1, HALF // STRIDE, FILTERS)
        return out, np.concatenate([np.maximum(out.max(axis=1) + self.p["shift"], 0), _repeats(x, halves)[:, None]], axis=1)

    @staticmethod
    def _starts(halves: np.ndarray) -> np.ndarray:
        return np.cumsum(halves) - halves

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; texts are taken a few hundred thousand bytes at a time."""
        out, i = np.empty(len(texts)), 0
        while i < len(texts):
            if len(texts[i]) > 1 << 20:
                out[i] = self._score_long(texts[i])
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 18) and len(texts[j]) <= 1 << 20:
                size += len(texts[j])
                j += 1
            x, halves = _padded(texts[i:j])
            out[i:j] = self._combine(self._features(x, halves)[1], halves)
            i = j
        return np.round(out, 5)  # what is beyond depends on which texts share a product of matrices

    def _score_long(self, text: bytes) -> float:
        """A very long text in parts; each part begins with the half before it, for the lags that look back."""
        rows, part = [], 1 << 18
        for at in range(0, len(text), part):
            before = HALF if at else 0
            x, halves = _padded([text[at - before : at + part + WIDTH]])
            f = self._features(x, halves)[1][before // HALF :]
            rows.append(f[: part // HALF] if at + part < len(text) else f)
        f = np.concatenate(rows)
        return float(self._combine(f, np.array([len(f)]))[0])

    def _combine(self, f: np.ndarray, halves: np.ndarray) -> np.ndarray:
        mean, top, _, _ = self._pool(f, halves)
        z = np.concatenate([mean, top], axis=1) @ self.p["mix"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def _pool(self, f: np.ndarray, halves: np.ndarray):
        """Chunks are two halves next to one another in a text; their mean and maximum for each text."""
        last = np.zeros(len(f), bool)
        last[np.cumsum(halves) - 1] = True
        left = np.flatnonzero(~last)
        chunks = np.maximum(f[left], f[left + 1])
        starts = np.cumsum(halves - 1) - (halves - 1)
        mean = np.add.reduceat(chunks, starts, axis=0) / (halves - 1)[:, None]
        return mean, np.maximum.reduceat(chunks, starts, axis=0), chunks, left

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                grads = self._gradients([texts[i] for i in some], labels[some], weights[some])
                step += 1
                rate = 0.01 * (1 - step / (total + 1))
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        x, halves = _padded(texts)
        out, f = self._features(x, halves)
        mean, top, chunks, left = self._pool(f, halves)
        pooled = np.concatenate([mean, top], axis=1)
        z = pooled @ self.p["mix"] + self.p["bias"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * weights / weights.sum()).astype(np.float32)
        g = {"mix": pooled.T @ dz + 1e-4 * self.p["mix"], "bias": dz.sum(keepdims=True)}
        n, doc = FILTERS + 1, np.repeat(np.arange(len(texts)), halves - 1)
        d_chunks = (dz / (halves - 1))[doc, None] * self.p["mix"][None, :n]
        at_top = chunks == top[doc]
        ties = np.add.reduceat(at_top, np.cumsum(halves - 1) - (halves - 1), axis=0).astype(np.float32)
        d_chunks = d_chunks + at_top * (dz[:, None] * self.p["mix"][None, n:] / ties)[doc]
        d_f = np.zeros_like(f)
        first = f[left] >= f[left + 1]
        np.add.at(d_f, left, d_chunks * first)
        np.add.at(d_f, left + 1, d_chunks * ~first)
        d_f = d_f[:, :FILTERS] * (f[:, :FILTERS] > 0)
        g["shift"] = d_f.sum(axis=0)
        # each filter's gradient goes to the window of its maximum
        best = out.argmax(axis=1)
        windows = self._windows(x)
        g["filters"], g["embed"] = np.zeros_like(self.p["filters"]), np.zeros_like(self.p["embed"])
        row = best + np.arange(len(best))[:, None] * (HALF // STRIDE)
        tail = np.concatenate([x, np.zeros(WIDTH - STRIDE, np.uint8)])
        for k in range(FILTERS):
            used = np.flatnonzero(d_f[:, k])
            if len(used):
                d, at = d_f[used, k], row[used, k]
                g["filters"][:, k] = windows[at].T @ d
                d_e = (d[:, None] * self.p["filters"][None, :, k]).reshape(-1, DIM)
                np.add.at(g["embed"], tail[(at[:, None] * STRIDE + np.arange(WIDTH)).ravel()], d_e)
        return g


class Constant:
    """Stands in where there is nothing to learn from."""

    def __init__(self, p: float):
        self.p = p

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.p)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text"):
    """Learns from labelled documents outside the held-out fold; per_class and most_bytes bound what comes to the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where((fold(F.col("id"), folds) != held_out) & F.col("y").isin(0, 1)).distinct()
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Constant(float(next(iter(counts), 1)))
    rows = labelled_texts(docs, bounded_sample(known, F.col("id"), F.col("y"), per_class, "quality", counts), id_col, text_col, most_bytes)
    release(docs.sparkSession)
    if len({y for _, y in rows}) < 2:
        return Constant(counts.get(1, 0) / sum(counts.values()))
    y = np.array([y for _, y in rows])
    taken = np.bincount(y, minlength=2)
    weights = np.array([counts[0] / taken[0], counts[1] / taken[1]])[y]  # the classes' shares among all labelled rows
    return Network().fit([t.encode("utf-8", "surrogatepass") for t, _ in rows], y, weights / weights.mean(), epochs=max(EPOCHS, min(60, 20000 // len(rows))))


def with_scores(docs: DataFrame, model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(row, text, score), see common.beside_text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(shared.value.score([(t or "").encode("utf-8", "surrogatepass") for t in texts]), pa.float64())]

    return beside_text(docs, text_col, "score double", run, keep_text)


def scores(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), a row for each row of docs."""
    thin = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_scores(thin, model, keep_text=False).select("row.doc_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` scored as `labels.quality` marks them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
