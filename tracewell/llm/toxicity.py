"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1.  Voters.  Seed lexicons and patterns are stated below.  Further lexicon voters are mined from labelled rows outside
    the held-out fold: a term is a word, or a word beginning of 4 to 6 letters of which 1, 2 or 3 different words occur
    in the document; terms are taken greedily while they cover enough toxic documents that no earlier one covers and
    hardly any clean one.  Near copies count as one document.  One voter votes "clean" where no lexicon votes.
2.  Label model.  Each voter has, for either class, probabilities of its votes (toxic, clean, none).  They are
    estimated by expectation maximisation over labelled rows, whose class is given, and unlabelled ones together; a voter
    that doesn't vote gives no evidence.  From
    the residuals given the class, of labelled rows if there are any, come the voters' correlations; a voter's evidence is divided by one plus the squares of
    its positive correlations, so voters that say the same thing don't count twice.
3.  Classifier.  A logistic regression over terms and patterns learns the posterior labels.

Learning takes the whole texts of about `per_class` labelled rows of each class at most and as many rows of any kind,
chosen by a hash of the id; fewer where they don't fit `most_bytes` together.  Scoring takes whole texts.

Cases: null and empty texts have no term and no pattern, and get the score of the bias.  Null labels are left out.
Without labelled rows of both classes only the seeds vote.  Equal texts have equal scores.  Rows of one doc_id are one
document to learn from, that with the text of the smallest hash.  Extra columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import beside_text, bounded_sample, fold, labelled_texts
from tracewell.plans.materialize import release

FOLDS, HELD_OUT = 5, 0
#: Bounds of what is learned from: labelled rows of a class (and rows of any kind), and bytes of all their texts.
PER_CLASS, MOST_BYTES = 1500, 48 << 20
#: Lexicon voters that are mined at most, and telling terms that the classifier looks at.
VOTERS, POOL = 60, 2000
PREFIXES, LEVELS = (4, 5, 6), 3
#: Seed lexicons of plain insults: one voter each.
SEEDS = {
    "en": "stupid idiot moron loser trash scum worthless pathetic disgusting",
    "de": "dumm idiot trottel abschaum wertlos widerlich",
    "fr": "stupide idiot crétin ordure minable dégoûtant",
    "es": "estúpido idiota imbécil escoria patético asqueroso",
}
_SHOUTED, _SHOUTING, _MASKED = re.compile(r"[A-Z]{3}"), re.compile(r"(?:\b[A-Z]{3,}\b[^A-Za-z]+){4}"), re.compile(r"\w[*#@$]{2,}\w")
_ADDRESSES = frozenset("you your du dein tu ton vous usted".split())
#: Patterns of a text and its lower-case words: one voter each.
PATTERNS = {
    "shouting": lambda text, words: _SHOUTED.search(text) is not None and _SHOUTING.search(text) is not None,
    "exclaiming": lambda text, words: "!!" in text,
    "masked word": lambda text, words: _MASKED.search(text) is not None,
    "addressing": lambda text, words: not _ADDRESSES.isdisjoint(words),
    "question run": lambda text, words: "??" in text,
}
_WORD = re.compile(r"[^\W\d_]+")
_SEED_WORDS = {lang: frozenset(words.split()) for lang, words in SEEDS.items()}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms(text: str | None, wanted=None) -> set[str]:
    """Words, and word beginnings as `begin*n` if at least n different words of the text have them; with `wanted` only
    words and beginnings that it names."""
    words = words_of(text)
    if wanted is not None:
        return {wanted.names[i] for i in wanted.numbers(words)}
    begins = Counter(w[:n] for w in words for n in PREFIXES if len(w) >= n)
    return words | {f"{p}*{n}" for p, k in begins.items() for n in range(1, min(k, LEVELS) + 1)}


def _cluster(text: str) -> int:
    """The least word hash but for rounding: near copies mostly agree."""
    return min((xxhash.xxh3_64_intdigest(w) for w in set(text.lower().split())), default=0)


class Wanted:
    """Terms by number, and what each word means to them."""

    def __init__(self, names):
        self.names = list(names)
        self.index = {t: i for i, t in enumerate(self.names)}
        # for each beginning, the numbers of its terms by how many words they ask for
        self.begins: dict[str, list[int | None]] = {}
        for t, i in self.index.items():
            begin, star, n = t.partition("*")
            if star:
                self.begins.setdefault(begin, [None] * LEVELS)[int(n) - 1] = i
        self.known: dict[str, tuple | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def _look(self, word: str) -> tuple | None:
        found = (self.index.get(word), *(word[:n] for n in PREFIXES if len(word) >= n and word[:n] in self.begins))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = found = found if found != (None,) else None
        return found

    def numbers(self, words: set[str]) -> list[int]:
        """Numbers of the terms that these words make."""
        known, out, begins = self.known, [], {}
        for w in words:
            found = known[w] if w in known else self._look(w)
            if found is not None:
                if found[0] is not None:
                    out.append(found[0])
                for p in found[1:]:
                    begins[p] = begins.get(p, 0) + 1
        for p, k in begins.items():
            out += [i for i in self.begins[p][:k] if i is not None]
        return out


def _least(n_bad: float) -> float:
    """Toxic documents, copies counting once, that a term needs."""
    return max(2.5, 0.004 * n_bad)


def _telling(bad: dict, good: dict, n_bad: float, n_good: float) -> list[str]:
    """Terms with enough support and far more frequent among toxic documents, the best first."""
    least = _least(n_bad)
    found = [x for x, k in bad.items() if k >= least and (k + 0.1) / n_bad > 25 * (good.get(x, 0) + 0.3) / n_good]
    return sorted(found, key=lambda x: (-bad[x] / (1 + 3 * good.get(x, 0) * n_bad / n_good), -len(x), x))


def _candidates(texts: list[str], y: np.ndarray, weight: np.ndarray, pool: int = POOL) -> set[str]:
    """The telling terms, found without holding the terms of all documents: first hashes are counted, then the terms
    whose hash has enough support, then those among clean documents."""
    toxic, clean = (np.flatnonzero(y == c).tolist() for c in (1, 0))
    if not toxic or not clean:
        return set()
    n_bad, n_good = (max(weight[y == c].sum(), 1) for c in (1, 0))
    hashes = [np.fromiter(map(hash, terms(texts[i])), np.int64) for i in toxic]
    names, at = np.unique(np.concatenate(hashes), return_inverse=True)
    support = np.bincount(at, np.repeat(weight[toxic], [len(h) for h in hashes]), minlength=len(names))
    often = set(names[support >= _least(n_bad) - 1e-9].tolist())
    bad: Counter = Counter()
    for i in toxic:
        for x in terms(texts[i]):
            if hash(x) in often:
                bad[x] += weight[i]
    wanted, good = Wanted(sorted(bad)), Counter()
    for i in clean:
        for x in terms(texts[i], wanted):
            good[x] += weight[i]
    return set(_telling(bad, good, n_bad, n_good)[:pool])


def mine(found: list[set[str]], y: np.ndarray, weight: np.ndarray, most: int = VOTERS, pool: int = POOL) -> tuple[list[str], list[str]]:
    """Terms that cover the toxic documents (lexicon voters), and the pool of telling terms they come from."""
    bad, good = Counter(), Counter()
    for t, label, w in zip(found, y, weight, strict=True):
        counter = bad if label else good
        for x in t:
            counter[x] += w
    n_bad, n_good = max(weight[y == 1].sum(), 1), max(weight[y == 0].sum(), 1)
    least = _least(n_bad)
    telling = _telling(bad, good, n_bad, n_good)[:pool]
    bad_rows = set(np.flatnonzero(y == 1).tolist())
    has = {x: {i for i in bad_rows if x in found[i]} for x in telling}
    chosen: list[str] = []
    for _ in range(3):  # so that most documents have several voters
        left, open_terms = set(bad_rows), [x for x in telling if x not in chosen]
        while len(chosen) < most and open_terms:
            value = {x: sum(weight[i] for i in has[x] & left) - 2 * good[x] * n_bad / n_good for x in open_terms}
            best = max(open_terms, key=lambda x: (value[x], bad[x], x))
            if value[best] < least:
                break
            chosen.append(best)
            open_terms.remove(best)
            left -= has[best]
    return chosen, telling


def votes(texts: list[str], found: list[set[str]], lexicon: list[str]) -> np.ndarray:
    """1 toxic, -1 clean, 0 none; a row for each text."""
    out = np.zeros((len(texts), len(_SEED_WORDS) + len(lexicon) + len(PATTERNS) + 1), np.int8)
    n = len(_SEED_WORDS) + len(lexicon)
    for i, (text, t) in enumerate(zip(texts, found, strict=True)):
        out[i, :n] = [bool(s & t) for s in _SEED_WORDS.values()] + [x in t for x in lexicon]
        words = words_of(text)
        out[i, n:-1] = [p(text, words) for p in PATTERNS.values()]
        out[i, -1] = 0 if out[i, :n].any() else -1
    return out


class LabelModel:
    """Probabilities of each voter's votes given the class, and discounts for correlated voters."""

    def fit(self, v: np.ndarray, weight: np.ndarray, labels: np.ndarray, rounds: int = 20) -> LabelModel:
        """labels: 0, 1 or -1 for unknown; known ones hold the two classes to their meaning while the others are estimated."""
        is_vote = np.stack([v == x for x in (-1, 0, 1)], 2).astype(np.float64)
        known = labels >= 0
        if known.any() and 0 < labels[known].mean() < 1:
            start = np.where(known, labels, 0.0)
            use = weight * known
        else:
            start, use = (v == 1).any(axis=1).astype(np.float64), weight
        self.discount = np.ones(v.shape[1])
        self._maximise(is_vote, start, use)
        if use is not weight:
            self._correlate(v, start, use)  # before voters that say the same can agree on a class of their own
        for i in range(rounds):
            post = np.where(known, labels, self._posterior(is_vote))
            if i == rounds // 2 and use is weight:
                self._correlate(v, post, weight)
            self._maximise(is_vote, post, weight)
        return self

    def _maximise(self, is_vote, post, weight):
        self.prior = float(np.clip((post * weight).sum() / max(weight.sum(), 1e-9), 0.005, 0.6))
        self.p = []
        for c in (1 - post, post):
            k = np.einsum("nmv,n->mv", is_vote, c * weight) + 0.2
            self.p.append(k / k.sum(axis=1, keepdims=True))

    def _posterior(self, is_vote) -> np.ndarray:
        evidence = np.log(self.p[1] / self.p[0])
        evidence[:, 1] = 0  # who doesn't vote says nothing
        log_odds = np.einsum("nmv,mv->nm", is_vote, evidence) @ self.discount
        return 1 / (1 + np.exp(-np.clip(log_odds + np.log(self.prior / (1 - self.prior)), -30, 30)))

    def _correlate(self, v, post, weight):
        total = np.zeros((v.shape[1], v.shape[1]))
        for c in (1 - post, post):
            w = c * weight
            x = v - (v * w[:, None]).sum(axis=0) / max(w.sum(), 1e-9)
            cov = (x * w[:, None]).T @ x / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            total += np.clip(cov / sd[:, None] / sd[None, :], -1, 1) / 2
        np.fill_diagonal(total, 0)
        self.correlation = total
        self.discount = 1 / (1 + (np.maximum(total, 0) ** 2).sum(axis=1))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return self._posterior(np.stack([v == x for x in (-1, 0, 1)], 2).astype(np.float64))


class Classifier:
    """Logistic regression over terms and patterns."""

    def __init__(self, names: list[str]):
        self.wanted = Wanted(names)
        self.w = np.zeros(len(names) + len(PATTERNS) + 1)

    def _rows(self, texts: list[str]) -> list[list[int]]:
        n, last = len(self.wanted.index), len(self.w) - 1
        out = []
        for text in texts:
            words = words_of(text)
            out.append([*self.wanted.numbers(words), *(n + j for j, p in enumerate(PATTERNS.values()) if p(text, words)), last])
        return out

    def fit(self, texts, target: np.ndarray, weight: np.ndarray, rounds: int = 400) -> Classifier:
        x = np.zeros((len(texts), len(self.w)), np.float32)
        for i, r in enumerate(self._rows(texts)):
            x[i, r] = 1
        self.w[-1], m, s = -2.0, np.zeros_like(self.w), np.zeros_like(self.w)
        pull = np.full(len(self.w), 2e-4)
        pull[-1] = 0
        for i in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            g = x.T @ ((p - target) * weight / weight.sum()) + pull * self.w
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            self.w -= 0.1 * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = self._rows([t or "" for t in texts])
        z = np.array([self.w[r].sum() for r in rows]) if rows else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, voters: int = VOTERS, pool: int = POOL,
    folds: int = FOLDS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text",
) -> Classifier:
    """Learns from labelled rows outside the held-out fold and from unlabelled rows; per_class and most_bytes bound what comes to the driver."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where((fold(F.col("id"), folds) != held_out) & F.col("y").isin(0, 1)).distinct()
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # and rows of any kind, their labels unseen
    others = docs.select(F.col(id_col).alias("id"), F.lit(-1).alias("y")).where(F.col("id").isNotNull() & (fold(F.col("id"), folds) != held_out))
    chosen = bounded_sample(known, F.col("id"), F.col("y"), per_class, "toxicity", counts).unionByName(bounded_sample(others, F.col("id"), F.col("y"), per_class, "any"))
    rows = sorted((y, t) for t, y in labelled_texts(docs, chosen, id_col, text_col, most_bytes))
    release(docs.sparkSession)
    texts, y = [t for _, t in rows], np.array([a for a, _ in rows])
    copies = Counter(clusters := [(a, _cluster(t)) for a, t in rows])
    weight = np.array([1 / copies[c] for c in clusters])
    taken = Counter(y[y >= 0].tolist())
    share_of = {c: counts[c] / taken[c] for c in taken}
    natural = weight * np.array([share_of.get(a, 1.0) / max([1e-9, *share_of.values()]) if a >= 0 else 1.0 for a in y.tolist()])
    labelled = y >= 0
    seeds = {w for s in _SEED_WORDS.values() for w in s}
    held = Wanted(sorted(_candidates(texts, y, weight, pool) | seeds))
    found = [terms(t, held) for t in texts]
    lexicon, telling = mine([f for f, k in zip(found, labelled, strict=True) if k], y[labelled], weight[labelled], voters, pool) if len(taken) == 2 else ([], [])
    v = votes(texts, found, lexicon) if texts else np.zeros((0, 1))
    model = Classifier(sorted({*telling, *lexicon, *seeds}))
    if texts:
        target = LabelModel().fit(v, natural, y).posterior(v)
        model.fit(texts, target, weight)
    else:
        model.w[-1] = -2.0
    model.lexicon = lexicon
    return model


def with_scores(docs: DataFrame, model: Classifier, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(row, text, score), see common.beside_text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return beside_text(docs, text_col, "score double", lambda texts: [pa.array(shared.value.score(texts), pa.float64())], keep_text)


def scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), a row for each row of docs."""
    thin = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_scores(thin, model, keep_text=False).select("row.doc_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` scored as `labels.toxic` marks them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
