"""Small tables with the odd cases, and plain versions to hold the operators against."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", score double, row string, items string, `a.b` int"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def docs(spark, texts, extra=False):
    rows = []
    for i, t in enumerate(texts):
        row = (i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t))
        rows.append((*row, 0.5, "r", "x", 1) if extra else row)
    return spark.createDataFrame(rows, EXTRA if extra else DOCS)


def shingles(text, width):
    w = WHITE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_components(texts, width, numerator, denominator=100):
    """Smallest index of each text's component, by all pairs."""
    sets, root = [shingles(t, width) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and denominator * both >= numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]
