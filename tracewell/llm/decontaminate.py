"""Benchmark decontamination: an FM-index per training shard, searched backwards for every benchmark window.

A shard is a bounded run of one task's documents.  A word that is in no window of the benchmark can't be inside an
occurrence, so only unbroken runs of window words, at least as long as the window, go into the shard's text; that is
exact, and keeps the index to a few hundredths of the words.  Over that text:

* a suffix array by prefix doubling gives the Burrows-Wheeler transform, held as a wavelet matrix with rank counts;
* all windows are searched at once, word by word from the last to the first: two ranks a step;
* occurrences are located by walking back to the next sampled suffix position (one in SAMPLE_EVERY);
* what the occurrences cover is merged into spans of words to remove.

The benchmark is taken in blocks of bounded size, each one more map over the same rows, so there is no shuffle and no
pair of document and item beyond those that do occur.  A block's windows are arrays (Windows): its words as numbers one
after another, and where windows begin; blocks are settled one after another, with the rows written in between.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  Cases: null or wordless text has no word, no
hit, no item.  An item without words has no window; one with a null id marks words but is not listed.  Item ids may be
of any type; they are listed as strings.  Items repeated under one id count once.  Empty tables give empty results (no benchmark: no hits).  Further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import cut

WINDOW = 10
#: Bytes of benchmark text that are broadcast at a time, and words in a shard's index.
BLOCK_BYTES, SHARD_WORDS, SHARD_DOCS = 16 << 20, 1 << 18, 1 << 15
SAMPLE_EVERY = 8
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class FMIndex:
    """Over symbols 1 and up; 0 ends the text."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0).astype(np.int64)
        n, self.most = len(text), int(text.max())
        self.n = n
        sa = _suffix_array(text)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text))])
        x = text[sa - 1]
        self.levels = []
        for bit in reversed(range(max(1, self.most.bit_length()))):
            b = (x >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - b)]).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            x = np.concatenate([x[b == 0], x[b == 1]])
        self.first = self._walk(np.arange(len(self.start) - 1), np.zeros(len(self.start) - 1, np.int64))
        marked = sa % SAMPLE_EVERY == 0
        self.marks, self.sampled = np.concatenate([[0], np.cumsum(marked)]), sa[marked]

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, zeros, total in self.levels:
            z = zeros[i].astype(np.int64)
            i = np.where((c >> bit) & 1, total + i - z, z)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c is among the first i of the transform."""
        return self._walk(c, i) - self.first[c]

    def back(self, i: np.ndarray) -> np.ndarray:
        """Row of the suffix one position further left."""
        c = np.zeros(len(i), np.int64)
        for bit, zeros, total in self.levels:
            z = zeros[i].astype(np.int64)
            one = zeros[i + 1] == z
            c |= one.astype(np.int64) << bit
            i = np.where(one, total + i - z, z)
        return self.start[c] + i - self.first[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns (a row each): the index of the pattern and the position, for each occurrence."""
        which = np.flatnonzero((patterns <= self.most).all(axis=1))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[which, j]
            lo, hi = (self.start[c] + self.rank(c, x) for x in (lo, hi))
            some = lo < hi
            which, lo, hi = which[some], lo[some], hi[some]
        counts = hi - lo
        rows = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(which, counts), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            found = self.marks[rows + 1] > self.marks[rows]
            out[left[found]] = self.sampled[self.marks[rows[found]]] + steps
            left, rows = left[~found], self.back(rows[~found])
            steps += 1
        return out


def _suffix_array(text: np.ndarray) -> np.ndarray:
    n = len(text)
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        moved = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(moved[1:] != moved[:-1])])
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


def _same(text: np.ndarray, n: int) -> np.ndarray:
    """For each place where n symbols follow: a number, equal for equal runs of n symbols."""

    def joined(a: np.ndarray, size: int, b: np.ndarray) -> np.ndarray:
        both = a[: max(0, len(b) - size)] * (int(b.max(initial=0)) + 1) + b[size:]
        return np.unique(both, return_inverse=True)[1].astype(np.int64)

    power, size, out, done = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, None, 0
    while True:
        if n & size:
            out, done = (power, size) if out is None else (joined(out, done, power), done + size)
        if done == n:
            return out
        power, size = joined(power, size, power), 2 * size


class Windows:
    """Distinct windows of some items as arrays: the words of all items as numbers, and for each length of windows where
    each of them begins and which items have it."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        # 0: in no window, 1: between runs
        self.symbols: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items if i is not None})
        number, parts, begins, at = {x: k for k, x in enumerate(self.ids)}, [], {}, 0
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            parts.append(np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 2) for w in words), np.int32, len(words)))
            n = min(len(words), width)
            begins.setdefault(n, []).append((at, len(words) - n + 1, number.get(item, -1)))
            at += len(words)
        self.text = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        self.by_length, self.member = {}, {}
        for n, found in begins.items():
            first, count, item = (np.array(x, np.int64) for x in zip(*found, strict=True))
            starts = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            owner = np.repeat(item, count)
            self.member[n] = np.zeros(len(self.symbols) + 2, bool)
            for j in range(n):
                self.member[n][self.text[starts + j]] = True
            same = _same(self.text, n)[starts]
            order = np.lexsort((owner, same))
            starts, owner, same = starts[order], owner[order], same[order]
            new = np.append(True, same[1:] != same[:-1])
            listed = (np.append(True, owner[1:] != owner[:-1]) | new) & (owner >= 0)
            ends = np.cumsum(listed)[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
            self.by_length[n] = (starts[new].astype(np.int32), np.append(0, ends).astype(np.int32), owner[listed].astype(np.int32))

    def items_of(self, n: int, pattern: int) -> list[str]:
        _, ends, owner = self.by_length[n]
        return [self.ids[i] for i in owner[ends[pattern] : ends[pattern + 1]].tolist()]

    def candidates(self, n: int, present: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of patterns, their symbols) of the windows of n words all of which are present, some at a time."""
        starts = self.by_length[n][0]
        which = np.arange(len(starts), dtype=np.int32)
        for j in range(n):
            which = which[present[self.text[starts[which] + j]]]
        for at in range(0, len(which), most):
            some = which[at : at + most]
            yield some, self.text[starts[some][:, None] + np.arange(n)].astype(np.int64)

    def runs(self, symbols: np.ndarray) -> np.ndarray:
        """Whether each word lies in a run that can hold a whole window."""
        keep = np.zeros(len(symbols), bool)
        for n, member in self.member.items():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], member[symbols], [False]]).astype(np.int8)))
            for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= n]:
                keep[a:b] = True
        return keep


class _Shard:
    def __init__(self, windows: Windows):
        self.windows, self.rows, self.texts, self.words = windows, 0, [], 0

    def add(self, text: str | None) -> int:
        """Takes in a document; its number of words."""
        words = words_of(text)
        if words and self.windows.symbols:
            s = np.fromiter((self.windows.symbols.get(w, 0) for w in words), np.int64, len(words))
            if (keep := self.windows.runs(s)).any():
                at = np.flatnonzero(keep)
                self.texts.append((self.rows, at, s[at]))
                self.words += len(at)
        self.rows += 1
        return len(words)

    def result(self) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
        """By row, for those with a hit: spans of word numbers, and items."""
        if not self.texts:
            return {}
        parts, rows, at = [], [], []
        for row, words, symbols in self.texts:
            gaps = np.flatnonzero(np.diff(words) > 1) + 1
            parts.append(np.append(np.insert(symbols, gaps, 1), 1))
            at.append(np.append(np.insert(words, gaps, -1), -1))
            rows.append(np.full(len(parts[-1]), row))
        rows, at = np.concatenate(rows), np.concatenate(at)
        index = FMIndex(np.concatenate(parts))
        change, items = np.zeros(len(rows) + 1, np.int64), {}
        present = np.zeros(len(self.windows.symbols) + 2, bool)
        present[np.concatenate(parts)] = True
        for n in self.windows.by_length:
            for numbers, patterns in self.windows.candidates(n, present):
                which, where = index.search(patterns)
                np.add.at(change, where, 1)
                np.add.at(change, where + n, -1)
                for row, pattern in np.unique(np.stack([rows[where], numbers[which]], 1), axis=0).tolist() if len(where) else ():
                    items.setdefault(row, set()).update(self.windows.items_of(n, pattern))
        covered = np.cumsum(change)[:-1] > 0
        out = {}
        for row in items:
            a, b = np.searchsorted(rows, [row, row + 1])
            hit = at[a:b][covered[a:b]]
            cuts = np.flatnonzero(np.diff(hit) > 1)
            out[row] = (list(zip(hit[np.append(0, cuts + 1)].tolist(), (hit[np.append(cuts, len(hit) - 1)] + 1).tolist(), strict=True)), sorted(items[row]))
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _search(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        shard, parts, counts = _Shard(windows), [], []

        def flush():
            found = shard.result()
            at = 0
            for part in parts:
                spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                for i in (i for i in range(part.num_rows) if at + i in found):
                    more, ids = found[at + i]
                    spans[i] = [{"first": a, "last": b} for a, b in merge_spans([(s["first"], s["last"]) for s in spans[i]] + more)]
                    items[i] = sorted({*items[i], *ids})
                n = pa.array(counts[at : at + part.num_rows], pa.int64())
                at += part.num_rows
                new = {"n_words": n, "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(k, part.column(k)) for k in part.schema.names], names=part.schema.names)

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                counts += [shard.add(t) for t in part.column("text").to_pylist()]
                parts.append(part.drop_columns("text") if not keep_text else part)
                if shard.words >= SHARD_WORDS or shard.rows >= SHARD_DOCS or sum(p.nbytes for p in parts) > 32 << 20:
                    yield from flush()
                    shard, parts, counts = _Shard(windows), [], []
        yield from flush()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """(row, n_words, spans, items), a row for each row of docs: a struct of its other columns, the word spans
    [first, last) to remove, and the items whose windows occur.  keep_text: also the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    out = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:long,last:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = out.schema
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in rows], width))
        keep = keep_text or block < blocks - 1
        out = out.mapInArrow(_search(shared, keep), T.StructType([f for f in schema.fields if keep or f.name != "text"]))
        if block < blocks - 1:
            out = cut(out)  # so that a task never holds the windows of two blocks
            shared.destroy()
    return out


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans; what stands between two removed words goes too."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(data.translate(_TO_WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))).reshape(-1, 2)
    at, out = 0, []
    for a, b in spans:
        out.append(data[at : edge[a, 0]])
        at = edge[b - 1, 1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def op2(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` against whole `benchmark`."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE_OP2 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) WHERE len(w) > 0
), n AS (SELECT DISTINCT n FROM p
), g AS (
  SELECT doc_id, i, n.n, array_to_string(w[i : i + n.n - 1], ' ') AS g
  FROM d, n, LATERAL (SELECT unnest(range(1, greatest(len(w) - n.n + 2, 1))) AS i) WHERE len(w) >= n.n
), h AS MATERIALIZED (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p USING (n, g)
), hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id
), item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""
