"""Substring dedup: suffix trees of the corpus, cut down to windows and split by prefixes, whose deep nodes are repeats.

A text's words are `[^\\x20\\x09-\\x0D]+`.  A suffix begins at a word and matters down to `window` words.  Two suffixes of
the corpus that agree so far are leaves below one internal node at that depth; each such node is a repeat, and what its
leaves cover is to be removed.  Runs of neighbouring repeats are maximal repeats and become one span.

1.  *Sieve.*  A window's sign is the smallest hash among its runs of GRAM words.  Equal windows have equal signs, so only
    suffixes whose sign occurs at another place can lie below a deep node; all others are left out, which is exact.
    Signs are about an eighth of the words; copies of a whole text give theirs once.
2.  *Vertical partition.*  Suffixes are dealt into groups by their prefixes.  A prefix is PREFIXES[0] words long, and
    longer where too many suffixes share it, up to the whole window.  A first pass counts prefixes of each length in
    slots; those of an overfull slot are told apart by the next length.  Suffixes that agree down to the window always
    come together, and a group fits a task's memory.
3.  *Subtrees.*  A task first merges equal suffixes of its own texts: their repeats are known at once, and one of them goes
    on for all, so that a passage shared by a third of all texts is one suffix a task.  A group's suffixes are sorted by
    their symbols (hashes of the stretches SYMBOLS of the window), which gives the leaves in order, and the depth at which
    neighbours part gives the internal nodes.
4.  Places below deep nodes come together by text and become spans of words.  Texts that occur several times are removed
    whole if they have a window.

Words are 64-bit hashes and suffixes are compared by two symbols of 64 bits; no text is compared again.  Every step is a
shuffle by a hash with bounded groups; only tables of slots are broadcast.

Cases: null text has no word.  Fewer words than the window: nothing is removed.  Repeated rows are copies of one another.
A text of one word again and again repeats itself and goes.  Ids are passed over and may be null or equal.  Very long
texts are taken in parts that overlap by a window.  Empty tables give empty results.  Further columns are handed on in
`row`, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import cut, hot_slots, join_hot, slot_filter, slot_split

WINDOW = 35
#: Rows of one sign or text that stay together in a join.
TOGETHER = 1024
_U = np.uint64
_K1, _K2, _K3 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20250611)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_WORD = bytes(0 if b in b"\t\n\v\f\r " else 1 for b in range(256))
_LONG_WORD = 64
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Bounds:
    """Suffixes of a group, about; slots in which prefixes of one length are counted; words, and suffixes, that a task holds
    at a time; bytes that are hashed at a time."""

    group: int = 1 << 18
    slots: int = 1 << 14
    words: int = 1 << 18
    suffixes: int = 1 << 19
    segment: int = 1 << 22


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))])
    return have


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _K1
    h = (h ^ (h >> _U(29))) * _K2
    return h ^ (h >> _U(32))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some bytes, and where they begin."""
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.frombuffer(data.translate(_IS_WORD), np.int8)
    edge = np.flatnonzero(np.diff(word, prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * _power(_BASE, n)[:n], out=sums[1:])
    size = end - begin
    h = _mix((sums[end] - sums[begin]) * _power(_INVERSE, n)[begin] + size.astype(np.uint64) * _K3)
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    return h, begin


def word_hashes(data: bytes, segment: int = Bounds.segment) -> np.ndarray:
    """64-bit hashes of the words of a text, a segment of it at a time."""
    parts, at = [], 0
    while len(data) - at > segment:
        end = at + segment
        while end < len(data) and _IS_WORD[data[end]]:  # a segment ends at white space
            end += 1
        parts.append(_hashed(data[at:end])[0])
        at = end
    parts.append(_hashed(data[at:])[0])
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _K2 + b * _K3 + _K1)


class Parts:
    """Windows of some texts (or parts of long ones), whose words stand one after another."""

    def __init__(self, texts: list[tuple[int, int, np.ndarray]], window: int):
        """texts: number of the text, words before the part, hashes of its words."""
        self.window, self.gram = window, max(1, window // 2)
        h = np.concatenate([x[2] for x in texts])
        size = np.array([len(x[2]) for x in texts])
        self.text = np.repeat([x[0] for x in texts], size)
        first = np.cumsum(size) - size
        self.place = np.arange(len(h)) + np.repeat([x[1] for x in texts] - first, size)
        part = np.repeat(np.arange(len(texts)), size)
        self.runs = {1: h}
        n = max(0, len(h) - window + 1)
        self.valid = part[:n] == part[window - 1 :] if n else np.zeros(0, bool)
        self.grams = self.run(self.gram)
        self.gram_whole = part[: len(self.grams)] == part[self.gram - 1 :] if len(self.grams) else np.zeros(0, bool)
        self.sign = _sliding(self.grams, window - self.gram + 1, np.minimum)[:n]

    def run(self, n: int) -> np.ndarray:
        """Hashes of the runs of n words, by place: halves put together."""
        if n not in self.runs:
            half = 1 << (n - 1).bit_length() - 1
            a, b = self.run(half), self.run(n - half)
            m = max(0, len(self.runs[1]) - n + 1)
            self.runs[n] = _joined(a[:m], b[half : half + m])
        return self.runs[n]

    def signs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, sign, whether it is at several places of the text), a row for each sign of a text."""
        wide = self.window - self.gram
        chosen = _sliding(np.concatenate([np.zeros(wide, np.uint64), np.where(self.valid, self.sign, _U(0)), np.zeros(wide, np.uint64)]), wide + 1, np.maximum)
        at = np.flatnonzero((chosen[: len(self.grams)] == self.grams) & self.gram_whole)
        text, sign = self.text[at], self.grams[at]
        order = np.lexsort((sign, text))
        text, sign = text[order], sign[order]
        new = np.append(True, (text[1:] != text[:-1]) | (sign[1:] != sign[:-1])) if len(text) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        return text[begin], sign[begin], np.diff(np.append(begin, len(text))) > 1


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (or most) of each n neighbours."""
    size, out = 1, x
    while size * 2 <= n:
        out = least(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    return least(out[: max(0, len(x) - n + 1)], out[n - size : n - size + max(0, len(x) - n + 1)]) if n > size and len(out) else out


def _held(column: pa.Array, window: int, bounds: Bounds) -> Iterator[Parts]:
    """Texts some at a time; long ones in parts that overlap by a window less a word."""
    most, held, words = bounds.words, [], 0
    for number in range(len(column)):
        h = word_hashes(column[number].as_py(), bounds.segment)
        for at in range(0, max(1, len(h) - window + 1), most):
            part = h[at : at + most + window - 1]
            if len(part) >= window:
                held.append((number, at, part))
                words += len(part)
            if words >= most:
                yield Parts(held, window)
                held, words = [], 0
    if held:
        yield Parts(held, window)


def _sign_rows(window: int, bounds: Bounds):
    """(k1, k2, once, twice): signs of each text that has a window, those at one place and those at several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = [p.signs() for p in _held(part.column("data"), window, bounds)]
                if not found:
                    continue
                text, sign, several = (np.concatenate(x) for x in zip(*found, strict=True))
                lists = []
                for flag in (False, True):
                    these = several == flag
                    ends = np.searchsorted(text[these], np.arange(part.num_rows + 1))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sign[these].view(np.int64))))
                out = pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), *lists], names=["k1", "k2", "once", "twice"])
                yield out.take(pa.array(np.unique(text)))

    return run


def prefixes(window: int) -> list[int]:
    """Lengths of prefixes, the last the whole window."""
    return [*(n for n in (4, 8, 16, 24) if n < window), window]


def symbols(window: int) -> tuple[int, int]:
    """Lengths of the two stretches of a suffix."""
    return window // 2, window - window // 2


class Suffixes:
    """Suffixes of a task's texts: prefix hashes by level, symbols, text and place; equal ones merged."""

    def __init__(self, found: list[tuple[np.ndarray, ...]]):
        self.levels = [np.concatenate(x) for x in zip(*(f[0] for f in found), strict=True)]
        first, second, text, place, copied = (np.concatenate([f[i] for f in found]) for i in range(1, 6))
        order, depth = leaves(first, second)
        same = np.append(depth == 2, False) | np.append(False, depth == 2) if len(order) else np.zeros(0, bool)
        alone = ~copied[order]
        #: (text, place) of repeats that are known already
        self.known = text[order][same & alone], place[order][same & alone]
        keep = order[np.append(True, depth != 2)] if len(order) else order
        known = np.zeros(len(order), bool)
        known[order] = same
        self.levels = [x[keep] for x in self.levels]
        self.first, self.second, self.text = first[keep], second[keep], text[keep]
        self.place = np.where(known[keep] | copied[keep], -1, place[keep]).astype(np.int32)


def leaves(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their symbols, and for each two neighbours the number of symbols after which they part."""
    order = np.lexsort((second, first))
    a = first[order][1:] == first[order][:-1]
    return order, a.astype(np.int8) + (a & (second[order][1:] == second[order][:-1]))


def deep_leaves(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether each suffix is below an internal node at the depth of the window."""
    order, depth = leaves(first, second)
    out = np.zeros(len(first), bool)
    if len(order):
        out[order] = np.append(depth == 2, False) | np.append(False, depth == 2)
    return out


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, bounds: Bounds) -> Iterator[Suffixes]:
    a, b = symbols(window)
    found, held = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
            wanted = part.column("signs")
            lists = [np.asarray(wanted[i].values.to_numpy(zero_copy_only=False)).view(np.uint64) for i in range(part.num_rows)]
            owner = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
            keys = np.unique(_joined(np.concatenate(lists), owner.astype(np.uint64)))
            for p in _held(part.column("data"), window, bounds):
                n = len(p.valid)
                where = np.flatnonzero(p.valid & np.isin(_joined(p.sign, p.text[:n].astype(np.uint64)), keys))
                if len(where):
                    levels = [p.run(k)[where] for k in prefixes(window)]
                    text = p.text[where]
                    found.append((levels, p.run(a)[where], p.run(b)[where + a], ids[text], p.place[where], copies[text] > 1))
                    held += len(where)
                if held >= bounds.suffixes:
                    yield Suffixes(found)
                    found, held = [], 0
    if found:
        yield Suffixes(found)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> _U(20)).astype(np.int64) % slots


def _count_rows(window: int, bounds: Bounds):
    """One row a task: suffixes by level and slot of their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(prefixes(window)), bounds.slots), np.int64)
        for s in _suffixes(batches, window, bounds):
            for level, h in enumerate(s.levels):
                total[level] += np.bincount(_slot(h, bounds.slots), minlength=bounds.slots)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def overfull(counts: np.ndarray, group: int) -> np.ndarray:
    """By level and slot, whether its prefixes have to be longer: more suffixes than others have, by half a group."""
    out = counts > counts.sum(axis=1, keepdims=True) / counts.shape[1] + group / 2
    out[-1] = False
    return out


def _of_group(levels: list[np.ndarray], full: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix: by its shortest prefix that isn't in an overfull slot."""
    out, open_ = np.zeros(len(levels[0]), np.int64), np.ones(len(levels[0]), bool)
    for level, h in enumerate(levels):
        fits = open_ & ~full[level][_slot(h, full.shape[1])]
        out[fits] = (_mix(h[fits] + _U(level)) % _U(groups)).astype(np.int64)
        open_ &= ~fits
    return out


_RECORD = np.dtype([("first", "<u8"), ("second", "<u8"), ("text", "<i8"), ("place", "<i4")])
_HIT = np.dtype([("text", "<i8"), ("place", "<i4")])


def _dealt(group: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(group, data): a row for each group that occurs, with its rows as bytes."""
    order = np.argsort(group, kind="stable")
    group, rows = group[order], rows[order]
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    ends = np.append(begin[1:], len(group))
    if len(begin):
        data = [rows[i:j].tobytes() for i, j in zip(begin, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(group[begin], pa.int64()), pa.array(data, pa.binary())], names=["group", "data"])


def _hits(text: np.ndarray, place: np.ndarray, groups: int, after: int = 0) -> Iterator[pa.RecordBatch]:
    rows = np.empty(len(text), _HIT)
    rows["text"], rows["place"] = text, place
    yield from _dealt((_mix(text.astype(np.uint64)) % _U(groups)).astype(np.int64) + after, rows)


def _deal_rows(window: int, bounds: Bounds, full: np.ndarray, groups: int):
    """Suffixes by group; repeats that are known already go to groups of their own, after the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _suffixes(batches, window, bounds):
            rows = np.empty(len(s.text), _RECORD)
            for name in _RECORD.names:
                rows[name] = getattr(s, name)
            yield from _dealt(_of_group(s.levels, full, groups), rows)
            yield from _hits(*s.known, groups, groups)

    return run


def _bytes_of(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(d.as_py(), kind) for d in table.column("data")])


def _subtree(groups: int):
    def run(table: pa.Table) -> pa.Table:
        empty = pa.table({"group": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        group = table.column("group")[0].as_py()
        if group >= groups:  # known already
            return pa.table({"group": pa.array(table.column("group").combine_chunks().to_numpy() - groups, pa.int64()), "data": table.column("data")})
        rows = _bytes_of(table, _RECORD)
        hit = deep_leaves(rows["first"], rows["second"]) & (rows["place"] >= 0)
        found = list(_hits(rows["text"][hit], rows["place"][hit], groups))
        return pa.Table.from_batches(found) if found else empty

    return run


def _span_rows(window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = np.unique(_bytes_of(table, _HIT))
        text, place = rows["text"], rows["place"].astype(np.int64)
        new = np.append(True, (text[1:] != text[:-1]) | (place[1:] > place[:-1] + window))
        begin = np.flatnonzero(new)
        last = place[np.append(begin[1:], len(place)) - 1] + window
        of, first = text[begin], place[begin]
        ids, at = np.unique(of, return_index=True)
        ends = np.append(at, len(of)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["first", "last"])
        return pa.table({"id": pa.array(ids), "spans": pa.ListArray.from_arrays(pa.array(ends), spans)})

    return run


def repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """(k1, k2, spans): of each text with something to remove, by the two hashes of the text (see keyed()), the spans of
    words [first, last); null spans: all of them, as the text occurs several times."""
    if window < 2:
        raise ValueError("a window has two words at least")
    base = keyed(docs, text_col).select("k1", "k2", F.col("text").cast("binary").alias("data"))
    lists = "once array<bigint>, twice array<bigint>"
    signs = base.mapInArrow(_sign_rows(window, bounds), f"k1 bigint, k2 bigint, {lists}")
    texts = signs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("once").alias("once"), F.first("twice").alias("twice"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))
    counted = [F.arrays_zip(F.col(c).alias("sign"), F.array_repeat(F.lit(n), F.size(c)).alias("n")) for c, n in (("once", 1), ("twice", 2))]
    each = texts.select("id", F.inline(F.concat(*counted)).alias("sign", "n"))
    often = cut(each.groupBy("sign").agg(F.sum("n").alias("n")).where("n > 1"))
    met = join_hot(each.drop("n"), often, ["sign"], "id", hot_slots(often, ["sign"], "n", TOGETHER))
    sieved = cut(met.groupBy("id").agg(F.collect_list("sign").alias("signs")).join(texts.select("id", "k1", "k2", "copies"), "id"))
    some = slot_filter(base, F.xxhash64("k1", "k2"), sieved, F.xxhash64("k1", "k2"))
    involved = cut(some.groupBy("k1", "k2").agg(F.first("data").alias("data")).join(sieved, ["k1", "k2"]).select("id", "copies", "signs", "data"))
    shape = (len(prefixes(window)), bounds.slots)
    counts = involved.mapInArrow(_count_rows(window, bounds), "counts binary").rdd.treeAggregate(np.zeros(shape, np.int64), lambda a, r: a + np.frombuffer(r.counts, np.int64).reshape(shape), lambda a, b: a + b, 2)
    groups = max(1, -(-int(counts[-1].sum()) // bounds.group))
    dealt = involved.mapInArrow(_deal_rows(window, bounds, overfull(counts, bounds.group), groups), "group bigint, data binary")
    hits = dealt.groupBy("group").applyInArrow(_subtree(groups), "group bigint, data binary")
    spans = hits.groupBy("group").applyInArrow(_span_rows(window), "id bigint, spans array<struct<first:bigint,last:bigint>>")
    part = spans.join(sieved.where("copies = 1").select("id", "k1", "k2"), "id").select("k1", "k2", F.lit(1).cast("long").alias("copies"), "spans")
    whole = texts.where("copies > 1").select("k1", "k2", "copies", F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("spans"))
    return cut(part.unionByName(whole))


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, k1, k2): a struct of the other columns, the text (null: empty) and its two hashes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), text.alias("text"))
    return packed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("wide"), "text")})


def _kept_rows(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, removed, kept = [], [], []
                for data, spans, whole in zip(part.column("data"), part.column("spans").to_pylist(), part.column("whole").to_pylist(), strict=True):
                    words = data.as_py().split()
                    counts.append(len(words))
                    if whole:
                        words = []
                    elif spans:
                        left, begin = [], 0
                        for s in spans:
                            left += words[begin : s["first"]]
                            begin = s["last"]
                        words = left + words[begin:]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=names)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """(row, n_words, n_removed, kept), a row for each row of docs: its other columns, and its text without what occurs elsewhere."""
    found = repeats(docs, window, text_col, bounds)
    base = keyed(docs, text_col).withColumns({"data": F.col("text").cast("binary"), "spread": F.xxhash64("row")}).drop("text")
    key = F.xxhash64("k1", "k2")
    some, others = slot_split(base, key, found, key)
    met = join_hot(some, found, ["k1", "k2"], "spread", hot_slots(found, ["k1", "k2"], "copies", TOGETHER), "left")
    columns = ["row", "data", "spans", (F.coalesce("copies", F.lit(1)) > 1).alias("whole")]
    none = others.withColumns({"spans": F.lit(None).cast("array<struct<first:bigint,last:bigint>>"), "copies": F.lit(1).cast("long")})
    schema = T.StructType([base.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept binary").fields])
    done = met.select(*columns).unionByName(none.select(*columns)).mapInArrow(_kept_rows(schema.names), schema)
    return done.withColumn("kept", F.col("kept").cast("string"))


def op11(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP11 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS MATERIALIZED (
  SELECT r, i, md5_number(array_to_string(w[i : i + 34], ' ')) AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35
), h AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)
), k AS (SELECT r, list(k) AS gone FROM h GROUP BY r
), p AS (SELECT r, i AS k, w[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
), s AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.k) AS kept FROM p ANTI JOIN h ON p.r = h.r AND p.k = h.k GROUP BY p.r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(k.gone), 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN s USING (r)
"""
